"""Running values within a key, in two levels, so that a key of any size is spread over tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.operators.greedy import shared_checkpoints

PART = "__part"


class Segments:
    """Rows in ranges of key and order. ``add`` gives each row values that run along its key; ``rows`` drops the ranges again.

    A value runs within its range first. The totals of ranges, one row for each key and range, run along the keys that lie in
    more than one range: these are at most two for each range, which bounds what is broadcast. ``order`` should tell rows apart,
    as equal ones aren't split. Null keys are a key; nulls of the order come where Spark's sort puts them.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[Column | str], parts: int | None = None):
        shared_checkpoints(rows.sparkSession)
        self.keys, self.order = keys, [F.col(c) if isinstance(c, str) else c for c in order]
        by = [*map(F.col, keys), *self.order]
        dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
        # Written, so that all that follows sees the same ranges.
        self._rows = dealt.withColumn(PART, F.spark_partition_id()).checkpoint()

    def add(self, **columns: tuple[str, Column | str]) -> Segments:
        """Columns by kind and value: ``sum``, ``count``, ``max`` and ``last`` (not null) up to a row and with it; ``sum_before``,
        ``max_before``, ``last_before`` up to the row before it; ``lag``, the row before. Null is what nothing gives."""
        rows, one = self._rows, F.lit(True)
        local = Window.partitionBy(*self.keys, PART).orderBy(*self.order)
        to, before = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
        total, carry, inside = {}, {}, {}
        for name, (kind, value) in columns.items():
            value = F.col(value) if isinstance(value, str) else value
            base, frame = kind.removesuffix("_before"), before if kind.endswith("_before") else to
            if base in ("sum", "count"):
                value = F.lit(1) if base == "count" else value
                inside[name], total[name], carry[name] = F.sum(value).over(frame), F.sum(value), F.sum
            elif base == "max":
                inside[name], total[name], carry[name] = F.max(value).over(frame), F.max(value), F.max
            elif base == "last":
                inside[name], total[name], carry[name] = F.last(value, True).over(frame), ("last", value, True), None
            elif base == "lag":
                inside[name], total[name], carry[name] = F.lag(F.struct(value.alias("x"))).over(local), ("last", value, False), None
            else:
                raise ValueError(f"no such kind: {kind}")
        # The last value of a range is that of its last row: a window finds it, as an aggregate has no order.
        marked = rows.withColumn("__end", F.lead(one).over(local).isNull())
        for name, t in total.items():
            if isinstance(t, tuple):
                value = F.last(t[1], True).over(to) if t[2] else t[1]
                marked = marked.withColumn(f"__last_{name}", F.struct(value.alias("x")))
        aggregates = [(F.max(F.when(F.col("__end"), F.col(f"__last_{n}"))) if isinstance(t, tuple) else t).alias(f"__t_{n}") for n, t in total.items()]
        totals = marked.groupBy(*self.keys, PART).agg(*aggregates)
        spread = Window.partitionBy(*self.keys)
        earlier = spread.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn("__n", F.count("*").over(spread)).where("__n > 1")
        carried = []
        for name, t in total.items():
            c = F.col(f"__t_{name}")
            if isinstance(t, tuple):
                got = F.last(F.when(c.getField("x").isNotNull(), c) if t[2] else c, True).over(earlier)
            else:
                got = carry[name](c).over(earlier)
            carried.append(got.alias(f"__c_{name}"))
        totals = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], F.col(PART).alias("__p"), *carried).where(reduce(lambda a, b: a | b, (F.col(f"__c_{n}").isNotNull() for n in columns)))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)], F.col(PART) == F.col("__p"))
        out = rows
        for name, column in inside.items():
            out = out.withColumn(f"__i_{name}", column)
        out = out.join(F.broadcast(totals), same, "left")
        final = []
        for name, (kind, _) in columns.items():
            i, c = F.col(f"__i_{name}"), F.col(f"__c_{name}")
            base = kind.removesuffix("_before")
            if base in ("sum", "count"):
                value = F.when(i.isNull() & c.isNull(), F.lit(None)).otherwise(F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0)))
            elif base == "max":
                value = F.greatest(i, c)
            elif base == "last":
                value = F.coalesce(i, c.getField("x"))
            else:
                value = F.coalesce(i, c).getField("x")
            final.append(value.alias(name))
        self._rows = out.select(*[F.col(c) for c in rows.columns if c not in columns], *final)
        return self

    def map(self, **columns: Column) -> Segments:
        """More columns of each row by itself."""
        self._rows = self._rows.withColumns(columns)
        return self

    @property
    def rows(self) -> DataFrame:
        return self._rows.drop(PART)


def first_at_or_above(rows: DataFrame, at: str, steps: DataFrame, edge: str, value: str, name: str) -> DataFrame:
    """As-of join upwards: rows with the ``value`` of the first step whose ``edge`` is not below their ``at``; null beyond the last.

    Rows and steps are sorted together in ranges, so neither side is broadcast or looped over. Of steps of one edge the one of
    least value is taken.
    """
    of_row = rows.select(F.col(at).cast("double").alias("__at"), F.lit(None).cast("double").alias("__value"), F.struct(*rows.columns).alias("__row"))
    of_step = steps.select(F.col(edge).cast("double").alias("__at"), F.col(value).cast("double").alias("__value"), F.lit(None).cast(of_row.schema["__row"].dataType).alias("__row"))
    both = Segments(of_row.union(of_step), [], [F.desc("__at"), F.desc_nulls_last("__value"), F.xxhash64("__row")])
    return both.add(__hit=("last", "__value")).rows.where("__row is not null").select("__row.*", F.when(F.col("__at").isNotNull(), F.col("__hit")).alias(name))
