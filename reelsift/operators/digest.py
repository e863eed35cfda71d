"""Digests of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digests(rows: DataFrame, fields: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """One ``digest`` of each group's rows over the fields, whatever their order, and their number ``n``.

    Each row's sha256 is cut in eight numbers of 32 bits, which are summed over the group, so that rows combine before the
    shuffle and none is gathered; the count and the sums are hashed. Fields enter with their length, so that their bounds count.
    """
    cell = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    own = rows.select(*keys, F.sha2(F.concat(*(cell(F.col(f)) for f in fields)), 256).alias("__d"))
    part = lambda i: F.sum(F.conv(F.substring("__d", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)"))
    sums = own.groupBy(*keys).agg(F.count("*").alias("n"), *(part(i).alias(f"__{i}") for i in range(8)))
    return sums.select(*keys, F.sha2(F.concat_ws(",", F.col("n").cast("string"), *(F.coalesce(f"__{i}", F.lit(0)).cast("string") for i in range(8))), 256).alias("digest"), "n")
