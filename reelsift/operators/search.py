"""Search by filters, text and vector."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.functions.columns import clamp, dot, unit
from reelsift.operators.greedy import shared_checkpoints

WORD = "[^\\p{L}\\p{N}]+"


def filters(tags: list[str] | None = None, folder: str | None = None, duration: tuple[float | None, float | None] = (None, None), statuses: list[str] | None = None, created: tuple = (None, None)) -> Column:
    """P-01 to P-06: all conditions that are given, as one predicate."""
    length = F.col("end_sec") - F.col("start_sec")
    parts = [F.array_contains("tags", t) for t in tags or []]
    if folder:
        parts.append(reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(folder.lower())) for c in ("artifact_path", "preview_path", "source_video_path"))))
    parts += [length >= duration[0]] if duration[0] is not None else []
    parts += [length <= duration[1]] if duration[1] is not None else []
    parts += [F.col("status").isin(statuses)] if statuses else []
    parts += [F.col("created_at") >= created[0]] if created[0] is not None else []
    parts += [F.col("created_at") <= created[1]] if created[1] is not None else []
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def page_after(rows: DataFrame, after: tuple | None, size: int) -> DataFrame:
    """P-18 to P-20: the next page in order of created_at and id, after the last row seen."""
    if after:
        rows = rows.where(F.struct("created_at", "id") > F.struct(F.lit(after[0]).cast("timestamp"), F.lit(after[1]).cast(rows.schema["id"].dataType)))
    return rows.orderBy("created_at", "id").limit(size)


def browse(rows: DataFrame, size: int) -> DataFrame:
    """T-01: by final score (null last), newest, id."""
    return rows.orderBy(F.desc_nulls_last("final_score"), F.desc("created_at"), F.desc("id")).limit(size)


def postings(docs: DataFrame) -> DataFrame:
    """Z-01: term, id, tf and length of ``docs(id, text)``: lower-case words of letters and digits."""
    words = F.filter(F.split(F.lower("text"), WORD), lambda w: w != "")
    rows = docs.select("id", words.alias("words")).select("id", "words", F.size("words").alias("length"))
    return rows.select("id", "length", F.explode("words").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def text_scores(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """T-02 without an index: BM25 of ``docs(id, text)`` that hold all terms, as score / (1 + score).

    One scan of the texts counts each one's words and the wanted terms alone; figures of the corpus come from these counts.
    """
    wanted = sorted(set(terms))
    shared_checkpoints(docs.sparkSession)
    rows = docs.where("text is not null").select("id", F.split(F.lower("text"), WORD).alias("words"))
    without = lambda term: F.size(F.array_remove("words", term))
    rows = rows.select("id", without("").alias("length"), *[(F.size("words") - without(term)).alias(f"tf{i}") for i, term in enumerate(wanted)]).checkpoint()
    tf = [F.col(f"tf{i}") for i in range(len(wanted))]
    corpus = rows.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *[F.count_if(x > 0).alias(f"df{i}") for i, x in enumerate(tf)])
    part = lambda i, x: F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * x * (k1 + 1) / (x + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    hits = rows.where(reduce(lambda a, c: a & c, [x > 0 for x in tf], F.lit(True))).crossJoin(F.broadcast(corpus))
    bm25 = reduce(lambda a, c: a + c, [part(i, x) for i, x in enumerate(tf)], F.lit(0.0))
    return hits.select("id", bm25.alias("bm25")).select("id", F.round(F.col("bm25") / (1 + F.col("bm25")), 6).alias("score"))


def paged(rows: DataFrame, order: list[Column], size: int = 24, offset: int = 0) -> DataFrame:
    """P-18, P-20: a page of at most 1,000 rows, each with the total of all rows and whether more follow."""
    size, offset = min(max(size, 1), 1000), max(offset, 0)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(size)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + size)


def blended(lexical: DataFrame, vectors: DataFrame, query: list[float], weight: float = 0.5, semantic: bool = False) -> DataFrame:
    """T-02, J-09: lexical score and similarity of the query's vector, of the same dimension, blended.

    A row without a vector counts as at similarity 0, and keeps its full lexical score only where no hit has a vector. With
    ``semantic`` (D3) rows that have a vector but no lexical hit are found too.
    """
    same = vectors.where(F.size("vector") == len(query))
    near = same.select("id", clamp(dot(unit(F.col("vector")), unit(F.array(*map(F.lit, query))))).alias("near"))
    rows = lexical.join(near, "id", "full" if semantic else "left")
    some = rows.agg((F.count("near") > 0).alias("some"))
    both = (1 - weight) * F.coalesce("score", F.lit(0.0)) + weight * F.coalesce("near", F.lit(0.0))
    return rows.crossJoin(F.broadcast(some)).select("id", F.round(F.when(F.col("some"), both).otherwise(F.col("score")), 6).alias("score"))
