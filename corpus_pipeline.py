"""A training-data pipeline over the documents table, in stages that each write their result for the next.

Stages keep rows with a null doc_id or a null text (it counts as an empty one and stays null), rows that repeat, and further
columns under any names. An empty table goes through all of them as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.llm.bpe import encode_corpus
from reelsift.llm.common import shared_dir
from reelsift.llm.decontaminate import decontaminate
from reelsift.llm.line_dedup import drop_boilerplate
from reelsift.llm.near_copies import dedup
from reelsift.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Without labels of both kinds none is rejected, or all at half or more toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the boilerplate lines of their source; n_chars, if there is one, follows a changed text."""
    rest = F.struct(*[c for c in docs.columns if c != "text"])  # apart from the counts that the operator adds
    rows = drop_boilerplate(docs.select(rest.alias("row"), "source", "text"))
    own = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(own[c] if c in own else F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: links of SimHash and of minimum hashes, at a similarity of 0.8 by five-word
    shingles. Texts without words are one group."""
    return dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, verbatim or with other numbers, names and units."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text decoded from them; a null text has no ids."""
    return encode_corpus(docs, outputs=("n_tokens", "ids", "decoded_sha256"), chunk_bytes=4 << 20).drop("chunk")


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("bpe encoding", encoding)]

#: No stage but line dedup can be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
