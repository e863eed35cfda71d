"""Token ids as Parquet list columns that allow selective reads (operator 9)."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelsift.llm import kernels as K
from reelsift.llm.bpe import encode_corpus
from reelsift.llm.common import shared_dir

#: Writer options. Ids lie in a dictionary, so that a page holds a few bits for each; doc_id and n_tokens, sorted or small,
#: are delta-encoded by the second page format. Row groups and pages are small enough for their indexes to skip most of a file.
ENCODING = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.column.index.truncate.length": "16",
    "compression": "zstd",
}


#: Shards whose totals one task sums up.
SHARD_GROUP = 4096


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, chunk_bytes: int = 8 << 20) -> None:
    """Write doc_id, n_tokens and ids (array of int) of all whole texts to ``path``, a folder ``shard=N`` per range of doc_id,
    shards and the rows in them in ascending doc_id order. ``end_id`` follows each text; a null text is an empty one."""
    rows = encode_corpus(docs, tokenizer, ("n_tokens", "ids"), chunk_bytes, ordered=True, end_id=end_id)
    rows.withColumnRenamed("chunk", "shard").sortWithinPartitions("shard", "doc_id").write.options(**ENCODING).partitionBy("shard").parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The files' rows; only the pages of ``columns`` are read, and a filter on doc_id skips row groups and pages."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>, shard int").parquet(path).select(*columns, "shard")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, size = lists.flatten().to_numpy().astype("<u4", copy=False), lists.value_lengths().to_numpy()
        to = np.append(0, np.cumsum(size))
        crc = [zlib.crc32(flat[to[i] : to[i + 1]].tobytes()) for i in range(len(size))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "doc_id")), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["shard", "doc_id", "n_tokens", "ids_crc32"])


def token_directory(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document.

    Sums are taken within a shard, over the shards of a group and over the groups, so no task sees all documents or all shards. Rows that share a doc_id come
    in the order of n_tokens and ids_crc32; a null doc_id comes first. Empty files give an empty result.
    """
    rows = read_tokens(spark, path).mapInArrow(K.tidied(_crc), "shard int, doc_id long, n_tokens long, ids_crc32 long")
    shards = read_tokens(spark, path, ("n_tokens",)).groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("shard") / SHARD_GROUP))
    groups = shards.groupBy("group").agg(F.sum("n").alias("n")).select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("earlier"))
    upto = F.sum("n").over(Window.partitionBy("group").orderBy("shard"))
    before = shards.withColumn("upto", upto).join(groups, "group").select("shard", (F.col("earlier") + F.col("upto") - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("within", within - F.col("n_tokens")).join(before, "shard")
    return rows.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokens_round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``write_tokens`` to the shared folder, then ``token_directory`` from the files.

    A null text counts as empty and has the end id alone; a null doc_id comes first; rows that repeat a doc_id have a row each;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id, chunk_bytes)
    return token_directory(spark, path)
