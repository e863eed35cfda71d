"""The index after increments against the search without one."""

import pyarrow as pa
from pyspark.sql import functions as F

from reelsift.operators import search, text_index
from reelsift.operators.text_index import TextIndex


def rows_of(df):
    return sorted((r.id, r.score) for r in df.collect())


def test_increments_changes_and_deletions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.lit(1).cast("long").alias("seq"))
    changed = docs.where("id % 10 = 3").select("id", F.concat(F.lit("the that then "), F.substring("text", 1, 200)).alias("text"), F.lit(2).cast("long").alias("seq"))
    deleted = docs.where("id % 10 = 4").select("id", F.lit(None).cast("string").alias("text"), F.lit(2).cast("long").alias("seq"))
    now = docs.where("id % 10 not in (3, 4)").union(changed)
    index = TextIndex(spark, f"file://{tmp_path}/index", buckets=8)
    assert index.search(["the"]).count() == 0
    index.add(docs.where("id % 2 = 0"), "a")
    index.add(docs.where("id % 2 = 1").union(changed), "b")
    index.add(deleted.union(docs.where("id % 10 = 3")), "c")  # rows of an older seq change nothing
    index.add(docs.where("id = 1").withColumn("text", F.lit("again")).withColumn("seq", F.lit(9).cast("long")), "c")  # an increment that is there
    for terms in (["the", "that"], ["the"], ["then"], ["nowhere", "the"]):
        want = rows_of(search.text_scores(now.select("id", "text"), terms))
        assert rows_of(index.search(terms)) == want
    before = rows_of(index.search(["the", "that"]))
    assert before
    index.compact()
    assert len(index.increments()) == 1 and rows_of(index.search(["the", "that"])) == before
    index.add(docs.where("id % 10 = 4").withColumn("seq", F.lit(3).cast("long")), "d")  # back again
    assert rows_of(index.search(["the"])) == rows_of(search.text_scores(docs.where("id % 10 <> 3").union(changed).select("id", "text"), ["the"]))


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index", buckets=16)
    index.add(spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 40)), 1) for i in range(60)], "id long, text string, seq long"), "a")
    plan = index.postings(["w5"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    files = {f.split("bucket=")[1].split("/")[0] for f in index._live("postings", "term string, id long, tf long, length long, inc string, bucket int").where(F.col("bucket") == 3).inputFiles()}
    assert len(files) <= 16
    read = index.postings(["w5"])
    assert {r.id for r in read.collect()} == set(range(6))


def test_a_stream_keeps_it_up_and_goes_on_after_a_restart(spark, tmp_path):
    schema = "id long, text string, seq long"
    index, source, checkpoint = TextIndex(spark, f"file://{tmp_path}/index", 4), f"{tmp_path}/in", f"{tmp_path}/checkpoint"
    for k, rows in enumerate(([(1, "the cat", 1), (2, "the dog", 1)], [(1, "a bird", 2)], [(2, None, 2), (3, "the the end", 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        index.follow(spark.readStream.schema(schema).json(source), checkpoint).awaitTermination()
        assert len(index.increments()) == k + 1
    assert {r.id for r in index.search(["the"]).collect()} == {3} and {r.id for r in index.search(["bird"]).collect()} == {1}
    assert index.corpus() == (2, 2.5)


def test_an_increment_stores_blocks_of_postings(spark, tmp_path):
    rows = spark.range(0, 400, 1, 2).select("id", F.concat(F.lit("The dog and the Çat, the "), F.col("id")).alias("text"), F.lit(1).alias("seq"))
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.add(rows, "a")
    stored = spark.read.parquet(f"file://{tmp_path}/index/postings").groupBy("term").count()
    # Not a row for each of the 400 documents: one for each slice that a task took.
    assert stored.where("term in ('the', 'dog', 'and', 'çat')").agg(F.max("count")).first()[0] <= 16 and stored.count() == 404
    assert sorted(map(tuple, index.postings(["the", "7"]).collect())) == sorted([("the", i, 3, 7) for i in range(400)] + [("7", 7, 1, 7)])


def test_slices_hold_whole_lines_and_all_of_them(monkeypatch):
    lines = ["b a b", "x", "a " * 40 + "c", "é 字 é", "b"]
    batch = pa.RecordBatch.from_pydict({"id": [5, 3, 9, 1, 7], "length": [len(x.split()) for x in lines], "line": lines, "sign": pa.array([1, 1, -1, 1, -1], pa.int32())}).slice(0)
    want = sorted((w, i, s * x.split().count(w), s * len(x.split())) for i, x, s in zip([5, 3, 9, 1, 7], lines, [1, 1, -1, 1, -1]) for w in set(x.split()))
    for size, slices in ((1, 5), (7, 4), (1 << 20, 1)):
        monkeypatch.setattr(text_index, "SLICE_BYTES", size)
        blocks = list(text_index._blocks([batch]))
        assert len(blocks) == slices
        assert sorted((r["term"], *p) for b in blocks for r in b.to_pylist() for p in zip(r["ids"], r["tfs"], r["lengths"])) == want


def test_of_rows_with_one_id_and_seq_the_greatest_words_count(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index", 4)
    rows = [(1, "ab", 2), (1, "a, z!", 2), (1, None, 2), (1, "zz", 1), (2, "", 1), (3, None, 1), (4, "a b", 1), (4, "a", 1), (5, "late", None)]
    index.add(spark.createDataFrame(rows, "id long, text string, seq long"), "a")
    assert index.corpus() == (3, 1.0)  # of 1, 2 and 4
    assert {(r.term, r.id) for r in index.postings(["ab", "a", "z", "b", "zz", "late"]).collect()} == {("ab", 1), ("a", 4), ("b", 4)}
    index.add(spark.createDataFrame([(1, "b", 3), (4, None, 3), (2, "old", 1)], "id long, text string, seq long"), "b")
    assert index.corpus() == (2, 0.5) and {(r.term, r.id) for r in index.postings(["ab", "a", "b", "old"]).collect()} == {("b", 1)}
    index.compact()
    assert index.corpus() == (2, 0.5) and {(r.term, r.id) for r in index.postings(["ab", "a", "b", "old"]).collect()} == {("b", 1)}
