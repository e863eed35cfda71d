"""The frame gate reads whole texts."""

from reelsift.operators import quality
from reelsift.plans import registry, rules  # noqa: F401


def test_frame_gate_sees_the_whole_text(spark, tmp_path):
    good = "a long first line about a walk in the hills\nand a second line of it"
    rows = [(4, good), (8, good + "\nin one word, good")]
    docs = spark.createDataFrame([(i, t, "en", "a source", 100) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.status, r.errors, r.n) for r in registry.QUERIES["frame_quality_gate"](spark, str(tmp_path)).collect()}
    assert got == {("passed", "", 1), ("quality_failed", "caption placeholder; note placeholder", 1)}


def test_manifest_gate_names_rows_of_one_text_and_needs_no_wide_rows(spark, tmp_path):
    rows = [("export", '{"schema_version": 1, "stage": "export", "clip_count": 0, "clips": []}', i) for i in (1, 2)]
    gate = quality.manifest_gate(spark.createDataFrame(rows, "stage string, raw string, id long"), "schema_version int, stage string, clip_count int, clips array<struct<clip_id: string>>")
    assert sorted((r.id, r.errors) for r in gate.collect()) == [(1, ""), (2, "")]
    keys = [1_500_000_000 + i for i in range(400)]  # a text may not grow with its key
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(r.id for r in registry.QUERIES["manifest_errors"](spark, str(tmp_path)).collect()) == keys
