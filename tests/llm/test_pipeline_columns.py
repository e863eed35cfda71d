"""The pipeline's stages on tables with other columns than the given ones."""


def test_line_dedup_keeps_clashing_columns_and_needs_no_counts(spark):
    import corpus_pipeline

    rows = [(1, "a\nmenu", "s", 99, "x"), (2, "b\nmenu", "s", 98, None), (3, None, "s", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_dropped long, row string")
    got = corpus_pipeline.line_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", "s", 99, "x"), (2, "b", "s", 98, None), (3, None, "s", None, "z")]
    with_counts = docs.selectExpr("doc_id", "text", "source", "length(text) as n_chars", "n_dropped as n_lines")
    assert sorted((r.doc_id, r.n_chars, r.n_lines) for r in corpus_pipeline.line_dedup(spark, with_counts, "").collect()) == [(1, 1, 99), (2, 1, 98), (3, None, None)]
