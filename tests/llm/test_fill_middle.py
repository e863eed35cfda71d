"""Fill-in-middle against a plain version and DuckDB."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest

from reelsift.llm import fill_middle as fim


def plain_version(doc, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    d = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ROWS = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "no break"), (6, "a\nb\nc"), (7, "a\nb\nc\n"), (8, "x <P> y\nz"), (9, "ends in <\nM>\n<"),
    (10, "世界\nnaïve\n" * 50), (11, "long unit " * 3000), (12, "".join(f"line {i} é\n" for i in range(9000))), (13, "<M>"), (13, "other text\nof the same id"),
    (14, "twin\nrows\n"), (14, "twin\nrows\n"), (14, "twin\nrows\n"), (None, "null\nid"), (None, None), (15, "a\r\nb\x0bc\x85d e\n"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, "f") for i, t in rows], "doc_id long, text string, n long, form string")


@pytest.mark.parametrize(("piece", "parts"), [(7, 5), (64 << 10, 2)])
def test_outputs_digests_and_restored_texts(spark, piece, parts):
    docs = frame(spark, ROWS + [(i, f"{i}\n" * (i % 7)) for i in range(100, 160)]).repartition(parts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((i, *(p := plain_version(i, t))[:4], sha(p[4]), sha(t or "")) for i, t in rows)
    assert Counter(tuple(r) for r in fim.fim_round_trip(docs, piece_bytes=piece).collect()) == want
    outputs = Counter((r.doc_id, r.form, r.output) for r in fim.fim_outputs(fim.fim_pieces(docs, piece_bytes=piece)).collect())
    assert outputs == Counter((i, p[1], p[4]) for i, t in rows for p in [plain_version(i, t)])


def test_marks_are_read_across_pieces():
    whole = b"<S>one<P>two<M>three"
    for size in range(1, len(whole) + 1):
        reader, got = fim.Reader("spm"), {0: b"", 1: b"", 2: b""}
        for i in range(0, len(whole), size):
            for place, data in reader.feed(whole[i : i + size]):
                got[place] += data
        assert got == {2: b"one", 0: b"two", 1: b"three"}


def test_rate_and_empty_table(spark):
    docs = frame(spark, [(i, "a\nb\n") for i in range(200)])
    forms = Counter(r.form for r in fim.fim_round_trip(docs, rate=40, spm=0).collect())
    assert set(forms) == {"plain", "psm"} and 50 < forms["psm"] < 110
    assert fim.fim_round_trip(docs.limit(0)).count() == 0


def test_sql_is_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert Counter(con.execute(fim.FIM_SQL).fetchall()) == Counter(tuple(r) for r in fim.fim_round_trip(docs).collect())
