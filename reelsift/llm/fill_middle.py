"""Fill-in-middle rearrangement by a secondary sort (operator 12).

Each text is cut into units (lines). Pieces of whole units, keyed by document and place in the output, are dealt out by document
and sorted within partitions; a stream over them assembles the output and its digest without ever holding more than a piece.
The stream also reads the output back: it looks for the marks in it and gives every piece its place in the text, and a second
sort in the same partitions, without a shuffle, brings the pieces into the order of the text for the digest of what was restored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm import kernels as K
from reelsift.llm.common import bound_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Marks in the order of the output, and the place of what follows each of them in the text.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: A document is its id and 128 bits of its text. ``copies`` rows of one Arrow batch are the same document.
KEY = ["doc_id", "a", "b"]
_KINDS = {"doc_id": pa.int64(), "a": pa.int64(), "b": pa.int64(), "copies": pa.int64(), "n": pa.int64(), "form": pa.string(), "at": pa.int64(), "place": pa.int32(), "bytes": pa.binary(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string(), "output": pa.string()}
_SPARK = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
_PIECE = [*KEY, "copies", "n", "form", "at", "bytes"]
_RESTORED = [*KEY, "copies", "n", "form", "place", "at", "bytes", "prefix_chars", "middle_chars", "output_sha256"]
_DIGESTS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def _schema(names: list[str]) -> str:
    return ", ".join(f"{c} {_SPARK[_KINDS[c]]}" for c in names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[x]) for c, x in zip(list(zip(*rows)) or [()] * len(names), names)], names=names)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits that depend on the id alone; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def plan(text: bytes, doc_id: int | None, seed: int, rate: int, spm: int) -> tuple[int, str, list[tuple[bytes, int, int]]]:
    """Units of a text, its form, and mark and span of each part in the order of the output."""
    n = text.count(b"\n") + (text[-1:] not in (b"", b"\n"))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in PLACE) or h3 % 100 >= rate:
        return n, "plain", [(b"", 0, len(text))]
    form = "spm" if h4 % 100 < spm else "psm"
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    cut = [0 if k == 0 else len(text) if k == n else int(breaks[k - 1]) for k in (lo, hi)]
    spans = {PREFIX: (0, cut[0]), MIDDLE: (cut[0], cut[1]), SUFFIX: (cut[1], len(text))}
    return n, form, [(m, *spans[m]) for m in ORDER[form]]


def _cut(seed: int, rate: int, spm: int, size: int):
    """Pieces of whole units of about ``size`` bytes; a longer unit is cut wherever it must be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies: dict[tuple, int] = {}
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            keys = []
            for doc, text in zip(ids, texts):
                digest = hashlib.blake2b(text.as_buffer() if text.is_valid else b"", digest_size=16).digest()
                keys.append((doc, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
                copies[keys[-1]] = copies.get(keys[-1], 0) + 1
            rows, held = [], 0
            for key, text in zip(keys, texts):
                many = copies.pop(key, 0)
                if not many:
                    continue
                text = text.as_buffer().to_pybytes() if text.is_valid else b""
                n, form, parts = plan(text, key[0], seed, rate, spm)
                at = 0
                for mark, start, end in parts:
                    while True:
                        stop = min(end, start + size)
                        if stop < end:
                            stop = text.rfind(b"\n", start, stop) + 1 or stop
                        rows.append((*key, many, n, form, at, mark + text[start:stop]))
                        held, at, start, mark = held + stop - start, at + 1, stop, b""
                        if start >= end:
                            break
                if held > 1 << 20:
                    yield _batch(rows, _PIECE)
                    rows, held = [], 0
            yield _batch(rows, _PIECE)

    return run


def _documents(batches: Iterator[pa.RecordBatch], places: list[str]) -> Iterator[tuple[tuple, dict | None]]:
    """(key, row) for each piece in order, and (key, None) after a document's last. Of rows at one place, which are copies of
    one document, the first goes on; ``copies`` are summed where they first stand."""
    key = place = None
    for batch in batches:
        for i in range(0, batch.num_rows, 2_000):
            for row in batch.slice(i, 2_000).to_pylist():
                own, here = tuple(row[c] for c in KEY), tuple(row[c] for c in places)
                if own != key:
                    if key is not None:
                        yield key, None
                    key, place = own, None
                row["new"] = here != place
                place = here
                yield key, row
    if key is not None:
        yield key, None


class Reader:
    """Reads an output as it comes: feed gives what is text, with its place in the text."""

    def __init__(self, form: str):
        self.marks, self.place, self.rest = list(ORDER.get(form, ())), 0 if form == "plain" else None, b""

    def feed(self, data: bytes) -> list[tuple[int, bytes]]:
        data, out = self.rest + data, []
        self.rest = b""
        while self.marks:
            mark = self.marks[0]
            i = data.find(mark)
            if i < 0:
                keep = next(k for k in (2, 1, 0) if data[len(data) - k :] == mark[:k] and k <= len(data))
                data, self.rest = data[: len(data) - keep], data[len(data) - keep :]
                break
            if i and self.place is None:
                raise ValueError("the output doesn't begin with its mark")
            if i:
                out.append((self.place, data[:i]))
            self.place, data = PLACE[mark], data[i + 3 :]
            self.marks.pop(0)
        if data:
            out.append((self.place, data))
        return out


def _chars(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over pieces in the order of the output: pieces with their place in the text, and one at the end with what the output gave."""
    rows, held, digest = [], 0, None
    for key, row in _documents(batches, ["at"]):
        if row is None:
            plain = form == "plain"
            rows.append((*key, copies, n, form, 3, 0, b"", None if plain else chars[0], None if plain else chars[1], digest.hexdigest()))
            digest = None
        else:
            if digest is None:
                digest, copies, n, form, chars, at = hashlib.sha256(), 0, row["n"], row["form"], [0, 0, 0], 0
                reader = Reader(form)
            copies += row["copies"] if row["at"] == 0 else 0
            if row["new"]:
                digest.update(row["bytes"])
                for place, data in reader.feed(row["bytes"]):
                    chars[place] += _chars(data)
                    rows.append((*key, 0, n, form, place, at, data, None, None, None))
                    at, held = at + 1, held + len(data)
        if held > 1 << 20 or len(rows) > 10_000:
            yield _batch(rows, _RESTORED)
            rows, held = [], 0
    yield _batch(rows, _RESTORED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over pieces in the order of the text: a row for each document."""
    rows, digest = [], hashlib.sha256()
    for key, row in _documents(batches, ["place", "at"]):
        if row is None:
            digest = hashlib.sha256()
        elif row["place"] < 3:
            digest.update(row["bytes"])
        else:
            rows += [(key[0], row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output_sha256"], digest.hexdigest())] * row["copies"]
        while len(rows) >= 10_000:
            yield _batch(rows[:10_000], _DIGESTS)
            rows = rows[10_000:]
    yield _batch(rows, _DIGESTS)


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[bytes] = []
    for key, row in _documents(batches, ["at"]):
        if row is None:
            for _ in range(copies):
                yield _batch([(key[0], n, form, b"".join(parts).decode())], ["doc_id", "n", "form", "output"])
            parts = []
        else:
            copies = (copies if row["at"] or not row["new"] else 0) + (row["copies"] if row["at"] == 0 else 0)
            n, form = row["n"], row["form"]
            if row["new"]:
                parts.append(row["bytes"])


def fim_pieces(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, piece_bytes: int = 64 << 10) -> DataFrame:
    """Pieces of the outputs: doc_id, a, b (128 bits of the text), copies, n, form, at and bytes; a document's lie in one partition, by at.

    ``rate`` of 100 documents are rearranged, ``spm`` of 100 of them with the suffix first. The text is plain where it is empty or
    has a mark in it. A null text is an empty one. Rows that repeat an id with another text are documents of their own; rows that
    repeat both are ``copies``, and each has a row in results. A null doc_id draws as an empty one. An empty table gives an empty
    result; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(K.tidied(_cut(seed, rate, spm, piece_bytes)), _schema(_PIECE)).repartition(*KEY).sortWithinPartitions(*KEY, "at")


def fim_outputs(pieces: DataFrame) -> DataFrame:
    """doc_id, n, form and the whole ``output`` of each document."""
    return pieces.mapInArrow(_outputs, _schema(["doc_id", "n", "form", "output"]))


def fim_restored(pieces: DataFrame) -> DataFrame:
    """Pieces read back from the outputs, in the order of the text; the last of a document, at place 3, has the output's digest."""
    return pieces.mapInArrow(K.tidied(_read_back), _schema(_RESTORED)).sortWithinPartitions(*KEY, "place", "at")


def fim_round_trip(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, piece_bytes: int = 64 << 10) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain) and the digests of the output and of the text restored from it.

    Edge cases are those of ``fim_pieces``."""
    return fim_restored(fim_pieces(docs, seed, rate, spm, piece_bytes)).mapInArrow(K.tidied(_digests), _schema(_DIGESTS))


FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, string_split(text, chr(10)) AS l,
    length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR right(text, 1) = chr(10) THEN 0 ELSE 1 END AS n,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, CASE WHEN lo = 0 THEN '' WHEN lo = n THEN text ELSE array_to_string(l[1:lo], chr(10)) || chr(10) END AS prefix,
    CASE WHEN hi = 0 THEN '' WHEN hi = n THEN text ELSE array_to_string(l[1:hi], chr(10)) || chr(10) END AS upto FROM k),
s AS (SELECT *, substr(upto, length(prefix) + 1) AS middle, substr(text, length(upto) + 1) AS suffix FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM s
"""
