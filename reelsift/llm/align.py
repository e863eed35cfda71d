"""Alignment of two tokenizers' ids over the same bytes (operator 13).

Byte offsets where tokens of both end cut a text into groups. A byte range of a text is a fragment: an open prefix (the tokens up
to its first common end, whose group may have begun before), closed groups, and an open suffix. Fragments compose associatively:
a suffix and the next prefix are one closed group. Ranges of a text that one task has read compose there; those of long texts, cut
where neither tokenizer joins anything, lie in many tasks and compose by a tree reduction over Spark tasks. What is closed leaves
the tree at once, as counts of id pairs and as text for the digest, which a sorted stream takes in the order of the text.

Pairs of ids are counted over the corpus by a grouped sum, and each chunk of documents gets the counts of its own pairs by a join.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm import bpe
from reelsift.llm import kernels as K
from reelsift.llm.chunks import from_blob, to_blob
from reelsift.llm.common import bound_batches, stored

KEY = ["doc_id", "a", "b"]
#: Fragments that one task of the tree reduction composes.
FAN = 8


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(2)
def _first(path: str):
    """The byte-level tokenizer and the byte strings of its ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    data, offsets = bpe.pieces(path)
    return tok, data, offsets


@lru_cache(2)
def _second(path: str):
    """The piece model, the byte strings of its ids, and whether no piece has a space after another sign."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(s[1:-1], 16)]) if model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
    free = all("▁" not in s.lstrip("▁") for s in names)
    return model, np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in table])]), free


@dataclass
class Tokens:
    """Ids of both tokenizers and the byte offsets where they end, in order."""

    ia: np.ndarray
    ea: np.ndarray
    ib: np.ndarray
    eb: np.ndarray

    def within(self, lo: int, hi: int) -> Tokens:
        """Those that end after lo and at hi at the latest."""
        a, b = (np.searchsorted(e, [lo, hi], "right") for e in (self.ea, self.eb))
        return Tokens(self.ia[a[0] : a[1]], self.ea[a[0] : a[1]], self.ib[b[0] : b[1]], self.eb[b[0] : b[1]])

    def __add__(self, more: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip((self.ia, self.ea, self.ib, self.eb), (more.ia, more.ea, more.ib, more.eb))))

    def __bool__(self) -> bool:
        return bool(len(self.ia) or len(self.ib))

    def marks(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The byte before the first end, and for each byte from there on whether a token of the one or the other ends at it."""
        if not self:
            return 0, np.zeros(1, bool), np.zeros(1, bool)
        base = int(min(e[0] for e in (self.ea, self.eb) if len(e))) - 1
        size = int(max(e[-1] for e in (self.ea, self.eb) if len(e))) - base + 1
        a, b = np.zeros(size, bool), np.zeros(size, bool)
        a[self.ea - base], b[self.eb - base] = True, True
        return base, a, b

    def common(self) -> np.ndarray:
        base, a, b = self.marks()
        return np.flatnonzero(a & b) + base

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch between neighbouring ends, which is one overlapping pair: its end and the pair (second id, first id)."""
        base, a, b = self.marks()
        ends = np.flatnonzero(a | b)
        first, second = (np.cumsum(x, dtype=np.int32)[ends] - x[ends] for x in (a, b))
        return ends + base, self.ib[second].astype(np.int64) << 32 | self.ia[first]

    def to_blob(self) -> bytes:
        side = np.repeat(np.array([0, 1], np.int8), [len(self.ia), len(self.ib)])
        return to_blob(side=side, id=np.concatenate([self.ia, self.ib]), end=np.concatenate([self.ea, self.eb]))

    @classmethod
    def of_blob(cls, blob: bytes) -> Tokens:
        side, ids, end = (c.to_numpy() for c in from_blob(blob).columns)
        return cls(ids[side == 0], end[side == 0], ids[side == 1], end[side == 1])


NONE = Tokens(*(np.zeros(0, t) for t in (np.int32, np.int64, np.int32, np.int64)))


@lru_cache(1)
def _digits(n: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    text = [b"%d," % i for i in range(n)]
    return np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)])


def groups_text(t: Tokens, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups as bytes, ``a1,a2|b1;a3|b2,b3;``, and where each group ends in them. Tokens end at the last common end."""
    table, offsets = _digits()
    base, a, b = t.marks()
    both = a & b
    upto = np.cumsum(both, dtype=np.int32) - both  # common ends before each byte
    ga, gb = upto[t.ea - base], upto[t.eb - base]
    n_a, n_b = (np.bincount(g, minlength=len(common)) for g in (ga, gb))
    ids = np.empty(len(ga) + len(gb), np.int32)
    mark = np.full(len(ids), ord(","), np.uint8)
    at_a, at_b = np.arange(len(ga)) + (np.cumsum(n_b) - n_b)[ga], np.arange(len(gb)) + np.cumsum(n_a)[gb]
    ids[at_a], ids[at_b] = t.ia, t.ib
    mark[at_a[np.append(ga[1:] != ga[:-1], True)[: len(ga)]]] = ord("|")
    last = at_b[np.append(gb[1:] != gb[:-1], True)[: len(gb)]]
    mark[last] = ord(";")
    size = offsets[ids + 1] - offsets[ids]
    to = np.cumsum(size)
    out = table[np.repeat(offsets[ids] - to + size, size) + np.arange(to[-1] if len(to) else 0)]
    out[to - 1] = mark
    return out, to[last]


@dataclass
class Fragment:
    """A byte range of a text: open prefix, open suffix, whether it has a common end, and what closed in it: end of the first
    group, groups, links, text and pairs."""

    head: Tokens
    tail: Tokens
    closed: bool
    out: list[tuple[int, int, int, bytes, np.ndarray]] = field(default_factory=list)

    @classmethod
    def of(cls, t: Tokens) -> Fragment:
        common = t.common()
        if not len(common):
            return cls(t, NONE, False)
        got = cls(t.within(-1, common[0]), t.within(common[-1], 1 << 62), True)
        if len(common) > 1:
            got.out.append(_closed(t.within(common[0], common[-1]), common[1:]))
        return got

    def __add__(self, y: Fragment) -> Fragment:
        out = self.out + y.out
        if not y.closed:
            return Fragment(self.head, self.tail + y.head, True, out) if self.closed else Fragment(self.head + y.head, NONE, False, out)
        if not self.closed:
            return Fragment(self.head + y.head, y.tail, True, out)
        group = self.tail + y.head
        return Fragment(self.head, y.tail, True, [*out, _closed(group, group.common())])

    def ended(self) -> list[tuple[int, int, int, bytes, np.ndarray]]:
        """All that is closed in a whole text: its start and its end are common."""
        if self.tail:
            raise ValueError("a text ends where both tokenizers' tokens do")
        return [*self.out, _closed(self.head, self.head.common())] if self.head else self.out


def _closed(t: Tokens, common: np.ndarray) -> tuple[int, int, int, bytes, np.ndarray]:
    ends, pairs = t.links()
    return int(common[0]), len(common), len(ends), groups_text(t, common)[0].tobytes(), pairs


def _by_word(data: np.ndarray, start: np.ndarray, end: np.ndarray, encode: Callable[[list[bytes]], Iterator[list[int]]], table: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and ends of the tokens of all words, each distinct one encoded once, and whether each word's bytes are those of its tokens."""
    coded = K.strings(data, start, end).dictionary_encode()
    flat, word_to = K.flat(coded.dictionary)
    lists = list(encode(coded.dictionary.to_pylist()))
    count = np.fromiter(map(len, lists), np.int32, len(lists))
    begin = np.append(0, np.cumsum(count))
    ids = np.fromiter(chain.from_iterable(lists), np.int32, int(begin[-1]))
    size = offsets[ids + 1] - offsets[ids]
    to = np.append(0, np.cumsum(size))
    own = table[np.repeat(offsets[ids] - to[:-1], size) + np.arange(to[-1])]
    bad = to[begin[1:]] - to[begin[:-1]] != np.diff(word_to)
    if bad.any() or not np.array_equal(own, flat):
        bad |= np.array([own[to[begin[i]] : to[begin[i + 1]]].tobytes() != flat[word_to[i] : word_to[i + 1]].tobytes() for i in range(len(count))], bool)
    word = coded.indices.to_numpy()
    many = count[word]
    after = np.cumsum(many, dtype=np.int64)
    where = np.repeat((begin[word] - after + many).astype(np.int32), many)
    where += np.arange(len(where), dtype=np.int32)
    ends = np.repeat(start - to[begin[word]], many)
    ends += to[1:][where]
    return ids[where], ends, ~bad[word]


def tokenise(data: np.ndarray, offsets: np.ndarray, first: str, second: str) -> tuple[Tokens, np.ndarray]:
    """Tokens of the texts of a buffer, which begin with their space, and which texts have all their bytes in both."""
    tok, table_a, to_a = _first(first)
    model, table_b, to_b, free = _second(second)
    lone = model.piece_to_id("▁")
    start, end, text = bpe.pretokens(data, offsets)
    ia, ea, fine = _by_word(data, start, end, lambda w: (x.ids for i in range(0, len(w), 5_000) for x in tok.encode_batch_fast([s.decode() for s in w[i : i + 5_000]], add_special_tokens=False)), table_a, to_a)
    good = np.bincount(text[~fine], minlength=len(offsets) - 1) == 0
    # The model puts the space before a text itself.
    cut = np.zeros(len(data) + 1, bool)
    if free:
        cut[:-1] = (data == 32) & np.append(True, data[:-1] != 32)[: len(data)]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    start, end = edges[:-1], edges[1:]
    ib, eb, fine = _by_word(data, start, end, lambda w: (x or [lone] for i in range(0, len(w), 20_000) for x in model.encode([s[1:].decode() for s in w[i : i + 20_000]], num_threads=1)), table_b, to_b)
    good &= np.bincount(np.searchsorted(offsets, start[~fine], "right") - 1, minlength=len(offsets) - 1) == 0
    return Tokens(ia, ea, ib, eb), good


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each."""
    return np.insert(data, offsets[:-1], 32), offsets + np.arange(len(offsets))


DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
CHUNK = "doc_id long, a long, b long, chunk long, pairs array<long>, ns array<long>, docs binary"
_LONGS = pa.list_(pa.int64())


def _chunk(key: tuple, docs: dict[str, list], pairs: list[np.ndarray], of: list[np.ndarray], n: int) -> pa.RecordBatch:
    """A chunk's distinct pairs with their numbers, and its documents with the places of their own pairs among them."""
    pair, doc = np.concatenate(pairs or [np.zeros(0, np.int64)]), np.concatenate(of or [np.zeros(0, np.int64)])
    distinct, at, count = np.unique(pair, return_inverse=True, return_counts=True)
    width = max(1, len(distinct))
    own, k = np.unique(doc * width + at, return_counts=True)
    to = np.searchsorted(own, np.arange(n + 1) * width)
    lists = lambda x: pa.LargeListArray.from_arrays(pa.array(to), pa.array(x.astype(np.int32)))
    table = to_blob(**{c: pa.array(docs[c], pa.string() if c == "groups_sha256" else pa.int64()) for c in DOC}, steps=lists(np.diff(own % width, prepend=0)), k=lists(k))
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([int.from_bytes(os.urandom(8), "little", signed=True)]), pa.array([distinct], _LONGS), pa.array([count], _LONGS), pa.array([table], pa.binary())], names=[*KEY, "chunk", "pairs", "ns", "docs"])


def _align(first: str, second: str, chunk_bytes: int, slice_bytes: int = 2 << 20):
    """Whole texts, many at a time: chunks with all documents' results but for what the corpus knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, pairs, of, n, held = {c: [] for c in DOC}, [], [], 0, 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data, offsets = K.flat(batch.column("text"))
            for i, j in K.slices(offsets, slice_bytes):
                part, to = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                some = np.diff(to) > 0
                own, at = spaced(part, np.append(0, to[1:][some]))
                t, good = tokenise(own, at, first, second)
                if not good.all():
                    good_a, good_b = (good[np.searchsorted(at, e) - 1] for e in (t.ea, t.eb))
                    t = Tokens(t.ia[good_a], t.ea[good_a], t.ib[good_b], t.eb[good_b])
                common = t.common()
                text, ends = groups_text(t, common)
                ends = np.append(0, ends)
                stop, pair = t.links()
                each = lambda x: np.diff(np.searchsorted(x, at, "right"))
                counts = np.zeros((4, j - i), np.int64)
                counts[:, some] = [each(t.ea), each(t.eb), each(common), each(stop)]
                upto, digest, raw = np.append(0, np.cumsum(counts[2])), [], text.tobytes()
                for d in range(j - i):
                    digest.append(hashlib.sha256(raw[ends[upto[d]] : ends[upto[d + 1]] - 1]).hexdigest() if upto[d + 1] > upto[d] else "")
                for c, x in zip(DOC, (ids[i:j], *counts.tolist(), digest)):
                    docs[c] += x
                pairs.append(pair), of.append(np.repeat(np.arange(n, n + j - i), counts[3]))
                n, held = n + j - i, held + len(part)
                if held >= chunk_bytes:
                    yield _chunk((None,) * 3, docs, pairs, of, n)
                    docs, pairs, of, n, held = {c: [] for c in DOC}, [], [], 0, 0
        if n:
            yield _chunk((None,) * 3, docs, pairs, of, n)

    return run


PIECE = "doc_id long, a long, b long, no long, base long, bytes binary"


def _pieces(size: int):
    """Long texts cut before spaces that follow a printable ASCII sign: there neither tokenizer joins anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                digest = hashlib.blake2b(data, digest_size=16).digest()
                key = (doc, *(int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8)))
                safe = np.flatnonzero((data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)) + 1
                cuts = [0]
                while (k := np.searchsorted(safe, cuts[-1] + size)) < len(safe):
                    cuts.append(int(safe[k]))
                cuts.append(len(data))
                for no, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    own = data[lo:hi].tobytes()
                    row = (*key, no, lo + 1 if no else 0, own if no else b" " + own)
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if i == 5 else pa.int64()) for i, x in enumerate(row)], names=[c.split()[0] for c in PIECE.split(", ")])

    return run


#: A fragment has head, tail and closed; what closed has end, text, n_groups and its chunk's columns; bad: bytes that aren't the text's.
PART = CHUNK + ", copies long, no long, bad boolean, head binary, tail binary, closed boolean, end long, text binary, n_a long, n_b long, n_groups long, n_links long"
_PART = {c.split()[0]: {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": _LONGS}[c.split()[1]] for c in PART.split(", ")}


def _part(key: tuple, **columns) -> pa.RecordBatch:
    row = dict(zip(KEY, key)) | columns
    return pa.RecordBatch.from_arrays([pa.array([row.get(c)], t) for c, t in _PART.items()], names=list(_PART))


def _closed_parts(key: tuple, copies: int, out: list[tuple]) -> Iterator[pa.RecordBatch]:
    for end, groups, links, text, pairs in out:
        docs = {"doc_id": [key[0]], "n_a": [0], "n_b": [0], "n_groups": [0], "n_links": [0], "groups_sha256": [None]}
        chunk = _chunk(key, docs, [pairs], [np.zeros(len(pairs), np.int64)], 1)
        own = {c: chunk.column(c)[0].as_py() for c in ("chunk", "pairs", "ns", "docs")}
        yield _part(key, copies=copies, end=end, text=text, n_groups=groups, n_links=links, **own | {"ns": [n * copies for n in own["ns"]]})


def _fragments(first: str, second: str, range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                key, data = tuple(row[c] for c in KEY), np.frombuffer(row["bytes"], np.uint8)
                t, good = tokenise(data, np.array([0, len(data)]), first, second)
                if not good.all():
                    yield _part(key, copies=row["copies"], no=row["no"], bad=True)
                    continue
                t = Tokens(t.ia, t.ea + row["base"], t.ib, t.eb + row["base"])
                cuts = [row["base"], *range((row["base"] // range_bytes + 1) * range_bytes, row["base"] + len(data), range_bytes), row["base"] + len(data)]
                f = reduce(Fragment.__add__, (Fragment.of(t.within(lo, hi)) for lo, hi in zip(cuts, cuts[1:])))
                yield from _closed_parts(key, row["copies"], f.out)
                yield _part(key, copies=row["copies"], no=row["no"], bad=False, head=f.head.to_blob(), tail=f.tail.to_blob(), closed=f.closed, n_a=len(t.ia), n_b=len(t.ib))

    return run


def _compose(table: pa.Table) -> pa.Table:
    """Neighbouring fragments as one, and what closed as they met."""
    rows = sorted(table.to_pylist(), key=lambda r: r["no"])
    own = tuple(rows[0][c] for c in KEY)
    f = reduce(Fragment.__add__, (Fragment(Tokens.of_blob(r["head"]), Tokens.of_blob(r["tail"]), r["closed"]) for r in rows))
    copies = rows[0]["copies"]
    whole = _part(own, copies=copies, no=rows[0]["no"] // FAN, bad=False, head=f.head.to_blob(), tail=f.tail.to_blob(), closed=f.closed, n_a=sum(r["n_a"] for r in rows), n_b=sum(r["n_b"] for r in rows))
    return pa.Table.from_batches([*_closed_parts(own, copies, f.out), whole])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            f, key = Fragment(Tokens.of_blob(r["head"]), Tokens.of_blob(r["tail"]), r["closed"]), tuple(r[c] for c in KEY)
            yield from _closed_parts(key, r["copies"], f.ended())
            yield _part(key, bad=False, n_a=r["n_a"], n_b=r["n_b"], n_groups=0, n_links=0)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the texts of groups in order: the digest of each document, without the last sign."""
    key, digest, rest, rows = None, None, b"", []
    end = lambda: (*key, (digest.update(rest[:-1]), digest.hexdigest())[1])
    for batch in batches:
        for row in (r for i in range(0, batch.num_rows, 500) for r in batch.slice(i, 500).to_pylist()):
            own = tuple(row[c] for c in KEY)
            if own != key:
                if key is not None:
                    rows.append(end())
                key, digest, rest = own, hashlib.sha256(), b""
            digest.update(rest)
            rest = row["text"]
    if key is not None:
        rows.append(end())
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(list(zip(*rows)) or [()] * 4)], names=[*KEY, "groups_sha256"])


RESULT = "doc_id long, a long, b long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _known(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's documents with sums over the corpus counts of their pairs."""
    right = right.sort_by("pos")
    n, best = right.column("n").to_numpy(), right.column("best").to_numpy()
    tables = []
    for row in left.to_pylist():
        docs = from_blob(row["docs"]).combine_chunks()
        lists = docs.column("k").combine_chunks()
        size, k = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().astype(np.int64)
        at, of = np.cumsum(docs.column("steps").combine_chunks().flatten().to_numpy(), dtype=np.int64), np.repeat(np.arange(len(size)), size)
        # Sums of integers, exact beyond what a double holds.
        sums = [np.diff(np.append(0, np.cumsum(x))[np.append(0, np.cumsum(size))]) for x in (k * best[at], k * n[at])]
        columns = {c: docs.column(c) for c in DOC}
        keys = {"doc_id": columns["doc_id"], "a": pa.array([row["a"]] * len(size), pa.int64()), "b": pa.array([row["b"]] * len(size), pa.int64())}
        tables.append(pa.table(keys | {c: columns[c] for c in DOC[1:5]} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": columns["groups_sha256"]}))
    K.tidy()
    return pa.concat_tables(tables) if tables else pa.schema([(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in RESULT.split(", ")]).empty_table()


def with_counts(chunks: DataFrame) -> DataFrame:
    """The chunks' documents with n_best and count_sum. A pair's count is a grouped sum; the highest count of a second id is a
    row for each id of its vocabulary, which bounds what is broadcast."""
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "ns")).alias("pos", "p")).select("chunk", "pos", F.col("p.pairs").alias("pair"), F.col("p.ns").alias("k"))
    counts = stored(asked.groupBy("pair").agg(F.sum("k").alias("n")), "pairs")
    most = counts.groupBy(F.shiftright("pair", 32).alias("second")).agg(F.max("n").alias("most"))
    counts = counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("second")).select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    answers = asked.join(counts, "pair").select(F.col("chunk").alias("of"), "pos", "n", "best")
    return chunks.select("chunk", "a", "b", "docs").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_known, RESULT)


def align_corpus(docs: DataFrame, first: str | None = None, second: str | None = None, piece_bytes: int = 64 << 10, range_bytes: int = 32 << 10, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Groups and links between the tokens of two tokenizers for each whole text, with a space before it.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their second id), count_sum (of counts
    over links) and groups_sha256 (of ``a1,a2|b1;...``). Texts of over ``piece_bytes`` are cut and composed again. A null or empty
    text, or one whose bytes the tokens don't give back, has no tokens: zeros and an empty digest. Rows that repeat a doc_id, or
    have none, have a row each; an empty table gives an empty result; other columns are ignored.
    """
    first, second = first or bpe.default_tokenizer(), second or default_pieces()
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > piece_bytes, F.lit(False))
    chunks = stored(rows.where(~is_long).mapInArrow(K.tidied(_align(first, second, chunk_bytes)), CHUNK), "chunks")
    pieces = rows.where(is_long).mapInArrow(K.tidied(_pieces(piece_bytes)), PIECE)
    # Each piece once, dealt out over all tasks; copies of a row have its key, count as often and come back as rows at the end.
    pieces = pieces.groupBy(*KEY, "no").agg(F.first("base").alias("base"), F.first("bytes").alias("bytes"), F.count("*").alias("copies"))
    pieces = stored(pieces, "pieces")
    parts = [stored(pieces.mapInArrow(K.tidied(_fragments(first, second, range_bytes)), PART), "fragments")]
    rejected = stored(parts[0].where("bad").select(*KEY).distinct(), "rejected")
    same = lambda x, y: x.join(y, [x[c].eqNullSafe(y[c]) for c in KEY], "left_anti")
    now, span = same(parts[0].where("head is not null"), rejected), (pieces.agg(F.max("no")).first()[0] or 0) + 1
    while span > 1:
        made = stored(now.groupBy(*KEY, F.floor(F.col("no") / FAN).alias("g")).applyInArrow(_compose, PART), "fragments")
        parts.append(made)
        now, span = made.where("head is not null"), -(-span // FAN)
    parts.append(stored(now.mapInArrow(K.tidied(_ended), PART), "fragments"))
    closed = same(reduce(DataFrame.union, [p.where("text is not null") for p in parts]), rejected)
    results = stored(with_counts(chunks.union(closed.select(chunks.columns))), "results")
    short = results.where("a is null").drop("a", "b")
    digests = closed.select(*KEY, "end", "text").repartition(*KEY).sortWithinPartitions(*KEY, "end").mapInArrow(K.tidied(_digest), "doc_id long, a long, b long, groups_sha256 string")
    total = closed.select(*KEY, "n_groups", "n_links").union(parts[-1].where("text is null").select(*KEY, F.lit(0), F.lit(0))).groupBy(*KEY).agg(F.sum("n_groups").alias("n_groups"), F.sum("n_links").alias("n_links"))
    sums = results.where("a is not null").groupBy(*KEY).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    tokens = parts[-1].where("text is null").select(*KEY, "n_a", "n_b")
    whole = pieces.where("no = 0").select(*KEY, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    for i, more in enumerate((tokens, total, sums, digests)):
        more = more.select(*[F.col(c).alias(f"{c}_{i}") for c in KEY], *[c for c in more.columns if c not in KEY])
        whole = whole.join(more, [F.col(c).eqNullSafe(F.col(f"{c}_{i}")) for c in KEY], "left").drop(*[f"{c}_{i}" for c in KEY])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return short.union(whole.select("doc_id", *map(zero, ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")))
