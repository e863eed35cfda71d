"""BPE encoding and decoding through a distinct-word table (operator 6)."""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelsift.llm import chunks as C
from reelsift.llm import kernels as K
from reelsift.llm.common import bound_batches

#: The white space of Unicode, and the contractions of the pre-tokenizer's pattern.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
OTHER, LETTER, NUMBER, WHITE = range(4)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = WHITE
    return table


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the pieces into which a byte-level pre-tokenizer splits the texts.

    Letters, numbers and other signs form runs, with one space before them if there is one; white space that nothing takes
    stands alone; contractions after an apostrophe are pieces of their own. Pieces do not cross texts.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(point)
    kind = _classes()[point]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(lead, offsets)] = True
    edge[[0, n]] = True
    new = edge[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    begin = new.copy()
    run = np.flatnonzero(new)
    stop = np.append(run[1:], n)
    # White space before more of the same text: its last sign stands apart, and a space goes with what follows.
    last = stop[(kind[run] == WHITE) & ~edge[stop]] - 1
    begin[last] = True
    begin[last[point[last] == 0x20] + 1] = False
    # A lone apostrophe that starts a piece may start a contraction.
    mark = run[(point[run] == 0x27) & (stop - run == 1) & ~edge[stop]]
    mark = mark[begin[mark]]
    mark = mark[kind[mark + 1] == LETTER]
    for tail in CONTRACTIONS:
        fits = mark[mark + len(tail) < n]
        for j, c in enumerate(tail, 1):
            fits = fits[point[fits + j] == ord(c)]
            if j > 1:
                fits = fits[~new[fits + j]]
        after = fits + len(tail) + 1
        begin[fits + 1] = False
        begin[after[after < n]] = True
        mark = np.setdiff1d(mark, fits, assume_unique=True)
    start = lead[begin]
    end = np.append(start[1:], len(data))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def splitter(specials: list[bytes]) -> C.Splitter:
    """pretokens, with special tokens in the text as pieces of their own."""

    def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, found = data.tobytes(), []
        for s in specials:
            at = raw.find(s)
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(s) - 1, "right"):
                    found.append((at, at + len(s)))
                at = raw.find(s, at + len(s))
        if not found:
            return pretokens(data, offsets)
        a, b = np.array(sorted(found)).T
        start, end, _ = pretokens(data, np.unique(np.concatenate([offsets, a, b])))
        i = np.searchsorted(a, start, "right") - 1
        inside = (i >= 0) & (start < b[i])
        start, end = np.concatenate([start[~inside], a]), np.concatenate([end[~inside], b])
        order = np.argsort(start, kind="stable")
        return start[order], end[order], np.searchsorted(offsets, start[order], "right") - 1

    return split


@lru_cache(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def specials_of(path: str) -> list[bytes]:
    return [t.content.encode() for t in _tokenizer(path).get_added_tokens_decoder().values()]


@lru_cache(4)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: bytes of all pieces in id order, and their offsets."""
    # A byte-level vocabulary writes printable Latin-1 bytes as themselves and the others, in order, from U+0100 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    sign = {chr(b): b for b in plain}
    sign |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    tok = _tokenizer(path)
    table = [b""] * tok.get_vocab_size(with_added_tokens=True)
    for word, i in tok.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(sign[c] for c in word) if all(c in sign for c in word) else word.encode()
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in table])])


def _ask(path: str, buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        _, data, offsets = C.docs_of(table)
        return C.Vocabulary(data, offsets, splitter(specials_of(path)), buckets).requests(table.column("chunk")[0].as_py())

    return ask


def _answer(path: str):
    """Encode each distinct word of a bucket once."""

    def answer(table: pa.Table) -> pa.Table:
        tok = _tokenizer(path)
        blobs = [C.from_blob(b) for b in table.column("blob").combine_chunks()]
        words, places = C.distinct_of(blobs)
        words, kind = words.cast(pa.large_string()), pa.large_list(pa.uint32())
        found = [pa.array([x.ids for x in tok.encode_batch_fast(words[i : i + 5_000].to_pylist(), add_special_tokens=False)], kind) for i in range(0, len(words), 5_000)]
        lists = pa.concat_arrays(found) if found else pa.array([], kind)
        return table.drop_columns("blob").append_column("blob", pa.array([C.to_blob(ids=lists.take(pa.array(p))) for p in places], pa.binary()))

    return answer


def ids_of(left: pa.Table, right: pa.Table, path: str, buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids in order, the ids of all texts of a chunk in one array, and their offsets by text."""
    docs, data, offsets = C.docs_of(left)
    vocabulary = C.Vocabulary(data, offsets, splitter(specials_of(path)), buckets)
    answers = C.answers_of(right)
    n = len(offsets) - 1
    if not len(vocabulary.word):
        return docs, np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    lists = answers.column("ids").combine_chunks()
    flat = lists.flatten().to_numpy()
    size = lists.value_lengths().to_numpy()
    begin = np.cumsum(size) - size
    ids, total = [], np.zeros(n + 1, np.int64)
    for i, j in K.slices(vocabulary.to, 1 << 17):
        word = vocabulary.word[vocabulary.to[i] : vocabulary.to[j]]
        many = size[word]
        to = np.append(0, np.cumsum(many))
        ids.append(flat[np.repeat(begin[word] - to[:-1], many) + np.arange(to[-1])])
        total[i + 1 : j + 1] = total[i] + to[vocabulary.to[i + 1 : j + 1] - vocabulary.to[i]]
    return docs, np.concatenate(ids), total


def encode_corpus(docs: DataFrame, tokenizer: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), chunk_bytes: int = 8 << 20, bucket_bytes: int = 24 << 20, ordered: bool = False, end_id: int | None = None) -> DataFrame:
    """Encode every whole text with a byte-level BPE tokenizer file, and decode the ids again.

    Returns ``chunk``, ``doc_id`` and the ``outputs`` among n_tokens, ids (list of int), decoded (string), ids_sha256 (of the
    ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded text in UTF-8), in doc_id order within
    a chunk; chunks are ranges of doc_id if ``ordered``. ``end_id`` is added after each text. A null text counts as empty and gives no ids. Special tokens written in a text become their ids. Rows that
    repeat a doc_id or have none are encoded each; an empty table gives an empty result; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    types = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    bound_batches(docs.sparkSession)
    packed, n = C.chunked(docs, chunk_bytes, ordered)
    buckets = max(1, n * chunk_bytes // bucket_bytes)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        ids_docs, ids, to = ids_of(left, right, path, buckets)
        if end_id is not None:
            ids, to = np.insert(ids, to[1:], end_id), to + np.arange(len(to))
        table, table_to = pieces(path)
        out: dict[str, list] = {k: [] for k in outputs}
        for i in range(len(to) - 1):
            own = ids[to[i] : to[i + 1]]
            if "ids_sha256" in out:
                out["ids_sha256"].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            if "decoded" in out or "decoded_sha256" in out:
                size = table_to[own + 1] - table_to[own]
                where = np.repeat(table_to[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                text = table[where].tobytes()
                if "decoded" in out:
                    out["decoded"].append(text.decode("utf-8", "replace"))
                if "decoded_sha256" in out:
                    out["decoded_sha256"].append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
        if "n_tokens" in out:
            out["n_tokens"] = np.diff(to)
        if "ids" in out:
            out["ids"] = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids.astype(np.int32)))
        where = left.column("chunk")[0].as_py() if left.num_rows else 0
        return pa.table({"chunk": pa.array([where] * len(ids_docs), pa.int32()), "doc_id": ids_docs} | {k: v if isinstance(v, pa.Array) else pa.array(v, types[k][1]) for k, v in out.items()})

    schema = ", ".join(["chunk int", "doc_id long", *(f"{k} {types[k][0]}" for k in outputs)])
    return C.exchange(packed, _ask(path, buckets), _answer(path), join, schema)
