"""Hidden Markov language model of a corpus (operator 2).

A latent state emits a class of words, a function of a word's last letters, and the class emits the word by its count in
the corpus. Baum-Welch counts of states and classes are summed over the partitions; word counts come from the distinct-word
exchange. The scaled forward recursion gives the exact likelihood of a whole text, over all state sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm import chunks as C
from reelsift.llm import kernels as K
from reelsift.llm.common import bound_batches, stored

STATES, CLASSES, ITERATIONS = 8, 1024, 2
END = b" "  # no word holds a space
_CELL = "cell int, value double"


def held_out(ids: pa.Array, folds: int = 10) -> np.ndarray:
    """crc32 of doc_id as text, modulo the folds, is 0. A null doc_id counts as the empty text, and so is held out."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == 0 for i in ids.to_pylist()], bool)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return K.words(data, offsets)


def classes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, classes: int) -> np.ndarray:
    """A word's class: its last three bytes, hashed. The last class is the end token's."""
    size = np.minimum(end - start, 3)
    value = size.astype(np.uint64)
    for k in (1, 2, 3):
        value = value << np.uint64(8) | np.where(size >= k, data[np.maximum(end - k, start)], 0).astype(np.uint64)
    return (K.mix(value) % np.uint64(classes - 1)).astype(np.int32)


def sequences(data: np.ndarray, offsets: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class sequences of all texts one after another, each with the end token, and their offsets."""
    start, end, text = K.words(data, offsets)
    of = classes_of(data, start, end, classes)
    to = np.searchsorted(text, np.arange(len(offsets)))
    return np.insert(of, to[1:], classes - 1), to + np.arange(len(to))


class Model:
    """Start and transition probabilities, and emission of classes by state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (K,), (K, K), (K, C)

    @classmethod
    def first(cls, states: int, classes: int) -> Model:
        r = np.random.default_rng(7)
        norm = lambda x: x / x.sum(-1, keepdims=True)
        # Sticky states with emissions far apart: near-equal ones would take many iterations to part.
        return cls(np.full(states, 1 / states), norm(np.eye(states) + 0.002), norm(r.gamma(0.3, 1, (states, classes)) + 0.02))

    @classmethod
    def of_counts(cls, cells: np.ndarray, states: int, classes: int) -> Model:
        """Expected counts, smoothed: every class keeps some probability in every state."""
        norm = lambda x: x / x.sum(-1, keepdims=True)
        a, b = states, states + states * states
        emit = cells[b:].reshape(states, classes)
        prior = (emit.sum(0) + 0.1) / (emit.sum() + 0.1 * classes)
        return cls(norm(cells[:a] + 1), norm(cells[a:b].reshape(states, states) + 0.1), norm(emit + 10 * prior))


def _padded(seq: np.ndarray, to: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences ``order``, longest first, as columns; and how many are still running at each step."""
    size = (to[1:] - to[:-1])[order]
    running = np.searchsorted(-size, -np.arange(size[0]), "left")
    grid = np.zeros((size[0], len(order)), np.int32)
    col = np.repeat(np.arange(len(order)), size)
    row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    grid[row, col] = seq[np.repeat(to[order], size) + row]
    return grid, running


def _batches(to: np.ndarray, tokens: int) -> Iterator[np.ndarray]:
    order = np.argsort(-(to[1:] - to[:-1]), kind="stable")
    size = (to[1:] - to[:-1])[order]
    cut = np.searchsorted(np.cumsum(size), np.arange(tokens, size.sum() + tokens, tokens))
    for part in np.split(order, np.unique(cut[cut < len(order)])):
        if len(part):
            yield part


def log_likelihood(model: Model, seq: np.ndarray, to: np.ndarray) -> np.ndarray:
    """log10 probability of each class sequence by the scaled forward recursion."""
    out = np.zeros(len(to) - 1)
    emit = np.ascontiguousarray(model.emit.T)
    for order in _batches(to, 2_000_000):
        order = order[(to[1:] - to[:-1])[order] > 0]
        if not len(order):
            continue
        size = (to[1:] - to[:-1])[order]
        live = np.searchsorted(-size, -np.arange(size[0]), "left")
        begin, sums = to[order], np.zeros(len(order))
        alpha = None
        for t, n in enumerate(live):
            b = emit[seq[begin[:n] + t]]
            alpha = model.start * b if alpha is None else (alpha[:n] @ model.move) * b
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            sums[:n] += np.log10(scale)
        out[order] = sums
    return out


def _segments(to: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the segments of all sequences, the number of each in its sequence, and the sequence of each."""
    parts = -(-(to[1:] - to[:-1]) // segment)
    of = np.repeat(np.arange(len(parts)), parts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.append(to[:-1][of] + number * segment, to[-1]), number, of


def _transfers(model: Model, seq: np.ndarray, cuts: np.ndarray, wanted: np.ndarray, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """For each segment, but for a factor, the probability of its tokens and last state given the state before it."""
    states = len(move)
    out = np.zeros((len(cuts) - 1, states, states), np.float32)
    out[:] = np.eye(states, dtype=np.float32)
    pick = np.flatnonzero(wanted)
    size = cuts[pick + 1] - cuts[pick]
    order = pick[np.argsort(-size, kind="stable")]
    for i in range(0, len(order), 256):
        own = order[i : i + 256]
        begin, size = cuts[own], cuts[own + 1] - cuts[own]
        live = np.searchsorted(-size, -np.arange(size[0]), "left")
        for t, n in enumerate(live):
            now = (out[own[:n]].reshape(-1, states) @ move).reshape(n, states, states) * emit[seq[begin[:n] + t]][:, None, :]
            out[own[:n]] = now / now.sum((1, 2), keepdims=True)
    return out


def expected_counts(model: Model, seq: np.ndarray, to: np.ndarray, segment: int = 1024) -> np.ndarray:
    """Baum-Welch counts of all sequences, each as a whole: starts, moves and emissions.

    Long sequences are worked on in segments side by side. What a segment does to the distribution of states is a matrix; their
    products give the distribution before each segment and the weight of what follows it, so the counts are those of the whole.
    """
    states, classes = model.emit.shape
    cuts, number, of = _segments(to, segment)
    emit, move = np.ascontiguousarray(model.emit.T.astype(np.float32)), model.move.astype(np.float32)
    start = model.start.astype(np.float32)
    last = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
    before, after = np.zeros((len(of), states), np.float32), np.ones((len(of), states), np.float32)
    if number.any():
        many = ~last | (number > 0)
        across = _transfers(model, seq, cuts, many & (number > 0), emit, move)
        rows = np.flatnonzero(many & (number == 0))
        before_next = _first_ends(model, seq, cuts, rows, emit, move, start)
        while len(rows):  # over the segments of all long sequences, number by number
            going = ~last[rows]
            rows, before_next = rows[going] + 1, before_next[going]
            before[rows] = before_next
            before_next = np.einsum("ni,nij->nj", before_next, across[rows])
            before_next /= before_next.sum(1, keepdims=True)
        rows = np.flatnonzero(many & last & (number > 0))
        while len(rows):
            onto = np.einsum("nij,nj->ni", across[rows], after[rows])
            rows = rows - 1
            after[rows] = onto / onto.sum(1, keepdims=True)
            rows = rows[number[rows] > 0]
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
    for order in _batches(cuts, 300_000):
        grid, live = _padded(seq, cuts, order)
        first = number[order] == 0
        alpha, scale = [], []
        for t, n in enumerate(live):
            b = emit[grid[t, :n]]
            a = np.where(first[:, None], start, before[order] @ move) * b if t == 0 else (alpha[-1][:n] @ move) * b
            c = a.sum(1, keepdims=True)
            alpha.append(a / c), scale.append(c)
        beta, shares = None, [None] * len(live)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            m = live[t + 1] if t + 1 < len(live) else 0
            now = np.empty((n, states), np.float32)
            if m:
                onward = emit[grid[t + 1, :m]] * beta / scale[t + 1]
                moves += alpha[t][:m].T @ onward
                now[:m] = onward @ move.T
            ends = after[order[m:n]]
            now[m:] = ends / (alpha[t][m:n] * ends).sum(1, keepdims=True)
            beta = now
            shares[t] = alpha[t] * beta
        # The step from the segment before.
        later = np.flatnonzero(~first)
        moves += before[order[later]].T @ (emit[grid[0, later]] * beta[later] / scale[0][later])
        symbols = np.concatenate([grid[t, :n] for t, n in enumerate(live)])
        share = np.concatenate(shares)
        for k in range(states):
            emits[k] += np.bincount(symbols, share[:, k], classes)
        starts += shares[0][first].sum(0)
    return np.concatenate([starts, (moves * model.move).ravel(), emits.ravel()])


def _first_ends(model: Model, seq: np.ndarray, cuts: np.ndarray, rows: np.ndarray, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The distribution of states at the end of the first segment of long sequences; these are all of one length."""
    a = None
    for t in range(int(cuts[rows[0] + 1] - cuts[rows[0]]) if len(rows) else 0):
        b = emit[seq[cuts[rows] + t]]
        a = start * b if a is None else (a @ move) * b
        a /= a.sum(1, keepdims=True)
    return a if a is not None else np.zeros((0, len(move)), np.float32)


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.flat(column)
    return K.LOWER[data], offsets


def train(docs: DataFrame, folds: int = 10, states: int = STATES, classes: int = CLASSES, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over all documents that aren't held out. Each iteration is one pass; tasks give sums of a fixed size."""
    model = Model.first(states, classes)
    rows = docs.select("doc_id", "text")
    for _ in range(iterations):

        def count(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            cells = np.zeros(states + states * states + states * classes)
            for batch in batches:
                data, offsets = _lowered(batch.column("text").filter(pa.array(~held_out(batch.column("doc_id"), folds))))
                for i, j in K.slices(offsets, 4 << 20):
                    cells += expected_counts(model, *sequences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], classes))
            some = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(cells[some])], names=["cell", "value"])

        sums = rows.mapInArrow(K.tidied(count), _CELL).groupBy("cell").agg(F.sum("value").alias("value")).collect()
        cells = np.zeros(states + states * states + states * classes)
        for r in sums:
            cells[r.cell] = r.value
        model = Model.of_counts(cells, states, classes)
    return model


def _ask(buckets: int, folds: int):
    def ask(table: pa.Table) -> pa.Table:
        ids, data, offsets = C.docs_of(table)
        data = K.LOWER[data]
        vocabulary = C.Vocabulary(data, offsets, _tokens, buckets)
        learn = ~held_out(ids, folds)
        n = np.bincount(vocabulary.word[np.repeat(learn, np.diff(vocabulary.to))], minlength=len(vocabulary.words)).astype(np.int64)
        K.tidy()
        return vocabulary.requests(table.column("chunk")[0].as_py(), n=n)

    return ask


def _answer(classes: int):
    """Sum the counts of each distinct word; also the distinct words and tokens of each class, as a row of chunk -1."""

    def answer(table: pa.Table) -> pa.Table:
        blobs = [C.from_blob(b) for b in table.column("blob").combine_chunks()]
        words, places = C.distinct_of(blobs)
        count = np.zeros(len(words), np.int64)
        for b, p in zip(blobs, places):
            np.add.at(count, p, b.column("n").to_numpy())
        data, offsets = K.flat(words)
        of = classes_of(data, offsets[:-1], offsets[1:], classes)
        known = count > 0
        stats = C.to_blob(distinct=np.bincount(of[known], minlength=classes), tokens=np.bincount(of, count, classes).astype(np.int64))
        out = [C.to_blob(n=count[p]) for p in places]
        K.tidy()
        return pa.table({"bucket": pa.concat_arrays([*table.column("bucket").chunks, pa.array([table.column("bucket")[0].as_py()], pa.int32())]), "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int32()), "blob": pa.array([*out, stats], pa.binary())})

    return answer


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.column("blob"):
            t = C.from_blob(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(t.num_rows), pa.int32()), t.column("distinct").combine_chunks(), t.column("tokens").combine_chunks()], names=["cell", "distinct", "tokens"])


def score_corpus(docs: DataFrame, folds: int = 10, states: int = STATES, classes: int = CLASSES, iterations: int = ITERATIONS, chunk_bytes: int = 8 << 20, bucket_bytes: int = 24 << 20) -> DataFrame:
    """Score all whole texts by a hidden Markov model that learns from those not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10 by smoothed word counts alone) and score
    (log10 probability of the text under the model). A null text is an empty one: its end token alone is scored. A null
    doc_id is held out. Rows that repeat a doc_id are scored each; an empty table gives an empty result; other columns are
    ignored. With nothing to learn from, all words are unknown and the model stays as it began.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    model = train(docs, folds, states, classes, iterations)
    packed, n = C.chunked(docs, chunk_bytes)
    buckets = max(1, n * chunk_bytes // bucket_bytes)
    replies = stored(packed.groupBy("chunk").applyInArrow(_ask(buckets, folds), C.REQUEST).groupBy("bucket").applyInArrow(_answer(classes), C.REQUEST), "counts")
    distinct, tokens = np.zeros(classes), np.zeros(classes)
    for r in replies.where("chunk = -1").select("blob").mapInArrow(_stats, "cell int, distinct long, tokens long").groupBy("cell").agg(F.sum("distinct").alias("d"), F.sum("tokens").alias("t")).collect():
        distinct[r.cell], tokens[r.cell] = r.d, r.t
    ends = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds != 0).count()
    distinct[-1], tokens[-1] = ends > 0, ends
    total, types = tokens.sum(), distinct.sum()
    in_class = np.log10(tokens + 0.1 * (distinct + 1))

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, data, offsets = C.docs_of(left)
        data = K.LOWER[data]
        vocabulary = C.Vocabulary(data, offsets, _tokens, buckets)
        right = C.answers_of(right)
        count = right.column("n").to_numpy() if right.num_columns else np.zeros(0, np.int64)
        c = count[vocabulary.word]
        words, ends_at = K.flat(vocabulary.words)
        of = classes_of(words, ends_at[:-1], ends_at[1:], classes)[vocabulary.word]
        to = vocabulary.to
        # The end token comes last; in the model it is its class's only word.
        seq, seq_to = np.insert(of, to[1:], classes - 1), to + np.arange(len(to))
        c = np.insert(c, to[1:], ends)
        log_c = np.log10(c + 0.1)
        by_text = lambda x: np.add.reduceat(x, seq_to[:-1]) if len(x) else np.zeros(0)
        word = log_c - in_class[seq]
        word[seq_to[1:] - 1] = 0
        K.tidy()
        base = by_text(log_c - np.log10(total + 0.1 * (types + 1)))
        return pa.table({"doc_id": ids, "held_out": pa.array(held_out(ids, folds)), "n_tokens": pa.array(np.diff(seq_to)), "n_known": pa.array(by_text((c > 0).astype(np.int64)).astype(np.int64)), "train_tokens": pa.array([int(total)] * len(ids), pa.int64()), "base_score": pa.array(base), "score": pa.array(log_likelihood(model, seq, seq_to) + by_text(word))})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("chunk").cogroup(replies.where("chunk >= 0").groupBy("chunk")).applyInArrow(join, schema)
