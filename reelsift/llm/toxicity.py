"""Toxicity by weak supervision (operator 8).

Voters are words and word beginnings that labelled documents set apart, and patterns of writing. A generative label model
estimates how often each votes on toxic and on other documents and how far voters repeat each other; its posterior labels,
not the labels themselves, train a linear classifier on the voters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsift.llm import kernels as K
from reelsift.llm.common import bound_batches, stored

#: Bound of what the model is fitted on: labelled rows (by a hash of doc_id).
MAX_TRAIN = 10_000
BEGINNINGS = (4, 5, 6)
PATTERNS = ("shouting", "exclaiming", "signs", "digits", "repeating")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters, A-Z in lower case) and of their first letters' bytes, and their text numbers."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid, edge = _LETTER[data], np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & np.append(True, ~solid[:-1] | edge[1:-1]))
    end = np.flatnonzero(solid & np.append(~solid[1:] | edge[1:-1], True)) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    hashes = K.Hashes(K.LOWER[data])
    out, of = [hashes.of(start, end)], [text]
    for size in BEGINNINGS:
        long = end - start > size
        out.append(hashes.of(start[long], start[long] + size) + np.uint64(size)), of.append(text[long])
    return np.concatenate(out), np.concatenate(of)


def patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters, a column each: capitals, exclamation marks, other signs, digits, or few distinct bytes in
    proportion to length."""
    n = np.maximum(1, np.diff(offsets))
    count = lambda mask: np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[offsets])
    upper, letter = count((data >= 65) & (data <= 90)), count(_LETTER[data])
    bang, digit, space = count(data == 33), count((data >= 48) & (data <= 57)), count(K.SPACE[data])
    same = count(np.append(False, data[1:] == data[:-1]) if len(data) else np.zeros(0, bool))
    return np.stack([upper > 0.5 * np.maximum(1, letter), bang > 0.02 * n, n - letter - digit - space > 0.2 * n, digit > 0.2 * n, same > 0.2 * n], axis=1)


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents with each gram, summed over what a task has read: counted by slices, as a batch's hashes take many times its bytes."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = K.flat(batch.column("text"))
        sums = [np.zeros((3, 0), np.int64)]
        for i, j in K.slices(offsets):
            gram, text = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            order = np.lexsort((text, gram))
            gram, text = gram[order], text[order]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
            gram, text = gram[new], text[new]
            sums.append(_summed(gram.view(np.int64), toxic[text + i], np.ones(len(gram), np.int64)))
        cells = _summed(*np.concatenate(sums, axis=1))
        if cells.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["gram", "toxic", "n"])


def _summed(gram: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    order = np.argsort(gram, kind="stable")
    gram, toxic, n = gram[order], toxic[order], n[order]
    at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    return np.stack([gram[at], np.add.reduceat(toxic, at), np.add.reduceat(n, at)]) if len(at) else np.zeros((3, 0), np.int64)


def votes(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and voter numbers of all votes; lexicon (sorted hashes) first, then the patterns."""
    text, voter = [], []
    for i, j in K.slices(offsets):
        part, to = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        gram, of = grams(part, to)
        at = np.minimum(np.searchsorted(lexicon, gram), max(0, len(lexicon) - 1))
        hit = lexicon[at] == gram if len(lexicon) else np.zeros(len(gram), bool)
        pair = np.unique(np.stack([of[hit], at[hit]]), axis=1)
        row, col = np.nonzero(patterns(part, to))
        text += [pair[0] + i, row + i]
        voter += [pair[1], col + len(lexicon)]
    return (np.concatenate(text), np.concatenate(voter)) if text else (np.zeros(0, np.int64),) * 2


def co_votes(doc: np.ndarray, voter: np.ndarray, width: int, n: int, cells: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of voters i to j: where in a grid of (voters of the block, all voters) votes were cast together, and how often."""
    to = np.searchsorted(doc, np.arange(n + 1))
    order = np.argsort(voter, kind="stable")
    of_voter = np.searchsorted(voter[order], np.arange(width + 1))
    step = max(1, cells // max(1, width))
    for i in range(0, width, step):
        j = min(width, i + step)
        grid = np.zeros((j - i) * width, np.int32)
        for v in range(i, j):
            docs = doc[order[of_voter[v] : of_voter[v + 1]]]
            size = to[docs + 1] - to[docs]
            ends = np.cumsum(size)
            where = np.repeat(to[docs] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            grid[(v - i) * width : (v - i + 1) * width] = np.bincount(voter[where], minlength=width)
        at = np.flatnonzero(grid).astype(np.int32)
        yield i, j, at, grid[at]


class LabelModel:
    """Naive Bayes over votes by expectation maximisation, with voters that repeat each other weighed down.

    A voter that doesn't fire abstains; that no lexicon voter fires is a vote of its own. The label of a document is one more
    voter, of a fixed accuracy, which keeps the two classes from drifting.
    """

    def __init__(self, doc: np.ndarray, voter: np.ndarray, width: int, labels: np.ndarray, accuracy: float = 0.98, rounds: int = 10):
        """doc and voter of each vote, sorted by doc, without repeats; width: voters; labels: 0 or 1 for each document."""
        n = len(labels)
        together = list(co_votes(doc, voter, width, n))
        p = np.where(labels == 1, accuracy, 1 - accuracy)
        said = np.where(labels == 1, 1, -1) * np.log(accuracy / (1 - accuracy))
        for _ in range(rounds):
            q = 1 - p
            self.prior = (p.sum() + 1) / (n + 2)
            with_yes, with_no = np.bincount(voter, p[doc], width), np.bincount(voter, q[doc], width)
            self.yes = yes = (with_yes + 0.1) / (p.sum() + 1)
            self.no = no = (with_no + 0.1) / (q.sum() + 1)
            # Of voters that agree beyond what the label explains, each gets the share of one. Products of the residuals
            # x - p yes - q no come from counts of votes cast together, a block of voters at a time.
            pp, pq, qq = p @ p, p @ q, q @ q
            own = with_yes + with_no - 2 * (yes * with_yes + no * with_no) + yes * yes * pp + 2 * yes * no * pq + no * no * qq
            scale = np.sqrt(np.maximum(own, 0)) + 1e-6
            self.share = np.zeros(width)
            for i, j, at, count in together:
                product = np.outer(yes[i:j] * pp + no[i:j] * pq - with_yes[i:j], yes) + np.outer(yes[i:j] * pq + no[i:j] * qq - with_no[i:j], no)
                product -= np.outer(yes[i:j], with_yes) + np.outer(no[i:j], with_no)
                product.ravel()[at] += count
                related = np.abs(product) / np.outer(scale[i:j], scale)
                related[related < 0.5] = 0
                related[np.arange(j - i), np.arange(i, j)] = 1
                self.share[i:j] = 1 / related.sum(1)
            weight = self.share * (np.log(yes) - np.log(no))
            p = 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + said + np.bincount(doc, weight[voter], n), -30, 30)))
        self.posterior = p


class Classifier:
    def __init__(self, lexicon: np.ndarray, weights: np.ndarray, intercept: float):
        self.lexicon, self.weights, self.intercept = lexicon, weights, intercept

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, voter = votes(data, offsets, self.lexicon)
        z = self.intercept + np.bincount(text, self.weights[voter], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, max_train: int = MAX_TRAIN) -> Classifier:
    """Fit on up to ``max_train`` labelled documents whose crc32(doc_id as text) modulo ``folds`` is not 0."""
    from pyspark.ml.classification import LogisticRegression  # here, so that workers that only score don't load it
    from pyspark.ml.linalg import Vectors, VectorUDT

    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = stored(rows, "labelled")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return Classifier(np.zeros(0, np.uint64), np.zeros(len(PATTERNS)), float(np.log((toxic + 0.5) / (n - toxic + 0.5))) if n else -2.0)
    mined = rows.mapInArrow(K.tidied(_mine), "gram long, toxic long, n long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    mined = stored(mined, "grams")
    # Evidence in nats that a gram's share of toxic documents isn't the share of all; it must outweigh the number of grams tried.
    k, m, rate = F.col("toxic"), F.col("n"), toxic / n
    evidence = k * F.log(k / m / rate) + F.when(m > k, (m - k) * F.log((1 - k / m) / (1 - rate))).otherwise(0.0)
    # Those on so few documents that even all of them toxic would not do are no trials.
    tally = {r.n: r.c for r in mined.groupBy(F.least("n", F.lit(64)).alias("n")).agg(F.count("*").alias("c")).collect()}
    for least in range(1, 65):
        tried = sum(c for n, c in tally.items() if n >= least)
        enough = float(np.log(max(1, tried))) + 2
        if least * np.log(1 / rate) >= enough:
            break
    lexicon = mined.where(k > 0.5 * m).withColumn("evidence", evidence).where(F.col("evidence") >= enough).select("gram").toArrow()
    lexicon = np.sort(lexicon.column("gram").to_numpy().view(np.uint64))
    width = len(lexicon) + len(PATTERNS)

    def ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, voter = votes(*K.flat(batch.column("text")), lexicon)
            cast = [[] for _ in range(batch.num_rows)]
            for t, v in zip(text.tolist(), voter.tolist()):
                cast[t].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([sorted(c) for c in cast], pa.list_(pa.int32()))], names=["doc_id", "toxic", "votes"])

    sample = rows.mapInArrow(K.tidied(ballots), "doc_id long, toxic int, votes array<int>").orderBy("doc_id").toArrow().combine_chunks()
    cast = sample.column("votes").to_pylist()
    # That no lexicon voter fires is the vote of one more.
    full = [v if v and v[0] < len(lexicon) else [*v, width] for v in cast]
    doc, voter = np.repeat(np.arange(len(full)), [len(v) for v in full]), np.array([x for v in full for x in v], np.int64)
    model = LabelModel(doc, voter, width + 1, sample.column("toxic").to_numpy())
    # Documents of equal votes make one training row for either label, weighed by their posteriors.
    equal: dict[tuple[int, ...], list[float]] = {}
    for v, p in zip(cast, model.posterior.tolist()):
        both = equal.setdefault(tuple(v), [0.0, 0.0])
        both[0] += 1 - p
        both[1] += p
    training = [(Vectors.sparse(width, list(v), [1.0] * len(v)), float(y), both[y]) for v, both in sorted(equal.items()) for y in (0, 1)]
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType()), T.StructField("weight", T.DoubleType())])
    line = LogisticRegression(weightCol="weight", maxIter=60, regParam=1e-5, standardization=False).fit(spark.createDataFrame(training, schema).repartition(1))
    return Classifier(lexicon, line.coefficients.toArray(), line.intercept)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, max_train: int = MAX_TRAIN, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out (crc32 of doc_id as text modulo ``folds`` is 0), score (0 to 1) and predicted of every whole text.

    A score depends on the text alone. Null and empty texts have no votes and get the score of such; a null doc_id counts as
    the empty text for held_out. Labels that are null, or of both kinds for a doc_id, count as missing, or as toxic. Without
    labels of both kinds the score is the share of toxic ones for all, and without any it is 0.12. Repeated rows are scored each; an empty table gives an
    empty result; other columns are ignored.
    """
    model = fit(docs, labels, folds, max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.score(*K.flat(batch.column("text"))))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0)
    return rows.mapInArrow(K.tidied(run), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, max_train: int = MAX_TRAIN, threshold: float = 0.5) -> DataFrame:
    """docs less those that the classifier finds toxic; all their columns.

    Null and empty texts get the score of a text without votes; rows that repeat are judged each; an empty table gives an empty
    result. Without labels of both kinds the share of toxic ones decides for all, and without any nothing goes.
    """
    model = fit(docs, labels, folds, max_train)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(*K.flat(batch.column("text"))) < threshold))

    return docs.select(columns).mapInArrow(K.tidied(run), docs.schema)
