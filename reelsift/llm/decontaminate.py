"""Benchmark decontamination by template canonicalisation (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm import kernels as K
from reelsift.llm.common import bound_batches, stored

WINDOW, LITERALS, RUN = 8, 5, 6
#: Windows that may be broadcast: 8 bytes of hash, 8 of item and 8 of position each. Beyond it they are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Unit words, which are placeholders after a number.
UNITS = ["mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "cl", "l", "s", "ms", "min", "h", "hr", "hrs", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "mph", "kmh", "w", "kw", "kwh", "v", "a", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "usd", "eur", "gbp", "dollars", "euros", "cents", "percent", "meters", "metres", "kilometers", "kilometres", "miles", "feet", "inches", "grams", "kilograms", "pounds", "liters", "litres", "degrees"]

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
NUMBER, NAME, UNIT = (np.uint64(x) for x in (11, 13, 17))


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = K.flat(pa.array(words))
    return K.Hashes(data).of(offsets[:-1], offsets[1:])


UNIT_HASHES = np.sort(_hash_words(UNITS))


#: Whether a character of the basic plane is a capital.
_CAPITAL = np.array([chr(c).isupper() for c in range(1 << 16)])


def _capitals(data: np.ndarray) -> np.ndarray:
    """Whether a capital begins at each byte of UTF-8 text."""
    out, n = _UPPER[data], len(data)
    for low, high, more in ((0xC2, 0xE0, 1), (0xE0, 0xF0, 2)):
        at = np.flatnonzero((data >= low) & (data < high))
        at = at[at + more < n]
        code = data[at].astype(np.int64) & (0x3F >> more)
        for k in range(1, more + 1):
            code = code << 6 | data[at + k] & 0x3F
        out[at] = _CAPITAL[code]
    return out


Stream = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def streams(data: np.ndarray, offsets: np.ndarray) -> list[Stream]:
    """Three readings of the texts of a buffer, each as canonical tokens: token hash, or NUMBER, NAME or UNIT; whether it is one
    of these; the hash of what was written; the text number; and the number of the token's first word in its text.

    Tokens are runs of letters and digits, in lower case (A-Z); a number takes in the points, commas and apostrophes between its
    digits and ends where a letter follows its first digits. A number has a digit; a unit is a unit word after a number. The
    first reading has names: words that start with a capital and have none after it, at the start of a sentence as elsewhere;
    names with only spaces between them are one, and what was written is the last of them. The second has names as words,
    for copies in other case. The third has what was written and no placeholders.
    """
    n = len(data)
    digit, letter = _DIGIT[data], _WORD[data] & ~_DIGIT[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = _WORD[data]
    if n > 2:
        inner = np.isin(data[1:-1], np.frombuffer(b".,'", np.uint8)) & digit[:-2] & digit[2:] & ~edge[1 : n - 1] & ~edge[2:n]
        solid[1:-1] |= inner
    before = np.append(True, ~solid[:-1] | edge[1:-1]) if n else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(solid & before, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    sums = lambda mask: np.append(0, np.cumsum(mask, dtype=np.int32))
    letters = sums(letter)
    # A letter after digits alone begins a token of its own.
    cut = np.zeros(n + 1, bool)
    if n > 1:
        cut[1:n] = letter[1:] & digit[:-1] & (letters[1:n] == letters[begin[:-1]]) & solid[1:] & ~before[1:]
    after = np.append(~solid[1:] | edge[1:-1], True) if n else np.zeros(0, bool)
    start = np.flatnonzero(solid & (before | cut[:n]))
    end = np.flatnonzero(solid & (after | cut[1:])) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    capital = _capitals(data) if n else np.zeros(0, bool)
    digits, capitals, spaces = sums(digit), sums(capital), sums(data == 32)
    written = K.Hashes(K.LOWER[data]).of(start, end)
    number = digits[end] > digits[start]
    name = capital[start] & (capitals[end] - capitals[start] == 1) & ~number & (end - start > 1)
    same = np.append(False, text[1:] == text[:-1]) if len(text) else np.zeros(0, bool)
    unit = same & np.append(False, number[:-1])[: len(text)] & ~number & np.isin(written, UNIT_HASHES)
    name &= ~unit
    origin = np.arange(len(text)) - np.searchsorted(text, text)
    plain = np.where(number, NUMBER, np.where(unit, UNIT, written))
    gap = np.append(0, start[1:] - end[:-1])[: len(start)]
    joined = name & np.append(False, name[:-1])[: len(text)] & same & (gap == spaces[start] - spaces[start - gap])
    head = np.flatnonzero(~joined)
    tail = np.append(head[1:], len(joined)) - 1 if len(head) else head
    named = (np.where(name, NAME, plain)[head], (number | unit | name)[head], written[tail], text[head], origin[head])
    return [named, (plain, number | unit, written, text, origin), (written, np.zeros(len(text), bool), written, text, origin)]


def windows(stream: Stream, which: int, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of every run of ``size`` tokens in a text that holds ``literals`` words or more."""
    token, slot, _, text, _ = stream
    n = len(token) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.append(0, np.cumsum(~slot))
    at = np.flatnonzero((text[:n] == text[size - 1 :]) & (words[size:] - words[:n] >= literals))
    value = K.runs(token, at, size)
    return K.mix(value + np.uint64((which << 32) + size)), at


ITEM = "item long, item_id long, stream int, tokens array<long>, slots array<long>, starts array<long>, size long, hashes array<long>"


def benchmark_items(benchmark: DataFrame, size: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """A row per item and reading: item (a number of its id and text), item_id, stream, tokens, slots (hash of what is written in
    each placeholder, 0 for words), and the starts, size and hashes of the windows.

    An item without a window in a reading has itself as its only one; without any word, it has that as it is written. Items
    with null or empty text, or without tokens, have no rows and can't be found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ITEM.split(", ")]
        for batch in batches:
            rows = []
            for item, item_id, words in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text"))):
                read = streams(*K.flat(pa.array([words])))
                plain = not any((~s[1]).any() for s in read[:-1])
                for which, stream in enumerate(read):
                    n = len(stream[0])
                    if not n or (which == len(read) - 1) != plain:
                        continue
                    value, at = windows(stream, which, size, literals)
                    length = size
                    if not len(at):
                        length = n
                        value, at = windows(stream, which, n, 1)
                    shown = np.where(stream[1], stream[2], 0).astype(np.uint64)
                    if len(at):
                        rows.append((item, item_id, which, stream[0].view(np.int64).tolist(), shown.view(np.int64).tolist(), at.tolist(), length, value.view(np.int64).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), *(pa.list_(pa.int64()),) * 3, pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, kinds)], names=names)

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    return rows.withColumn("item", F.xxhash64("item_id", "text")).mapInArrow(run, ITEM)


def _scan(size: int, literals: int, lengths: list[tuple[int, int]], wanted: np.ndarray | None):
    """Windows of the documents, those alone whose hash is wanted if that is given; lengths: readings and lengths of whole items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = K.flat(batch.column("text"))
            for i, j in K.slices(offsets):
                read = streams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for which, length, least in [*((w, size, literals) for w in range(len(read) - 1)), *((w, n, 1) for w, n in lengths)]:
                    text = read[which][3]
                    value, at = windows(read[which], which, length, least)
                    if wanted is not None:
                        hit = wanted[np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)] == value if len(wanted) else np.zeros(len(value), bool)
                        value, at = value[hit], at[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + text[at]], pa.int64()), pa.array(at - np.searchsorted(text, text[at])), pa.array(value.view(np.int64))], names=["doc_id", "at", "hash"])

    return run


PLACE = "doc_id long, item long, stream int, from long, token array<long>, shown array<long>, origin array<long>"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of documents where items may lie, as far as the document has them; ``from`` is the item's token there."""
    for batch in batches:
        for doc, words, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
            read, rows = streams(*K.flat(pa.array([words]))), []
            shown = [np.where(s[1], s[2], 0).astype(np.uint64).view(np.int64) for s in read]
            for f in found:
                token, origin = read[f["stream"]][0].view(np.int64), read[f["stream"]][4]
                a, b = max(0, f["start"]), min(len(token), f["start"] + f["n"])
                rows.append((doc, f["item"], f["stream"], a - f["start"], token[a:b].tolist(), shown[f["stream"]][a:b].tolist(), origin[a:b].tolist()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), *(pa.list_(pa.int64()),) * 3)
            for k in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1000]), kinds)], names=[c.split()[0] for c in PLACE.split(", ")])


FOUND = "doc_id long, item_id long, covered long, n_matched long, same boolean, first_token long, n_windows long"


def _verified(need: int):
    """Of the places, those with a run of ``need`` tokens of the item (all, if it has fewer) where words and placeholders are equal
    and equal slots of the item are equal in the document. The run holds a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            rows = []
            for r in (r for k in range(0, batch.num_rows, 200) for r in batch.slice(k, 200).to_pylist()):
                n, at, bound, runs = len(r["tokens"]), r["from"], {}, []
                alike = np.array(r["tokens"][at : at + len(r["token"])], np.int64) == np.array(r["token"], np.int64)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], alike.astype(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if b - a < r["size"]:
                        continue
                    begin = a
                    for k in range(a, b):
                        slot = r["slots"][at + k]
                        if slot and bound.setdefault(slot, r["shown"][k]) != r["shown"][k]:
                            runs.append((begin, k))
                            begin = k + 1
                    runs.append((begin, b))
                inside = [(a, b, sum(a <= s - at and s - at + r["size"] <= b for s in r["starts"])) for a, b in runs]
                inside = [x for x in inside if x[2]]
                if any(b - a >= min(need, n) for a, b, _ in inside):
                    same = all(r["slots"][at + k] == r["shown"][k] for a, b, _ in inside for k in range(a, b))
                    first = min(s - at for s in r["starts"] if s - at >= inside[0][0])
                    rows.append((r["doc_id"], r["item_id"], sum(b - a for a, b, _ in inside), sum(x[2] for x in inside), same, r["origin"][first], len(r["starts"])))
            kinds = (*(pa.int64(),) * 4, pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, literals: int = LITERALS, run_length: int = RUN) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains, verbatim or with other numbers, names and units.

    Both are made canonical with typed placeholders; windows of ``size`` tokens with ``literals`` words, joined by hash, tell where
    an item may lie, and the tokens there are compared one by one. A pair counts if as many tokens in a row as ``run_length``
    neighbouring windows cover (all, if the item has fewer) are equal with consistent slots. Items without a window are matched
    as a whole, those without a word as written. Returns doc_id, item_id, n_matched (windows of the item in such runs), n_windows
    (of the item), first_token (of the first of them) and reparameterised (a slot differs).

    Null or empty texts and null ids match nothing. Rows that repeat a doc_id or item_id count as one. Empty tables give an
    empty result; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    items = stored(benchmark_items(benchmark, size, literals), "items")
    known = items.select("item", "stream", F.size("tokens").cast("long").alias("n"), F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select("item", "stream", "n", F.col("w.starts").alias("pos"), F.col("w.hashes").alias("hash"))
    known = stored(known, "windows")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    small = known.count() <= BROADCAST_WINDOWS
    wanted = np.sort(np.array([r.hash for r in known.select("hash").distinct().collect()], np.int64).view(np.uint64)) if small else None
    whole = items.where("size(starts) = 1 and size = size(tokens)").select("stream", "size").distinct()
    lengths = sorted((r.stream, r.size) for r in whole.collect())
    hits = rows.mapInArrow(K.tidied(_scan(size, literals, lengths, wanted)), "doc_id long, at long, hash long").join(F.broadcast(known) if small else known, "hash")
    spots = hits.select("doc_id", "item", "stream", (F.col("at") - F.col("pos")).alias("start"), "n").distinct()
    spots = stored(spots.groupBy("doc_id").agg(F.collect_list(F.struct("item", "stream", "start", "n")).alias("found")), "spots")
    places = rows.join(F.broadcast(spots) if (spots.agg(F.sum(F.size("found"))).first()[0] or 0) <= BROADCAST_WINDOWS else spots, "doc_id").mapInArrow(K.tidied(_places), PLACE)
    sure = places.join(F.broadcast(items.drop("hashes")) if small else items.drop("hashes"), ["item", "stream"]).mapInArrow(K.tidied(_verified(size + run_length - 1)), FOUND)
    best = sure.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "n_matched", "same", (-F.col("first_token")).alias("before"), "n_windows")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_matched").alias("n_matched"), F.col("b.n_windows").alias("n_windows"), (-F.col("b.before")).alias("first_token"), (~F.col("b.same")).alias("reparameterised"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, literals: int = LITERALS, run_length: int = RUN) -> DataFrame:
    """docs without those that contain a benchmark item; null doc_ids stay."""
    return docs.join(contaminated(docs, benchmark, size, literals, run_length).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
