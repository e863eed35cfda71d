"""Strings that polynomial hashes modulo a power of two take for equal: a Thue-Morse string and its complement."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from reelsift.llm import bpe, chunks, decontaminate, hmm, near_copies, suffix_dedup, token_files, toxicity
from reelsift.llm import kernels as K


def morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


PAIRS = [(morse(n), morse(n, "b", "a")) for n in (512, 4096)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [t for p in PAIRS for t in p]
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").coalesce(1)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.mark.parametrize("which", [0, 1])
def test_substring_hashes_are_the_polynomials(which, monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 70_000, dtype=np.uint8)
    start = np.array([0, 0, 5, 66_000, 17, 69_999, 70_000])
    end = np.array([0, 1, 205, 70_000, 69_000, 70_000, 70_000])
    total = [sum((int(c) + 1) * pow(K.BASE[which], i, K.PRIME) for i, c in enumerate(data[a:b])) % K.PRIME for a, b in zip(start, end)]
    want = K.mix(np.array(total, np.uint64))
    assert (K.Hashes(data, which).of(start, end) == want).all()
    monkeypatch.setattr(K, "_SPAN", 1000)  # long substrings in parts
    assert (K.Hashes(data, which).of(start, end) == want).all()
    assert (K.Hashes(data, which).windows(100)[:5] == K.Hashes(data, which).of(np.arange(5), np.arange(5) + 100)).all()


def test_structured_strings_have_hashes_of_their_own():
    for pair in PAIRS:
        data = np.frombuffer("".join(pair).encode(), np.uint8)
        n = len(pair[0])
        for which in (0, 1):
            a, b = K.Hashes(data, which).of(np.array([0, n]), np.array([n, 2 * n]))
            assert a != b


@pytest.mark.parametrize("width", [1, 2, 3, 12, 32, 100])
def test_anchors_stand_for_substrings(width):
    data = np.frombuffer((morse(2048) + morse(2048, "b", "a")).encode() * 2, np.uint8)
    value, seen = K.anchors(data, width), {}
    assert len(value) == len(data) - width + 1
    for i, v in enumerate(value.tolist()):
        assert seen.setdefault(data[i : i + width].tobytes(), v) == v
    assert len(set(seen.values())) == len(seen)


def test_words_are_told_apart_by_bytes_even_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(K, "string_hashes", lambda data, offsets: np.zeros(len(offsets) - 1, np.uint64))
    made = []
    for text in (b"one two three one", b"three two one three"):
        data = np.frombuffer(text, np.uint8)
        v = chunks.Vocabulary(data, np.array([0, len(data)]), K.words, 4)
        made.append((v.words.to_pylist(), [v.words[int(i)].as_py() for i in v.word]))
    assert made[0][0] == made[1][0] == [b"one", b"three", b"two"]
    assert [b" ".join(m[1]) for m in made] == [b"one two three one", b"three two one three"]


def test_encoding(docs):
    for r in bpe.encode_corpus(docs).collect():
        text = [t for p in PAIRS for t in p][r.doc_id - 1]
        assert r.ids == tokenizer().encode(text, add_special_tokens=False).ids and r.decoded == text


def test_token_files(docs):
    texts = [t for p in PAIRS for t in p]
    ids = [np.array([*tokenizer().encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert {r.doc_id: r.ids_crc32 for r in token_files.tokens_round_trip(docs).collect()} == {i: zlib.crc32(x.tobytes()) for i, x in enumerate(ids, 1)}


def test_word_counts(docs):
    texts = [t for p in PAIRS for t in p]
    learned = [t for i, t in enumerate(texts, 1) if zlib.crc32(str(i).encode()) % 10]
    n, v = 2 * len(learned), len(set(learned)) + 1
    for r in hmm.score_corpus(docs).collect():
        want = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in (learned.count(texts[r.doc_id - 1]), len(learned)))
        assert r.base_score == pytest.approx(want, abs=1e-9) and r.train_tokens == n


def test_near_copies_and_pipeline_stage(spark, docs):
    import corpus_pipeline

    assert {r.doc_id for r in near_copies.dedup(docs).collect()} == {1, 2, 3, 4}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs.union(docs), "").collect()} == {1, 2, 3, 4}


def test_decontamination(spark, docs):
    x, y = PAIRS[0]
    bench = spark.createDataFrame([(1, f"name the word {x}")], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"please name the word {y} now"), (2, f"please name the word {x} now")], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(rows, bench).collect()} == {2}


def test_substring_dedup(spark):
    texts = [t for p in PAIRS for t in p]
    rows = spark.createDataFrame([(i, t + t[: 50 * i]) for i, t in enumerate(texts, 1)], "doc_id long, text string")
    seen, want = set(), {}
    for i, t in enumerate(texts, 1):
        t = t + t[: 50 * i]
        cover = bytearray(len(t))
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                cover[s : s + 100] = b"\x01" * 100
            seen.add(t[s : s + 100])
        want[i] = hashlib.sha256("".join(c for c, x in zip(t, cover) if not x).encode()).hexdigest()
    assert {r.doc_id: r.kept_sha256 for r in suffix_dedup.dedup_substrings(rows, n_batches=3).collect()} == want


def test_grams():
    data = np.frombuffer(" ".join(t for p in PAIRS for t in p).encode(), np.uint8)
    gram, _ = toxicity.grams(data, np.array([0, len(data)]))
    assert len(set(gram[:4].tolist())) == 4
