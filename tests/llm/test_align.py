"""Alignment of two tokenizers against a plain version."""

import hashlib
import random
from collections import Counter
from functools import reduce

import numpy as np
import pytest

from reelsift.llm import align, bpe


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bpe.default_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.default_pieces())


def tokens(a, b, text):
    """Ids with byte ends by the libraries over the whole text, or nothing."""
    if not text:
        return [], []
    want = (" " + text).encode()
    _, table, to = align._first(bpe.default_tokenizer())
    first, at, joined = [], 0, b""
    for i in a.encode(" " + text, add_special_tokens=False).ids:
        joined += table[to[i] : to[i + 1]].tobytes()
        first.append((i, len(joined)))
    second, other = [], b""
    for i in b.encode(text):
        other += bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        second.append((i, len(other)))
    return (first, second) if joined == want == other else ([], [])


def plain(rows):
    a, b = libraries()
    found, count = [], Counter()
    for _, text in rows:
        x, y = tokens(a, b, text)
        ends = {e for _, e in x} & {e for _, e in y}
        groups, cur = [], ([], [])
        for e in sorted({e for _, e in x} | {e for _, e in y}):
            cur[0].extend(i for i, z in x if z == e) if any(z == e for _, z in x) else None
            cur[1].extend(i for i, z in y if z == e) if any(z == e for _, z in y) else None
            if e in ends:
                groups.append(cur)
                cur = ([], [])
        spans = lambda t: [(i, s, e) for (i, e), s in zip(t, [0, *(z for _, z in t)])]
        links, j, bs = [], 0, spans(y)
        for i, s, e in spans(x):
            while j and bs[j - 1][2] > s:
                j -= 1
            while j < len(bs) and bs[j][1] < e:
                if bs[j][2] > s:
                    links.append((i, bs[j][0]))
                j += 1
        count.update(links)
        found.append((len(x), len(y), groups, links))
    most = Counter()
    for (_, i), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for (doc, _), (na, nb, groups, links) in zip(rows, found):
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((doc, na, nb, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return Counter(out)


def texts():
    r = random.Random(5)
    words = ["Alpha", "beta", "gämma", "delta's", "x1", "naïve", "zeta!!", "42", "the", "of", "世界", "<|endoftext|>", "<s>", "<0x41>", "o'er", " ", "\t", "🙂", "   "]
    out = [None, "", " ", "  ", "a", "a ", "\n\n\t ", "x▁y", "a" * 300, "<unk>", "é", "a\x00b", "ends with spaces   "]
    out += [" ".join(r.choice(words) + r.choice(["", ",", "\n", " "]) for _ in range(r.randint(1, 90))) for _ in range(25)]
    return out


@pytest.mark.parametrize(("piece", "span"), [(64 << 10, 32 << 10), (50, 17)])
def test_groups_links_and_counts(spark, piece, span):
    rows = [*enumerate(texts()), (30, texts()[30]), (30, texts()[30]), (31, "another text"), (None, texts()[33]), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, a long, chunk long").repartition(3)
    got = align.align_corpus(docs, piece_bytes=piece, range_bytes=span, chunk_bytes=2000)
    assert Counter(tuple(r) for r in got.collect()) == plain(rows)


def test_long_texts_compose_over_many_tasks(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(300)]
    rows = [(1, " ".join(r.choice(words) for _ in range(9000))), (2, "x" * 5000 + " y" * 900), (3, " ".join(words) + " ▁ " + " ".join(words)), (4, "short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(x) for x in align.align_corpus(docs, piece_bytes=400, range_bytes=150).collect()) == plain(rows)


def test_fragments_compose_associatively_at_any_cuts():
    text = np.frombuffer(" Alpha naïve 42 zeta!! the 世界 of delta's".encode(), np.uint8)
    t, good = align.tokenise(text, np.array([0, len(text)]), bpe.default_tokenizer(), align.default_pieces())
    assert good.all()
    whole = lambda f: (b"".join(x[3] for x in sorted(f.ended(), key=lambda x: x[0])), sorted(np.concatenate([x[4] for x in f.ended()]).tolist()))
    want = whole(align.Fragment.of(t))
    r = random.Random(2)
    for _ in range(200):
        cuts = [0, *sorted(r.sample(range(1, len(text)), r.randint(0, 12))), len(text)]
        parts = [align.Fragment.of(t.within(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
        assert whole(reduce(align.Fragment.__add__, parts)) == want
        while len(parts) > 1:  # in any order
            k = r.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert whole(parts[0]) == want


def test_empty_table(spark):
    assert align.align_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
