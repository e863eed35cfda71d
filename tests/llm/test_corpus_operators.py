"""Each corpus operator against a plain version, on texts with nulls, empty and long ones, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reelsift.llm import bpe, chat, decontaminate, embedding_dedup, hmm, line_dedup, simhash, suffix_dedup, token_files, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, cell long, held_out string"


def texts(n=60, seed=3):
    r = random.Random(seed)
    words = ["Alpha", "beta", "gämma", "delta's", "x1", "naïve", "zeta!!", "42", "the", "of", "世界", "<|endoftext|>", "o'er"]
    passage = " ".join(r.choice(words) for _ in range(40))
    out = [None, "", " ", "a", "\n\n\t ", "a" * 400, "ab " * 300, passage, passage, passage[3:] + " tail"]
    while len(out) < n:
        body = " ".join(r.choice(words) + r.choice(["", ",", "\n"]) for _ in range(r.randint(1, 120)))
        cut = r.randint(0, len(body))
        out.append(body[:cut] + (passage[r.randint(0, 60) :] if r.random() < 0.4 else "") + body[cut:])
    return out + [out[12], out[12]]


@pytest.fixture(scope="module")
def rows():
    t = texts()
    t.append(" ".join(t[20:30]) * 40)
    return list(enumerate(t))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "h") for i, t in rows], DOCS).repartition(3)


def components(n, links):
    p = list(range(n))

    def f(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = sorted((f(a), f(b)))
        p[b] = a
    return [f(i) for i in range(n)]


def kept(rows, size):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - size + 1):
            w = b[s : s + size]
            if w in seen:
                cover[s : s + size] = b"\x01" * size
            seen.add(w)
        left = bytes(x for x, c in zip(b, cover) if not c)
        out[i] = (len(b), sum(cover), len(re.findall(b"\x01+", bytes(cover))), hashlib.sha256(left).hexdigest(), left)
    return out


@pytest.mark.parametrize(("size", "batches", "hot"), [(100, 8, 20_000), (20, 3, 1)])
def test_suffix_dedup_is_exact(spark, rows, size, batches, hot):
    got = suffix_dedup.dedup_substrings(frame(spark, rows), min_len=size, anchor=min(32, size - 8), n_batches=batches, hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got} == kept(rows, size)


def test_suffix_levels_merge_geometrically(spark, rows):
    index = suffix_dedup.SuffixIndex(spark, buckets=4)
    sizes = []
    for k in range(5):
        index.add(frame(spark, [r for r in rows if r[0] % 5 == k]))
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    index.drop()


def test_hmm_counts_and_likelihood(spark, rows):
    got = {r.doc_id: r for r in hmm.score_corpus(frame(spark, rows), chunk_bytes=4096).collect()}
    tokens = {i: re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)) + [" "] for i, t in rows}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0


def test_hmm_beats_word_counts_on_held_out_texts(spark):
    held = hmm.score_corpus(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_forward_recursion_sums_over_all_paths():
    model = hmm.Model.first(3, 5)
    seq, to = np.array([0, 3, 4, 2, 1]), np.array([0, 4, 4, 5])
    want = []
    for a, b in zip(to, to[1:]):
        total = 0
        for path in np.ndindex(*[3] * (b - a)):
            p = model.start[path[0]] if path else 1
            for t, s in enumerate(path):
                p *= model.emit[s, seq[a + t]] * (model.move[path[t - 1], s] if t else 1)
            total += p
        want.append(math.log10(total))
    assert hmm.log_likelihood(model, seq, to) == pytest.approx(want)
    before = sum(hmm.log_likelihood(model, seq, to))
    cells = hmm.expected_counts(model, seq, to)
    assert cells[3 + 9 :].sum() == pytest.approx(5, rel=1e-5)
    assert sum(hmm.log_likelihood(hmm.Model.of_counts(cells * 1e6, 3, 5), seq, to)) > before


def test_long_texts_are_learned_from_as_a_whole():
    """Counts by the plain forward-backward recursion over whole sequences, however they are cut in segments."""
    r = np.random.default_rng(3)
    model = hmm.Model.first(3, 7)
    to = np.cumsum([0, 1, 10_000, 0, 40, 64, 65, 128])
    seq = r.integers(0, 7, to[-1])
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 7))
    for a, b in zip(to, to[1:]):
        x, alpha, scale = seq[a:b], [], []
        for t, s in enumerate(x):
            now = (alpha[-1] @ model.move if t else model.start) * model.emit[:, s]
            scale.append(now.sum()), alpha.append(now / now.sum())
        beta = np.ones(3)
        for t in range(len(x) - 1, -1, -1):
            emits[:, x[t]] += alpha[t] * beta
            if t:
                onward = model.emit[:, x[t]] * beta / scale[t]
                moves += np.outer(alpha[t - 1], onward) * model.move
                beta = model.move @ onward
        if len(x):
            starts += alpha[0] * beta
    want = np.concatenate([starts, moves.ravel(), emits.ravel()])
    for segment in (7, 64, 1024, 100_000):
        assert hmm.expected_counts(model, seq, to, segment) == pytest.approx(want, rel=2e-3, abs=1e-2)


def test_perspectives_render_and_mask(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 300, "ann", "bye"), (2, 0, "system", "alone"), (None, None, None, "who"), (None, 1, "cy", "é" * 5000)]
    got = chat.rotate_perspectives(spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, block int, segment string"), block=4).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.start):
        key = (r.conv_id, r.speaker)
        assert r.start == len(whole.get(key, ""))
        whole[key] = whole.get(key, "") + r.segment
    assert set(whole) == {(1, "ann"), (1, "bob"), (None, "cy")}
    assert whole[1, "ann"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n" + "<|im_start|>user name=bob\n<|im_end|>\n" * 2 + "<|im_start|>assistant\nbye<|im_end|>\n"
    for r in got:
        mask = whole[r.conv_id, r.speaker][r.mask_start : r.mask_end] if r.mask_start is not None else None
        assert mask == (r.segment.split("\n", 1)[1][:-1] if r.role == "assistant" else None)


def test_vectors_link_exactly(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((30, 16))
    v = np.concatenate([base, base[:10] + 0.1 * r.standard_normal((10, 16)), base[:3], 2 * base[:2], base[:1] + 0.05 * r.standard_normal((40, 16))])
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None, 1.0], [float("inf")] * 16, [1.0, 0.0], [1.0, 0.001]]
    data = [*v.tolist(), *odd]
    got = {x.vec_id: x for x in embedding_dedup.near_vectors(spark.createDataFrame([(i, x, 0, 1) for i, x in enumerate(data)], "vec_id long, embedding array<double>, label int, size int"), block=16).collect()}
    links = np.zeros((len(data), len(data)), bool)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links[: len(v), : len(v)] = u @ u.T >= 0.95
    links[-2:, -2:] = True
    np.fill_diagonal(links, False)
    names = components(len(data), zip(*np.nonzero(links)))
    assert sum(x.n_links for x in got.values()) >= 0.95 * links.sum()
    assert all(got[i].n_links <= n for i, n in enumerate(links.sum(1)))
    assert all(got[i].component_id == names[i] and got[i].kept == (names[i] == i) for i in got)


def test_vectors_of_any_length_link_by_direction(spark):
    data = [(1e200, 1e200), (2e200, 2e200), (1e-200, 1e-200), (2e-200, 2e-200), (1.0, 1.0), (1.0, -1.0), (5e-324, 5e-324)]
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, list(v)) for i, v in enumerate(data)], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (0, 5, True) if i == 5 else (5, 0, i == 0) for i in range(7)}


@pytest.mark.parametrize("d", [3, 64, 100])
def test_code_estimates_are_unbiased_and_bounded(d):
    r = np.random.default_rng(2)
    v = r.standard_normal((400, d))
    v[200:] = v[:200] + 0.2 * v[200:]
    v = embedding_dedup.unit(v)
    i, j = np.triu_indices(400, 1)
    off = []
    for k in range(8):
        about, error = embedding_dedup.estimates(*embedding_dedup.encode(v @ embedding_dedup.rotation(d, k).T), d, i, j, 4.0)
        off.append(about - np.einsum("ij,ij->i", v[i], v[j]))
        assert (np.abs(off[-1]) <= error).mean() > 0.999
    if d > 3:
        assert abs(np.mean(off)) < 0.003 and abs(np.mean(off, axis=0)[j == i + 200].mean()) < 0.03


def test_near_copies_of_given_vectors_are_found(spark):
    """Recall against brute force: the given vectors and a copy of each at a cosine about 0.95 to 0.99."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").toArrow()
    v, r = embedding_dedup.unit(np.array(table.column(0).to_pylist(), np.float64)), np.random.default_rng(6)
    noise = embedding_dedup.unit(r.standard_normal(v.shape))
    v = embedding_dedup.unit(np.concatenate([v, v + r.uniform(0.15, 0.33, (len(v), 1)) * noise]))
    want = (v @ v.T >= 0.95).sum(1) - 1
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {x.vec_id: x.n_links for x in embedding_dedup.near_vectors(rows).collect()}
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.99 * want.sum() > 1000


def test_simhash_fingerprints_and_components(spark, rows):
    rows = [*rows, (900, "one two"), (901, "one two three four five six seven eight nine ten " * 20), (902, "one two three four five six seven eight nine ten " * 20 + "eleven")]
    got = {r.doc_id: r for r in simhash.simhash_components(frame(spark, rows)).collect()}
    prints = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    names = components(len(prints), near)
    for (i, _), p, c in zip(rows, prints, names):
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", rows[c][0])
    assert {r.doc_id for r in simhash.dedup(frame(spark, rows)).collect()} == {rows[c][0] for c in names}


def test_grid_finds_every_pair_within_the_radius(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = sorted({p ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for p in base for _ in range(8)})
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    points = spark.createDataFrame(list(zip(signed, range(len(signed)))), "fp long, node long")
    for groups in (5, 6):
        cells = simhash.grid_cells(points, 3, groups)
        links = simhash.cell_groups(cells, "node", cells.count(), block=7, group=40).groupBy("g").applyInArrow(simhash._links(3), "a long, b long").collect()
        want = components(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
        assert components(len(prints), links) == want


def tokenizer():
    return bpe._tokenizer(bpe.default_tokenizer())


def test_bpe_matches_the_library(spark, rows):
    got = {r.doc_id: r for r in bpe.encode_corpus(frame(spark, rows), outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"), chunk_bytes=4096, bucket_bytes=8192).collect()}
    for i, t in rows:
        ids = tokenizer().encode(t or "", add_special_tokens=False).ids
        text = tokenizer().decode(ids, skip_special_tokens=False)
        want = (len(ids), ids, text, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids, got[i].decoded, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_pretokens_follow_the_pattern():
    import public_tokenizers
    import pyarrow as pa
    import regex

    r = random.Random(1)
    signs = list("aZ é1٣'’ \n\t\r  .,!srtvelmd'’  世界😀ß½Ⅷ​́\x85\xa0　\x1c\x00")
    many = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    data, offsets = bpe.K.flat(pa.array(many))
    got = [[] for _ in many]
    for a, b, k in zip(*bpe.pretokens(data, offsets)):
        got[k].append(data[a:b].tobytes().decode())
    assert got == [regex.findall(public_tokenizers.PATTERN, t) for t in many]


def test_token_files_round_trip(spark, rows):
    got = {r.doc_id: r for r in token_files.tokens_round_trip(frame(spark, rows), chunk_bytes=4096).collect()}
    start = 0
    for i, t in rows:
        ids = [*tokenizer().encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_decontamination_catches_templates(spark):
    item = "A train leaves Paris at 9 with 120 people and after 9 hours of quiet travel through green hills reaches Rome with 80 people"
    items = [(1, item), (2, "too short"), (3, None), (4, "what is the sum of all the odd numbers that are less than ten in this list")]
    filler = "nothing here is like it at all and so the text goes on for a while"
    changed = item.replace("9", "7").replace("120", "300").replace("Paris", "Turin")
    broken = changed.replace("7 hours", "8 hours")
    docs = [(0, filler), (1, f"{filler} {item} {filler}"), (2, f"{filler}. {changed}"), (3, broken), (4, item.upper()), (5, None), (6, ""), (7, items[3][1] * 2), (7, items[3][1] * 2), (None, item), (8, " ".join(item.split()[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, hash int"), bench).collect()
    assert {(r.doc_id, r.item_id, r.reparameterised) for r in got} == {(1, 1, False), (2, 1, True), (4, 1, False), (7, 4, False)}
    left = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted(str(r.doc_id) for r in left) == ["0", "3", "5", "6", "8", "None"]


def test_toxicity_learns_markers_and_ignores_labels_at_scoring(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1200):
        bad = r.random() < 0.25
        w = [r.choice(words) for _ in range(30)]
        if bad:
            w[r.randrange(30)] = r.choice(["Vileness", "ROTTEN!", "grubst" + r.choice(words)])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs = frame(spark, [*rows, (5000, None), (5001, ""), (5001, "rotten " * 3000)])
    known = spark.createDataFrame([*labels, (5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, known).collect()
    truth = {i: t for i, _, t in labels}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got) and len(got) == len(rows) + 3
    hidden = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, toxicity.score_toxicity(docs, hidden).collect())) == sorted(map(str, got))
    assert toxicity.drop_toxic(docs, known).columns == docs.columns
    assert {round(x.score, 6) for x in toxicity.score_toxicity(docs, known.limit(0)).collect()} == {round(1 / (1 + math.exp(2)), 6)}


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_line_dedup_by_host(spark, broadcast_keys):
    head, foot = "Home  | About", "All rights reserved."
    rows = [(i, f"{head}\nbody {i}\n\n {foot}" if i % 2 else f"body {i}\r\n{foot}\n{foot}", "big") for i in range(20)]
    rows += [(100 + i, f"{head}\nother {i}", "small") for i in range(3)] + [(200, None, "big"), (201, "", "big"), (202, foot, "big"), (203, foot, None), (1, f"{head}\nbody 1\n\n {foot}", "big")]
    clash = ["row", "host", "lines", "keys", "salt", "hits", "kept", "__keys", "__host", "__kept"]
    docs = spark.createDataFrame([(*r, 9, 9, *clash) for r in rows], "doc_id long, text string, source string, n_lines int, key int, " + ", ".join(f"{c} string" for c in clash))
    got, left = {}, line_dedup.drop_boilerplate(docs, broadcast_keys=broadcast_keys)
    assert left.columns == ["doc_id", "text", "source", "key", *clash, "n_lines", "n_dropped"]
    for r in left.collect():
        assert [r[c] for c in clash] == clash and r.key == 9
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_dropped))
    assert got[1] == [("body 1\n", 4, 2)] * 2 and got[2] == [("body 2\r", 3, 2)]
    assert got[100] == [("other 0", 2, 1)]
    assert got[200] == [(None, 0, 0)] and got[201] == [("", 1, 0)] and got[202] == [("", 1, 1)] and got[203] == [(foot, 1, 0)]


def test_empty_tables(spark):
    docs = frame(spark, [(0, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffix_dedup.dedup_substrings(docs).count() == 0
    assert hmm.score_corpus(docs).count() == 0
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert simhash.simhash_components(docs).count() == 0
    assert bpe.encode_corpus(docs).count() == 0
    assert token_files.tokens_round_trip(docs).count() == 0
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert decontaminate.contaminated(frame(spark, [(0, "x")]), bench).count() == 0
    assert toxicity.score_toxicity(docs, labels).count() == 0
    assert line_dedup.drop_boilerplate(docs).count() == 0


def without_boilerplate(rows):
    """Line dedup in plain Python over (doc_id, source, text)."""
    total, pages = Counter(s for _, s, _ in rows), Counter()
    for _, s, t in rows:
        pages.update({(s, line.strip(" ")) for line in (t or "").split("\n") if line.strip(" ")})
    bad = {k for k, n in pages.items() if n >= 2 and n > 0.1 * total[k[0]]}
    return [(i, t and "\n".join(line for line in t.split("\n") if (s, line.strip(" ")) not in bad)) for i, s, t in rows]


def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline

    from test_near_copies import firsts

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    one = [(r.doc_id, r.source, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id not in toxic]
    two = without_boilerplate(one)
    first = firsts(two)
    three = [r for r in two if r[0] in first]
    bad = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(three, "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    want = {i: t for i, t in three if i not in bad}
    assert 0 < len(want) < len(three) < len(two) < docs.count()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(want)
    assert all(got[i].ids == tokenizer().encode(t or "", add_special_tokens=False).ids for i, t in want.items())


def test_ids_may_repeat_or_be_missing(spark, rows):
    """Null and repeated doc_ids: every row has a result of its own, the same as with ids of their own."""
    some = [(None, rows[12][1]), (None, None), (7, rows[20][1]), (7, rows[20][1]), (7, rows[21][1]), (9, "")]
    docs = frame(spark, some)
    count = lambda df: sorted((-1 if r.doc_id is None else r.doc_id) for r in df.collect())
    ids = sorted(-1 if i is None else i for i, _ in some)
    for result in (suffix_dedup.dedup_substrings(docs, n_batches=2), hmm.score_corpus(docs), simhash.simhash_components(docs), bpe.encode_corpus(docs), token_files.tokens_round_trip(docs)):
        assert count(result) == ids
    tokens = sorted(r.n_tokens for r in bpe.encode_corpus(docs).collect())
    assert tokens == sorted(len(tokenizer().encode(t or "", add_special_tokens=False).ids) for _, t in some)
    starts = sorted((r.start, r.n_tokens) for r in token_files.tokens_round_trip(docs).collect())
    assert [s for s, _ in starts] == list(np.cumsum([0, *(n for _, n in starts)][:-1]))


def test_texts_beyond_the_slices_of_kernels(spark):
    """One text of several slices, among short ones."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) for _ in range(5000)]
    long = " ".join(r.choice(words) for _ in range(120_000))
    rows = [(1, "a b c"), (2, long), (3, long[:300_000]), (4, None)]
    got = {x.doc_id: x for x in suffix_dedup.dedup_substrings(frame(spark, rows), n_batches=2).collect()}
    assert got[2].n_removed == 0 and got[3].n_removed == 300_000 and got[1].n_bytes == 5
    ids = {x.doc_id: x.ids for x in bpe.encode_corpus(frame(spark, rows)).collect()}
    assert ids[2] == tokenizer().encode(long, add_special_tokens=False).ids
    scores = {x.doc_id: x for x in hmm.score_corpus(frame(spark, rows)).collect()}
    assert scores[2].n_tokens == 120_001 and scores[2].score < 0
    prints = {x.doc_id: x for x in simhash.simhash_components(frame(spark, rows)).collect()}
    assert prints[4].fingerprint == "0" * 16 and prints[2].component_id in (2, 3) and len(prints) == 4
