"""Near duplicates, components, decontamination, language-model scores and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, components, decontam, langid, lm, minhash, queries, textvec
from tests.llm.data import documents, empty, odd, words
from tests.oracle import both

# --- near duplicates ---


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    """rows: (doc_id, text). doc_id → (set size, component), by comparing all pairs."""
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both_ = len(sets[i] & sets[j])
            if both_ and 100 * both_ >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), c := least.get(find(k), i), i == c) for k, (i, _) in enumerate(rows))


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_near_duplicates_sql(spark, sf):
    mine, theirs = both(spark, sf, queries.op9_minhash, queries.ORACLES["op9_minhash"])
    assert mine == theirs


def test_near_duplicates_odd(spark):
    docs = odd(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for n in (4, 5, 1):
        assert result(minhash.near_duplicates(docs, n)) == brute_components(rows, n, 80)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    left = minhash.deduplicated(docs, 5)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 9, 11, 12]


def family(seed, n_docs, n_words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    out = []
    for _ in range(n_docs):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(n_words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
        if rng.random() < 0.3:
            base = own
    return out


def test_chains_and_crowded_buckets(spark):
    texts = family(1, 60, 60, 4) + family(2, 60, 40, 6) + family(3, 40, 200, 30) + [f"alone {i} " * 5 for i in range(20)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 4, 80)
    assert result(minhash.near_duplicates(docs, 4)) == want


def test_pages_of_one_template(spark):
    """700 texts that share 80 of 105 words are crowded into buckets, and only the pairs of them planted here are linked."""
    shared = " ".join(f"t{k}" for k in range(80))
    texts = [shared + " " + " ".join(f"p{i}w{k}" for k in range(25)) for i in range(700)]
    texts += [t + " more" for t in texts[:40]] + [t.replace("t7 ", "u7 ") for t in texts[20:60]]
    rows = list(enumerate(texts))
    want = brute_components(rows, 4, 80)
    assert result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)) == want
    assert sum(not k[3] for k in want) == 80


def test_rarest_shingles_hold_every_link(spark):
    """The second step by itself: with no component known yet, all linked pairs of what is left are among its pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 200, np.uint64)
    sets = []
    for i in range(60):
        own = base[: rng.integers(1, 200)] if i % 4 else rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)
        sets.append(np.unique(np.concatenate([own[rng.random(len(own)) > 0.05], rng.integers(0, 1 << 63, rng.integers(1, 8), np.uint64)])))
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "cid long, set binary")
    crowd = spark.range(60).selectExpr("1L AS key", "id AS cid")
    got = {(r.a, r.b) for r in minhash._left(crowd, df, spark.createDataFrame([], "id long, label long"), 80).collect()}
    linked = {(i, j) for j in range(60) for i in range(j) if 100 * len(both_ := np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - len(both_))}
    assert len(linked) > 20 and linked <= got


def test_bands_find_what_is_similar():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(300):
        base = rng.integers(0, 1 << 63, 90, np.uint64)
        other = np.concatenate([base[:80], rng.integers(0, 1 << 63, 10, np.uint64)])
        keys = minhash.signature(np.concatenate([base, other]), np.array([0, 90, 180]))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.id: r.label for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 200: 200}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_without_ids(spark):
    w = [[f"{c}{k}" for k in range(60)] for c in "abc"]
    text = lambda k, *more: " ".join([*w[k], *more])
    docs = [(5, text(0)), (None, text(0, "x")), (None, text(0, "x", "y")), (None, text(1)), (None, text(1, "x")), (None, text(1, "x", "y")), (None, text(2))]
    df = odd(spark, [(i, t, "en") for i, t in docs])
    got = result(minhash.near_duplicates(df, 5, 80))
    assert got == brute_components(docs, 5, 80) and sum(k[2] == 5 for k in got.elements()) == 3
    left = [(r.doc_id, r.text.split()[0]) for r in minhash.deduplicated(df, 5, 80).collect()]
    assert sorted(left, key=str) == [(5, "a0"), (None, "b0"), (None, "c0")]


# --- decontamination ---


def slow_score(item, doc):
    rows = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(doc, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (decontam.MATCH if a == b else decontam.MISMATCH), rows[i - 1][j] + decontam.GAP, rows[i][j - 1] + decontam.GAP)
    return max(map(max, rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.lists(st.integers(0, 5), min_size=1, max_size=14))
def test_alignment(item, doc):
    score, matched, first, end = decontam.align(np.array(item, np.uint64), np.array(doc, np.uint64))
    assert score == slow_score(item, doc)
    assert score == slow_score(item, doc[first:end]) and (score == 0) == (matched == 0)


def plain_words(text):
    import re

    return re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute_contaminated(docs, items):
    code = {}
    number = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws], np.uint64)
    items = [(i, number(plain_words(t))) for i, t in items]
    out = Counter()
    for d, t in docs:
        doc = number(plain_words(t))
        for i, item in items:
            if len(item) and len(doc):
                score = decontam.align(item, doc)[0] / (decontam.MATCH * len(item))
                if score >= decontam.THRESHOLD:
                    out[d, i, round(score, 6)] += 1
    return out


def test_contaminated(spark, sf):
    docs, bench = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = brute_contaminated([(r.doc_id, r.text) for r in docs.collect()], items)
    got = decontam.contaminated(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id, round(r.score, 6)) for r in got) == want and want
    left = decontam.clean(docs, bench)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {k[0] for k in want}


def test_edited_copies_and_blocks(spark, monkeypatch):
    rng = random.Random(4)
    item = [f"i{rng.randrange(10**5)}" for _ in range(40)]
    other = [f"o{k}" for k in range(600)]
    edited = list(item)
    for k in (7, 15, 23, 31):
        edited[k] = "changed"
    del edited[11:13]
    noise = [f"n{rng.randrange(10**5)}" for _ in range(200)]
    docs = [(1, " ".join(noise + item + noise)), (2, " ".join(noise + edited + noise).upper()), (3, " ".join(noise + item[:12] + noise)), (4, " ".join(noise)), (5, " ".join(other)), (6, ", ".join(item)), (7, "tiny item"), (None, " ".join(item)), (8, None), (8, "")]
    df = odd(spark, [(i, t, "en") for i, t in docs] + [(100 + i, " ".join(item), "en") for i in range(150)])
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (2, " ".join(other), "x"), (3, "tiny item", "x"), (4, None, "x"), (5, "", "x"), (None, "no such item", "x")], "item_id long, text string, score string")
    want = {(1, 1), (2, 1), (5, 2), (6, 1), (7, 3), (None, 1)} | {(100 + i, 1) for i in range(150)}
    for block in (decontam.BLOCK, 10):
        monkeypatch.setattr(decontam, "BLOCK", block)
        got = decontam.contaminated(df, bench).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert all(0.5 <= r.score <= 1 for r in got)
        left = decontam.clean(df, bench)
        assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 8, 8]
    assert decontam.contaminated(empty(spark), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_edited_copies_in_many_documents(spark):
    """No copy is exact, and all are edited in the same places, so that every n-gram that is left is in all of them."""
    item = [f"i{k}" for k in range(40)]
    fifth = ["changed" if k % 5 == 4 else w for k, w in enumerate(item)]
    third = ["changed" if k % 3 == 2 else w for k, w in enumerate(item)]
    apart = [x for w in item for x in (w, "and")]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for copy in (fifth, third, apart):
        df = odd(spark, [(i, f"n{i} m{i} " + " ".join(copy) + f" o{i}", "en") for i in range(130)])
        want = brute_contaminated([(r.doc_id, r.text) for r in df.collect()], [(1, " ".join(item))])
        assert len(want) == 130 and Counter((r.doc_id, r.item_id, round(r.score, 6)) for r in decontam.contaminated(df, bench).collect()) == want
        assert decontam.clean(df, bench).count() == 0


def test_search_is_exact(monkeypatch):
    rng = random.Random(5)
    for common in (0, 1, 64) * 40:
        monkeypatch.setattr(decontam, "COMMON", common)
        threshold, size = rng.choice([0.3, 0.5, 0.7, 1.0]), rng.choice([4, 30])
        some = lambda least, most: [rng.randrange(size) for _ in range(rng.randrange(least, most))]
        items = [np.array(some(1, 30), np.uint64) for _ in range(3)]
        docs = [np.array(some(0, 20) + [w for x in items[rng.randrange(3)].tolist() for w in rng.choice([[x], [x], [x], [], [size], [x, size]])] + some(0, 20), np.uint64) for _ in range(4)]
        block, h = decontam._block([0, 1, 2], items, threshold), np.concatenate(docs)
        got = {(r, s): score for r, s, score, *_ in decontam._search(block, h, np.cumsum([0, *map(len, docs)]), threshold)}
        scores = {(r, s): decontam.align(item, doc)[0] / (decontam.MATCH * len(item)) for r, doc in enumerate(docs) if len(doc) for s, item in enumerate(items)}
        assert got == {k: x for k, x in scores.items() if x >= threshold}


def test_long_items_are_aligned_whole(spark):
    item = [f"i{k}" for k in range(257)]
    long = [f"l{k}" for k in range(900)]
    third = ["changed" if k % 3 == 2 else w for k, w in enumerate(long)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long))], "item_id long, text string")
    texts = ["just one word i256 of it", " ".join(item), " ".join(["a"] * 40 + third + ["b"] * 40), " ".join(long[:300]), " ".join(long[200:700])]
    df = odd(spark, [(i, t, "en") for i, t in enumerate(texts)])
    want = brute_contaminated([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert set((d, i) for d, i, _ in want) == {(1, 1), (2, 2), (4, 2)}
    assert Counter((r.doc_id, r.item_id, round(r.score, 6)) for r in decontam.contaminated(df, bench).collect()) == want
    assert sorted(r.doc_id for r in decontam.clean(df, bench).collect()) == [0, 3]


def test_alignment_by_parts(monkeypatch):
    rng = random.Random(6)
    for _ in range(200):
        item, doc = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, 25))], np.uint64) for _ in range(2))
        monkeypatch.setattr(decontam, "ROWS", 256)
        whole = decontam.align(item, doc)
        assert whole[0] == slow_score(item.tolist(), doc.tolist())
        monkeypatch.setattr(decontam, "ROWS", rng.choice([1, 2, 5]))
        assert decontam.align(item, doc) == whole


# --- language model ---


def brute_lm(rows, order):
    """rows: (doc_id, text). Counts in dictionaries, and the interpolation by its definition."""
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    docs = [(i, held(i), ["<", *words(t), ">"]) for i, t in rows]
    counts = [Counter() for _ in range(order + 1)]
    for _, out, ws in docs:
        if not out:
            for n in range(1, order + 1):
                for k in range(max(n - 1, 1), len(ws)):
                    counts[n][tuple(ws[k - n + 1 : k + 1])] += 1
    total, kinds = sum(counts[1].values()), len(counts[1])
    begins = sum(not out for _, out, _ in docs)
    bucket = lambda c: int(lm.bucket(np.array([c]))[0])
    context = lambda g: begins if g == ("<",) else counts[len(g)][g]
    weights = {}
    for n in range(2, order + 1):
        stats = np.zeros((3, lm.BUCKETS))
        for g, c in counts[n].items():
            stats[:2, bucket(context(g[:-1]))] += c, c == 1
        weights[n] = lm.Level(np.zeros(0), stats, np.zeros(0)).weights()
    unknown = min(max(sum(c == 1 for c in counts[1].values()) / total, lm.LEAST_WEIGHT), 0.5) if total else 1.0

    def p(gram):
        if len(gram) == 1:
            return (1 - unknown) * counts[1][gram] / total if counts[1][gram] else unknown
        c = context(gram[:-1])
        low = p(gram[1:])
        if not c:
            return low
        w = weights[len(gram)][bucket(c)]
        return (1 - w) * counts[len(gram)][gram] / c + w * low

    out = []
    for i, h, ws in docs:
        base = sum(math.log10((counts[1][w,] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws[1:])
        score = sum(math.log10(p(tuple(ws[max(0, k - order + 1) : k + 1]))) for k in range(1, len(ws)))
        out.append((i, h, len(ws) - 1, sum(counts[1][w,] > 0 for w in ws[1:]), total, round(base, 4), round(score, 4)))
    return Counter(out)


def scored(df):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in df.collect())


def close(a, b):
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    a, b = sorted(a.elements(), key=key), sorted(b.elements(), key=key)
    return len(a) == len(b) and all(x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-2 and abs(x[6] - y[6]) < 1e-2 for x, y in zip(a, b))


def test_scores(spark, sf):
    """In one block and in several, of which each knows its own n-grams."""
    for docs, orders in ((documents(spark, sf), (1, 3)), (documents(spark, sf).repartition(7, "doc_id"), (2, 3)), (odd(spark), (1, 2, 3))):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        for order in orders:
            assert close(scored(lm.score(docs, lm.split(docs), order, 3)), brute_lm(rows, order))
    none = empty(spark)
    assert lm.score(none, lm.split(none)).count() == 0


def test_scores_beat_the_base_on_held_out_text(spark, sf):
    rows = [r for r in queries.op3_lm_scoring(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scores_without_training(spark):
    docs = odd(spark)
    rows = lm.score(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in rows} == {0} and {r.n_known for r in rows} == {0} and {r.score for r in rows} == {0.0}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=50), st.integers(1, 9))
def test_packed_keys(keys, parts):
    a = np.sort(np.array(keys, np.uint64))
    assert lm.unpack_keys(lm.pack_keys(a)).tolist() == a.tolist()
    cut = lm.ranges(a, parts)
    assert len(cut) == parts + 1 and (np.diff(cut) >= 0).all() and cut[-1] == len(a)


def blocks_of(texts, train, n):
    """Tokens of n blocks, text by text in turn."""
    out = []
    for k in range(n):
        raw, offs = textvec.buffers(pa.array(texts[k::n], pa.string()))
        out.append(lm.tokens(raw, offs, np.array(train[k::n], bool)))
    return out


def levels_of(blocks, order, parts=3):
    """Each block's levels, by its requests and the ranges' answers, without Spark."""
    answers = [[] for _ in blocks]
    for level in range(1, order + 1):
        asked = []
        for k, t in enumerate(blocks):
            before = lm._levels(t, pa.concat_tables(answers[k]), parts)[level - 1] if level > 1 else None
            asked.append(pa.Table.from_batches([lm._request(k, t, level, before, parts)]))
        asked = pa.concat_tables(asked)
        for part in range(parts):
            told = lm._answer(asked.filter(pc.equal(asked["part"], part)))
            for k in range(len(blocks)):
                answers[k].append(told.filter(pc.equal(told["block"], k)))
    return [lm._levels(t, pa.concat_tables(a), parts) for t, a in zip(blocks, answers, strict=True)]


def test_blocks_know_what_one_block_would():
    """Counts, statistics and scores are the same however the texts are packed, with words that one, two or all blocks have."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice([f"w{rng.randrange(9)}", f"v{rng.randrange(300)}", f"u{i}x{rng.randrange(4)}"]) for _ in range(rng.randrange(30))) for i in range(90)]
    train = [i % 3 != 1 for i in range(90)]
    whole = blocks_of(texts, train, 1)
    one = levels_of(whole, 3)[0]
    want = lm.walk(whole[0], one)
    for n in (2, 5):
        blocks = blocks_of(texts, train, n)
        for k, (t, levels) in enumerate(zip(blocks, levels_of(blocks, 3), strict=True)):
            for level in (1, 2, 3):
                assert np.array_equal(levels[level].stats, one[level].stats)
            got = lm.walk(t, levels)
            assert got[2] == want[2]
            for j, i in enumerate(range(k, 90, n)):
                a, b = slice(*t.bounds[j : j + 2]), slice(*whole[0].bounds[i : i + 2])
                assert all(np.array_equal(levels[level].counts[a], one[level].counts[b]) for level in (1, 2, 3))
                assert np.allclose(got[1][a], want[1][b])


def test_probabilities_add_up():
    """Over the known words, the end and the unknown word, after contexts that occur and others, in every order."""
    rng = random.Random(2)
    texts = [" ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(1, 25))) for _ in range(120)]
    known = sorted({w for t in texts for w in t.split()})
    contexts = ["", "w0", "w1 w0", "w3 w3", "never", "never w2", " ".join(texts[0].split()[:2])]
    probes = [f"{c} {w}" for c in contexts for w in [*known, "unseen!"]] + [c or "w0" for c in contexts[1:]]
    for order in (1, 2, 3):
        t = blocks_of(texts + probes, [True] * len(texts) + [False] * len(probes), 1)[0]
        _, score, _ = lm.walk(t, levels_of([t], order)[0])
        after = {}
        for k, probe in enumerate(probes, len(texts)):
            a, b = t.bounds[k], t.bounds[k + 1]
            ws = probe.split()
            after.setdefault(" ".join(ws[:-1]), {})[ws[-1]] = 10 ** score[b - 2]
            after.setdefault(" ".join(ws), {})[">"] = 10 ** score[b - 1]
        # An empty text has the end alone: its place is that of the first word of others.
        empty_ = blocks_of([*texts, ""], [True] * len(texts) + [False], 1)[0]
        after[""][">"] = 10 ** lm.walk(empty_, levels_of([empty_], order)[0])[1][-1]
        for c in contexts:
            assert abs(sum(after[c][w] for w in [*known, "unseen!", ">"]) - 1) < 1e-9


# --- pipeline ---


def test_pipeline(spark, sf):
    docs = documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = langid.train(docs)
    kept = langid.accepted(docs, model).select("doc_id").collect()
    rows = [r for r in rows if r[0] in {k.doc_id for k in kept}]
    assert {i for i, t in rows} == {i for i, t in [(r.doc_id, r.text) for r in docs.collect()] if any(c.isalpha() for c in t or "")}
    firsts = {k[0] for k in brute_components(rows, 5, 80) if k[3]}
    rows = [r for r in rows if r[0] in firsts]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {k[0] for k in brute_contaminated(rows, items)}
    ranks = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = {i: len(b"".join([])) if not t else sum(len(ranks.merge(p.encode())) for p in bpe.pretokens([t])[0]) for i, t in rows if i not in leaked}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and leaked and len(want) < docs.count()


def test_stages_keep_columns_and_odd_rows(spark, sf):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, empty(spark), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_pipeline_over_an_empty_table(spark, sf, tmp_path):
    documents(spark, sf).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "offsets", "ids_sha256", "decoded_sha256"] and out.count() == 0
    # Without a benchmark nothing is contaminated.
    documents(spark, sf).limit(5).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_decontamination_ties(spark):
    """Items of one text each have a row, and so does each of several equally good places' document."""
    text = " ".join(f"w{k}" for k in range(20))
    bench = spark.createDataFrame([(1, text), (2, text), (2, text)], "item_id long, text string")
    df = odd(spark, [(1, f"{text} and {text}", "en"), (1, f"{text} and {text}", "en"), (2, "other", "en")])
    got = sorted(map(tuple, decontam.contaminated(df, bench).select("doc_id", "item_id", "score", "first_word").collect()))
    assert got == [(1, 1, 1.0, 0), (1, 1, 1.0, 0), (1, 2, 1.0, 0), (1, 2, 1.0, 0)]


def test_many_edited_copies_and_item_lengths(spark):
    """1, 100, 101 and 1,000 copies of an edited item are all found; items of 255 to 1,000 words flag no clean document."""
    rng = random.Random(9)
    item = [f"i{k}" for k in range(40)]
    copy = ["changed" if k % 5 == 4 else w for k, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for n in (1, 100, 101, 1000):
        df = spark.createDataFrame([(i, f"a{i} " + " ".join(copy) + f" b{i}") for i in range(n)], "doc_id long, text string")
        assert decontam.contaminated(df, bench).count() == n
    words_ = [f"v{k}" for k in range(3000)]
    clean = spark.createDataFrame([(i, " ".join(rng.choice(words_) for _ in range(120))) for i in range(300)], "doc_id long, text string")
    items = [(n, " ".join(rng.choice(words_) for _ in range(n))) for n in (255, 256, 257, 300, 1000)]
    long = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contaminated(clean, long).count() == 0 and decontam.clean(clean, long).count() == 300
    held = spark.createDataFrame([(n, "x y z " + t) for n, t in items], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(held, long).collect()} == {(n, n) for n, _ in items}
