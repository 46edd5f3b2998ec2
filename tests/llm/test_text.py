"""Sharding, token counts, byte BPE, language ID and the shared word hashes."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe, langid, queries, sharding, textvec, tokcount
from tests.llm.data import documents, empty, odd, odd_rows, words
from tests.oracle import both

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aAbsdtmlrve'  \n\t12!_▁")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=12)


# --- hashes ---


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_texts(texts):
    got = []
    for _, _, raw, offs in textvec.chunks(pa.array(texts, pa.string()), 50):
        h, starts, ends, bounds = textvec.words(raw, offs)
        low = raw.tobytes()
        for i in range(len(offs) - 1):
            got.append([(low[starts[k] : ends[k]].decode(), int(h[k])) for k in range(bounds[i], bounds[i + 1])])
    assert [[w for w, _ in g] for g in got] == [[w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w] for t in texts]
    seen = {}
    for g in got:
        for w, h in g:
            assert seen.setdefault(words(w)[0], h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_texts_hash_alike(monkeypatch):
    text = " ".join(f"w{i % 50}" + "x" * (i % 7) for i in range(3000)) + " " + "y" * 500
    raw, offs = textvec.buffers(pa.array([text]))
    want = textvec.words(raw, offs)[0]
    monkeypatch.setattr(textvec, "CHUNK", 100)
    assert (textvec.words(raw, offs)[0] == want).all()


def test_table_evicts_without_mixing():
    """Hashes of one bit, of a few and of all 64: spans of equal hashes keep runs of their own."""
    t = textvec.Table(bits=4, limit=64)
    for seed in range(60):
        rng = np.random.default_rng(seed)
        raw, offs = textvec.buffers(pa.array([str(x) * (1 + x % 90) for x in rng.integers(1, 200, 60).tolist()]))
        starts, ends = offs[:-1], offs[1:]
        h = textvec.hash_spans(raw, starts, ends) & np.uint64((1, 15, (1 << 64) - 1)[seed % 3])
        code = lambda i: [int(raw[starts[i] : ends[i]].sum()) * 1000 + int(ends[i] - starts[i])] * (int(raw[starts[i]]) % 3)  # noqa: B023, E731
        make = lambda which: (np.array([x for i in which for x in code(i)], np.uint32), np.array([len(code(i)) for i in which], np.int64))  # noqa: B023, E731
        start, length = t.get(h, raw, starts, ends, make)
        assert all(t.pool[a : a + n].tolist() == code(i) for i, (a, n) in enumerate(zip(start, length, strict=True)))


def thue_morse(n, a="a", b="b"):
    """Words of n letters in Thue-Morse order and its complement: polynomial hashes modulo 2^64 have them equal."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_long_words_of_a_structure():
    sp, enc = tokcount.processor(MODEL), library()
    for n in (1024, 2048, 4096, 8192):
        for a, b in ("ab", "xq", "09"):
            pair = list(thue_morse(n, a, b))
            raw, offs = textvec.buffers(pa.array(pair))
            h = textvec.words(raw, offs)[0]
            assert h[0] != h[1]
            assert encoded(pair) == [enc.encode_ordinary(t) for t in pair]
            assert counted(pair) == [len(sp.encode(t)) for t in pair]


def counted(texts, table=None):
    """Token counts by the cache, one process, as token_counts() looks them up."""
    sp, out, table = tokcount.processor(MODEL), [], table or textvec.Table()
    for _, _, raw, offs in textvec.chunks(pa.array(texts, pa.string())):
        starts, ends, begins = tokcount.split(raw, offs)
        make = lambda which: (np.array([tokcount.count_piece(sp, raw.tobytes()[starts[i] : ends[i]], bool(begins[i])) for i in which], np.uint32), np.ones(len(which), np.int64))  # noqa: B023, E731
        start, _ = table.get(tokcount.keys(raw, starts, ends, begins), raw, starts, ends, make)
        sums = np.concatenate([[0], np.cumsum(table.pool[start])])
        out += np.diff(sums[np.searchsorted(starts, offs)]).astype(int).tolist()
    return out


LONG_WORDS = st.lists(st.builds(lambda w, n, t: (w * n)[: len(w) * n - t % 7] + " " + w, st.text("ab é漢", min_size=1, max_size=9), st.integers(1, 120), st.integers(0, 99)), max_size=5)


@settings(max_examples=60, deadline=None)
@given(LONG_WORDS)
def test_long_words_are_the_librarys(texts):
    assert encoded(texts) == [library().encode_ordinary(t) for t in texts]
    assert counted(texts) == [len(tokcount.processor(MODEL).encode(t)) for t in texts]


# --- sharding ---


def test_sharding_sql(spark, sf):
    mine, theirs = both(spark, sf, queries.op1_sharding, queries.ORACLES["op1_sharding"])
    assert mine == theirs


def test_sharding_odd(spark):
    rows = sharding.shard(odd(spark), 5).collect()
    assert len(rows) == len(odd_rows())
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 5) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    assert sharding.shard(empty(spark), 5).count() == 0


def test_rows_of_one_key_are_numbered_in_parts(spark):
    docs = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('t', id) AS text")
    rows = sharding.shard(docs, 4).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(3000))


def test_sharding_weights_and_growth(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    got = Counter(r.shard for r in sharding.shard(docs, 3, [1, 2, 1]).collect())
    assert abs(got[1] / 20_000 - 0.5) < 0.02
    four = {r.doc_id: r.shard for r in sharding.shard(docs, 4).collect()}
    moved = [r for r in sharding.shard(docs, 3).collect() if four[r.doc_id] != r.shard]
    assert all(four[r.doc_id] == 3 == r.grown_shard for r in moved) and abs(len(moved) / 20_000 - 0.25) < 0.02


# --- token counts ---


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_counts_are_the_librarys(texts):
    sp = tokcount.processor(MODEL)
    got = []
    for _, _, raw, offs in textvec.chunks(pa.array(texts, pa.string())):
        starts, ends, begins = tokcount.split(raw, offs)
        n = [tokcount.count_piece(sp, raw.tobytes()[a:b], bool(c)) for a, b, c in zip(starts, ends, begins)]
        got += np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offs)]).astype(int).tolist()
    assert got == [len(sp.encode(t)) for t in texts]


def test_token_counts(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for docs in (documents(spark, sf), odd(spark), empty(spark)):
        want = Counter((r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in docs.collect())
        for warm in (0, 3, tokcount.WARM_ROWS):
            assert Counter(map(tuple, tokcount.token_counts(docs, MODEL, warm_rows=warm).collect())) == want


# --- byte BPE ---


def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(RANKS).ranks, special_tokens={})


def encoded(texts):
    out, codec = [], bpe.codec(RANKS)
    for _, _, raw, offs in textvec.chunks(pa.array(texts, pa.string())):
        ids, at = codec.encode_batch(raw, offs)
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_ids_are_the_librarys(texts):
    enc = library()
    assert encoded(texts) == [enc.encode_ordinary(t) for t in texts]


def test_classes_of_codepoints():
    enc, texts = library(), [a + chr(c) + "!" for c in range(0, 0x110000, 3) if not 0xD800 <= c < 0xE000 for a in ("a", " ")]
    assert encoded(texts) == [enc.encode_ordinary(t) for t in texts]


def test_pretokens_and_merges():
    assert bpe.pretokens(["we'll  go\n x", "", "a'sb"]) == [["we", "'ll", " ", " go", "\n", " x"], [], ["a", "'s", "b"]]
    ranks = bpe.codec(RANKS).ranks
    rng = np.random.default_rng(7)
    for piece in (b" tokenizer", "ünï".encode(), b"aaaaaaa", b"x", *(rng.integers(97, 97 + k, n).astype(np.uint8).tobytes() for k in (1, 2, 26) for n in (5, 60, 255, 256, 257, 3000))):
        want = library()._core_bpe.encode_single_piece(piece)
        assert bpe.merge_pairs(piece, ranks) == want
        ids, length = bpe.codec(RANKS).merge_many([b"x", piece, b"zqzqzq", piece])
        assert np.split(ids, np.cumsum(length))[1].tolist() == want == np.split(ids, np.cumsum(length))[3].tolist()
        assert len(piece) == 1 or piece in ranks or bpe._merge_long(piece, ranks) == want


def test_scan_is_the_product_from_the_left():
    _, product, _, _ = bpe.monoid()
    e = np.random.default_rng(1).integers(0, 15, 70_000).astype(np.uint8)
    out, acc = bpe.scan(e, product), 0
    for i, x in enumerate(e.tolist()):
        acc = int(product[acc << 4 | x])
        assert out[i] == acc


def test_byte_bpe(spark, sf):
    enc = library()
    for docs in (documents(spark, sf), odd(spark), empty(spark)):
        want = Counter()
        for r in docs.collect():
            ids = np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()
            want[r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        got = bpe.encode(docs, RANKS)
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
        back = Counter((r.doc_id, r.text) for r in bpe.decode(got, RANKS).collect())
        assert back == Counter((r.doc_id, r.text or "") for r in docs.collect())
        for a, b in ((0, 10), (7, 50), (100, None), (5, 5)):
            cut = Counter((r.doc_id, r.text) for r in bpe.decode(got, RANKS, a, b).collect())
            assert cut == Counter((r.doc_id, (r.text or "").encode()[a:b].decode("utf-8", "replace")) for r in docs.collect())


# --- language ID ---


def test_language_of_held_out_documents(spark, sf):
    docs = documents(spark, sf)
    got = langid.split_and_identify(docs)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.held_out for r in rows} == {True, False}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def brute_language(model, text):
    """The classifier on one text, word by word."""
    import regex

    def entry(level, s):
        c = np.array([ord(x) for x in s], np.uint32)
        return int(model.find(level, langid._spans(textvec.padded(c.view(np.uint8)), np.array([0]), np.array([len(c)])))[0])

    total = model.prior.copy()
    found = regex.findall(r"\p{L}+", text or "")
    for w in found:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
        if (k := entry(0, low)) >= 0:
            total += model.logs[0][k]
            continue
        at = 0
        while at < len(low):
            for n in range(langid.ORDER, 0, -1):
                if at + n <= len(low) and (k := entry(n, low[at : at + n])) >= 0:
                    total += model.logs[n][k] + langid.BACKOFF * (langid.ORDER - n + 1)
                    at += n
                    break
            else:
                at += 1
    if not found:
        return "und", 0.0
    p = 10 ** np.maximum(total - total.max(), -300)
    return model.langs[int(total.argmax())], float(1 / p.sum())


def test_language_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    model = langid.train(docs.filter(~langid.held_out(docs)))
    rows = docs.limit(40).collect() + odd(spark).filter("length(text) < 100 OR text IS NULL").collect()
    col = pa.array([r.text for r in rows], pa.string())
    got = [(a, b) for _, _, raw, offs in textvec.chunks(col) for a, b in zip(*model.classify(raw, offs))]
    for r, (lang, score) in zip(rows, got):
        want, p = brute_language(model, r.text)
        assert lang == want and abs(score - p) < 1e-6


def brute_train(rows, most_words, most_grams):
    """(level, n-gram) → counts by language, the languages' totals by level and their rows."""
    import regex

    counts, totals, docs = [{} for _ in range(langid.ORDER + 1)], [Counter() for _ in range(langid.ORDER + 1)], Counter()
    for text, lang in rows:
        if text is None or lang is None:
            continue
        docs[lang] += 1
        for w in regex.findall(r"\p{L}+", text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
            for level in range(langid.ORDER + 1):
                for s in [low] if level == 0 else [low[i : i + level] for i in range(len(low) - level + 1)]:
                    counts[level].setdefault(s, Counter())[lang] += 1
                    totals[level][lang] += 1
    code = lambda s: int(langid._spans(textvec.padded(np.array([ord(x) for x in s], np.uint32).view(np.uint8)), np.array([0]), np.array([len(s)])).view(np.int64)[0])
    kept = []
    for level, of in enumerate(counts):
        known = [(-sum(c.values()), code(s), c) for s, c in of.items() if level or sum(c.values()) >= langid.KNOWN]
        most = most_grams if level else most_words
        kept.append({h: c for _, h, c in sorted(known, key=lambda x: x[:2])[:most]})
    return kept, totals, docs


def test_training_against_brute_force(spark, sf):
    """Ties at the bound go to the least hash; with no bound all entries are there."""
    sample = documents(spark, sf).filter("doc_id < 60").union(odd(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = [(r.text, r.lang) for r in sample.collect()]
    for words, grams, held in ((None, None, 1 << 20), (50, 30, 1 << 20), (7, 1, 1)):
        langid.HELD = held
        model = langid.train(sample, None, words, grams)
        kept, totals, docs = brute_train(rows, words, grams)
        assert model.langs == sorted(docs)
        assert np.allclose(model.prior, np.log10([docs[x] / sum(docs.values()) for x in model.langs]))
        for level in range(langid.ORDER + 1):
            assert set(model.keys[level].view(np.int64).tolist()) == set(kept[level])
            of = np.array([[kept[level][h][x] for x in model.langs] for h in model.keys[level].view(np.int64).tolist()])
            want = np.log10((of + 0.5) / (np.array([totals[level][x] for x in model.langs]) + 0.5 * (len(of) + 1)))
            assert np.allclose(model.logs[level], want)
    langid.HELD = 1 << 20


def test_language_ties(spark):
    docs = spark.createDataFrame([(1, "aa bb aa bb", "x"), (2, "aa bb aa bb", "a"), (3, "cc", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.train(docs)).collect()}
    assert got == {1: ("a", 0.5), 2: ("a", 0.5), 3: ("a", 0.5)}


def test_language_odd(spark):
    docs = odd(spark)
    got = langid.split_and_identify(docs).collect()
    want = {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")}
    assert len(got) == docs.count() and {r.doc_id for r in got if r.lang_pred == "und"} == want
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.split_and_identify(empty(spark)).count() == 0
    nothing = langid.identify(docs, langid.train(empty(spark))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    kept = langid.accepted(docs, langid.train(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - want
