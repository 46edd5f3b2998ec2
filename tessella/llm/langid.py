"""Language identification, words first.

A word that the model knows scores its log frequency in each language. An unseen word is split from the left into the
longest character n-grams that the model knows, from the longest order down to one character, each step down costing a
penalty; what even no single character covers says nothing. A text's language is the one of the highest sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm import textvec
from tessella.llm.shared import bound_batches, returning, texts

#: Labelled rows that the model is fitted on, about: those of the smallest hashes.
SAMPLE_ROWS = 20_000
#: Entries of the model at most, for words and for each order of n-grams: the most frequent, of equal ones those of the
#: least hashes. None: all. The model is broadcast, so they are its bound: 32 bytes an entry and eight for each language.
WORDS, GRAMS = 60_000, 20_000
#: Counts that a task holds before it hands them on.
HELD = 1 << 20
#: Levels under which rows and occurrences in all are counted.
TOTALS, DOCS = 100, 200
ORDER = 4
#: A word is known from so many occurrences on.
KNOWN = 2
#: log10 cost of one order less.
BACKOFF = -0.4
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """Whether each codepoint is a letter."""
    out = np.zeros(0x110000, bool)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for m in regex.finditer(r"\p{L}+", every):
        out[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] = True
    return out


@cache
def _lower() -> np.ndarray:
    """Lower case of every codepoint that has a single one."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
            out[c] = ord(low)
    return out


@dataclass
class Words:
    """Words (runs of letters, lower-cased) of some rows: codepoints of all rows as padded bytes, and where words begin and end."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words(raw: np.ndarray, offs: np.ndarray) -> Words:
    codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), offs)
    letter = _letters()[codes]
    first = np.zeros(len(codes) + 1, bool)
    first[at] = True
    start, last = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1] | first[1:-1]
    last[:-1] &= ~letter[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return Words(textvec.padded(_lower()[codes].view(np.uint8)), starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at))


def _spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return textvec.hash_padded(codes, 4 * starts, 4 * (ends - starts))


def _grams(w: Words, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, word of each) of the n-grams inside the given words."""
    count = np.maximum(w.ends[which] - w.starts[which] - n + 1, 0)
    owner = np.repeat(np.arange(len(which)), count)
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = w.starts[which][owner] + inside
    return _spans(w.codes, at, at + n), at, owner


@dataclass
class Model:
    """Sorted keys with log10 frequencies by language: words at 0, n-grams at 1 to ORDER. Bounded by WORDS and GRAMS."""

    langs: list[str]
    prior: np.ndarray
    keys: list[np.ndarray]
    logs: list[np.ndarray]

    def find(self, level: int, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        keys = self.keys[level]
        if not len(keys):
            return np.full(len(h), -1)
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return np.where(keys[at] == h, at, -1)

    def word_scores(self, w: Words, which: np.ndarray) -> np.ndarray:
        """log10 scores by language of unseen words: at each place the longest known n-gram is taken and skipped."""
        out = np.zeros((len(which), len(self.langs)))
        at, end = w.starts[which].copy(), w.ends[which]
        live = np.arange(len(which))
        while len(live):
            here, stop = at[live], end[live]
            step = np.zeros(len(live), np.int64)
            for n in range(ORDER, 0, -1):
                todo = np.flatnonzero((step == 0) & (here + n <= stop))
                if not len(todo):
                    continue
                found = self.find(n, _spans(w.codes, here[todo], here[todo] + n))
                hit = todo[found >= 0]
                out[live[hit]] += self.logs[n][found[found >= 0]] + BACKOFF * (ORDER - n + 1)
                step[hit] = n
            at[live] += np.maximum(step, 1)
            live = live[at[live] < end[live]]
        return out

    def classify(self, raw: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each row; no letter: undetermined, 0."""
        w = words(raw, offs)
        n_rows, k = len(offs) - 1, len(self.langs)
        h = _spans(w.codes, w.starts, w.ends)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        scores = np.zeros((len(unique), k))
        found = self.find(0, unique)
        scores[found >= 0] = self.logs[0][found[found >= 0]]
        rest = np.flatnonzero(found < 0)
        scores[rest] = self.word_scores(w, first[rest])
        sums = np.zeros((len(h) + 1, k))
        np.cumsum(scores[inverse], axis=0, out=sums[1:])
        n_words = np.diff(w.bounds)
        total = sums[w.bounds[1:]] - sums[w.bounds[:-1]] + self.prior
        if not k:
            return [UNDETERMINED] * n_rows, np.zeros(n_rows)
        best = total.argmax(1)
        gap = np.maximum(total - total.max(1, keepdims=True), -300)
        score = np.where(n_words > 0, 1 / (10**gap).sum(1), 0.0)
        return [self.langs[b] if n else UNDETERMINED for b, n in zip(best.tolist(), n_words.tolist())], score


def _logs(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """log10 of smoothed frequencies: half an occurrence of everything in every language."""
    return np.log10((counts + 0.5) / (totals + 0.5 * (len(counts) + 1))) if len(counts) else counts


def _counts(rows: DataFrame) -> DataFrame:
    """level, hash, lang, n of the rows (lang, text): occurrences, summed within a task as far as HELD entries go.

    Level 0 has words, 1 to ORDER n-grams. Under TOTALS + level a language's occurrences in all, under DOCS its rows, both with hash 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            sizes = [len(h) for h, _ in held.values()]
            every = list(held.values()) or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            levels, langs = np.repeat([k[1] for k in held], sizes).astype(np.int32), np.repeat(np.array([k[0] for k in held], object), sizes)
            hashes, counts = (np.concatenate([p[i] for p in every]) for i in range(2))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(levels), pa.array(hashes.view(np.int64)), pa.array(langs, pa.string()), pa.array(counts)], ["level", "hash", "lang", "n"])

        def add(lang: str, level: int, h: np.ndarray, n: np.ndarray) -> None:
            if (lang, level) in held:
                h, n = (np.concatenate([x, y]) for x, y in zip(held[lang, level], (h, n), strict=True))
                h, inverse = np.unique(h, return_inverse=True)
                n = np.bincount(inverse, n, len(h)).astype(np.int64)
            held[lang, level] = (h, n)

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                mine = [x == lang for x in langs]
                add(lang, DOCS, np.zeros(1, np.uint64), np.array([sum(mine)]))
                for _, _, raw, offs in textvec.chunks(batch.column(1).filter(pa.array(mine))):
                    w = words(raw, offs)
                    every = np.arange(len(w.starts))
                    for level in range(ORDER + 1):
                        h = _spans(w.codes, w.starts, w.ends) if level == 0 else _grams(w, level, every)[0]
                        add(lang, level, *np.unique(h, return_counts=True))
                        add(lang, TOTALS + level, np.zeros(1, np.uint64), np.array([len(h)]))
            if sum(len(h) for h, _ in held.values()) > HELD:
                yield flush()
        yield flush()

    return rows.mapInArrow(returning(run), "level int, hash long, lang string, n long").groupBy("level", "hash", "lang").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, sample_rows: int | None = SAMPLE_ROWS, most_words: int | None = WORDS, most_grams: int | None = GRAMS) -> Model:
    """Fit on about sample_rows rows (doc_id, text, lang): all (also for None), or that share of them with the smallest hashes.

    Rows with a null lang or text are left out. Words and n-grams are counted by partial aggregation and their counts are
    exact; most_words and most_grams bound what the model keeps of them (None: all), no count or total. Without rows there
    are no languages, and every text is undetermined.
    """
    spark = labelled.sparkSession
    bound_batches(spark)
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if sample_rows is not None and (n := labelled.count()) > sample_rows:
        labelled = labelled.filter(F.xxhash64("doc_id", "text").cast("double") < F.lit((2 * sample_rows / n - 1) * 2.0**63))
    counts = _counts(labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    entries = counts.groupBy("level", "hash").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))
    within = lambda most: F.lit(True) if most is None else F.col("place") <= most
    place = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("total"), "hash"))
    kept = entries.filter((F.col("level") != 0) | (F.col("total") >= KNOWN)).withColumn("place", place)
    got = kept.filter((F.col("level") >= TOTALS) | ((F.col("level") == 0) & within(most_words)) | ((F.col("level") > 0) & within(most_grams))).select("level", "hash", "by").collect()
    alone = {r.level: {x.lang: x.n for x in r.by} for r in got if r.level >= TOTALS}
    langs = sorted(alone.get(DOCS, {}))
    docs = np.array([alone[DOCS][x] for x in langs], float)
    keys, logs = [], []
    for level in range(ORDER + 1):
        mine = [r for r in got if r.level == level]
        h = np.array([r.hash for r in mine], np.int64).view(np.uint64)
        order = np.argsort(h)
        counts_ = np.zeros((len(mine), max(len(langs), 1)))
        for i, r in enumerate(mine):
            for x in r.by:
                counts_[i, langs.index(x.lang)] = x.n
        totals = np.array([alone.get(TOTALS + level, {}).get(x, 0) for x in langs] or [0], float)
        keys.append(h[order])
        logs.append(_logs(counts_[order], totals))
    return Model(langs, np.log10(docs / docs.sum()) if langs else np.zeros(0), keys, logs)


def identify(docs: DataFrame, model: Model, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the extra columns, lang_pred and score (the posterior, 0 to 1) for each row, from the whole text alone.

    A null text, or one without a letter, is 'und' with score 0. Repeated rows and null doc_ids stay; of languages with
    equal sums the first by name is taken; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    extra = extra or {}
    base = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("_text"), *[c.alias(n) for n, c in extra.items()])
    kept = [(n, t) for n, t in base.dtypes if n != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores: list[np.ndarray] = []
            for _, _, raw, offs in textvec.chunks(batch.column(1)):
                a, b = shared.value.classify(raw, offs)
                langs += a
                scores.append(b)
            cols = [c for i, c in enumerate(batch.columns) if i != 1]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(score)], [*(n for n, _ in kept), "lang_pred", "score"])

    return base.mapInArrow(returning(run), ", ".join(f"`{n}` {t}" for n, t in kept) + ", lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is determined with a posterior of at least least."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for _, _, raw, offs in textvec.chunks(batch.column(at)):
                langs, scores = shared.value.classify(raw, offs)
                stays += [x != UNDETERMINED and s >= least for x, s in zip(langs, scores.tolist())]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(returning(run), docs.schema)


def held_out(docs: DataFrame) -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))) % 4 == 2


def split_and_identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from the rows that aren't held out, then doc_id, held_out, lang_pred, score of every row."""
    out = held_out(docs)
    return identify(docs, train(docs.filter(~out), sample_rows), {"held_out": out})
