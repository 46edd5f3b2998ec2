"""Benchmark decontamination: pairs of near words find the places, then Smith-Waterman alignment of words.

The search is exact: it finds what aligning each item with each document would find. An alignment of a share T of the
score of an item of m words has M matched words and at most 2 (M - T m) edits. So of its M - 1 steps from one matched
word to the next at most M - T m have two edits or more, and T m - 1 at least have one at most: both words are then one
or two words apart, in the item and in the document. Documents with that many of an item's pairs, within the words that
such an alignment can span, are aligned with it there; no other can reach T. The score is the alignment's share of the
item's score against itself, so that an edited copy loses by its edits alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import textvec
from tessella.llm.shared import bound_batches, returning, texts

MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of an item's own score.
THRESHOLD = 0.5
#: Pairs that more items of a block hold are looked for only where an item's count can't be reached without them.
COMMON = 64
#: Rows of an alignment that are held at a time; of a longer item's, every so many-th row is kept besides.
ROWS = 256
#: Words of one block of items. A block is broadcast (some 60 bytes a word); a larger benchmark is searched block by block.
BLOCK = 500_000
#: Words of a document that are aligned at a time.
STRETCH = 4096

_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bounds) of words, here runs of letters, digits and bytes over 127."""
    starts, ends = textvec.spans(raw, offs, _BREAKS)
    return textvec.hash_spans(raw, starts, ends), starts, ends, np.searchsorted(starts, offs)


@dataclass
class Block:
    """Items, and their pairs of words sorted by hash: the pair's hash and its item.

    near has a mark at the low bits of each hash. least and span: how many of an item's pairs an alignment that reaches
    the threshold has at least, and in how many words. alone: some item is searched by single words.
    """

    item_ids: list[int | None]
    items: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    near: np.ndarray
    least: np.ndarray
    span: np.ndarray
    alone: bool


def _pairs(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of each word and the one step words on, the same for any step; of the words themselves for 0."""
    if step == 0:
        return h
    with np.errstate(over="ignore"):
        return textvec.mix(h[:-step] * textvec.U(0x9E3779B97F4A7C15) + h[step:])


def _block(ids: list[int | None], items: list[np.ndarray], threshold: float) -> Block:
    sizes = np.array([len(s) for s in items])
    # What T m - 1 leaves without a pair (items of one or two words) is searched by words.
    least = np.array([math.ceil(threshold * m - 1e-9) - 1 for m in sizes.tolist()])
    alone = least < 1
    parts = [[(0, s)] if one else [(1, _pairs(s, 1)), (2, _pairs(s, 2))] for s, one in zip(items, alone.tolist(), strict=True)]
    h = np.concatenate([g for part in parts for _, g in part])
    place = np.concatenate([np.arange(len(g)) for part in parts for _, g in part])
    item = np.repeat(np.arange(len(items)), [sum(len(g) for _, g in part) for part in parts])
    # A pair at each place could be one of those counted: with r places left out, r less are sure.
    _, which = np.unique(h, return_inverse=True)
    held = np.bincount(np.unique(which * len(items) + item) // len(items))[which]
    base = np.cumsum(sizes) - sizes
    most = np.zeros(int(sizes.sum()), np.int64)
    np.maximum.at(most, base[item] + place, held)
    out = np.zeros(len(most), bool)
    for i in np.unique(item[(held > COMMON) & ~alone[item]]).tolist():
        own = most[base[i] : base[i] + sizes[i]]
        worst = np.argsort(-own, kind="stable")[: least[i] - 1]
        worst = worst[own[worst] > COMMON]
        out[base[i] + worst] = True
        least[i] -= len(worst)
    kept = ~out[base[item] + place]
    h, item = h[kept], item[kept]
    order = np.lexsort((item, h))
    h, item = h[order], item[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
    h, item = h[new], item[new]
    near = np.zeros(1 << (16 * len(h)).bit_length(), bool)
    near[(h & textvec.U(len(near) - 1)).astype(np.int64)] = True
    span = np.floor(sizes * (3 - 2 * threshold) + 1e-9).astype(np.int64)
    return Block(list(ids), list(items), h, item.astype(np.int32), near, np.maximum(least, 1), span, bool(alone.any()))


def blocks(benchmark: DataFrame, threshold: float = THRESHOLD) -> Iterator[Block]:
    """The benchmark in bounded blocks, read row by row. Items without a word are left out: nothing can hold them."""
    ids: list[int | None] = []
    items: list[np.ndarray] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).toLocalIterator():
        for _, _, raw, offs in textvec.chunks(pa.array([row.text or ""])):
            h = words(raw, offs)[0]
            if len(h):
                ids.append(row.item_id)
                items.append(h)
                size += len(h)
        if size >= BLOCK:
            yield _block(ids, items, threshold)
            ids, items, size = [], [], 0
    if items:
        yield _block(ids, items, threshold)


def _windows(block: Block, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, first word, word after the last) of all stretches that can hold an alignment, by item and place."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    keys: list[np.ndarray] = []
    for step in (0, 1, 2) if block.alone else (1, 2):
        pairs = _pairs(h, step)
        at = np.flatnonzero(block.near[(pairs & textvec.U(len(block.near) - 1)).astype(np.int64)])
        at = at[at + step < end[at]]
        left = np.searchsorted(block.hashes, pairs[at], "left")
        count = np.searchsorted(block.hashes, pairs[at], "right") - left
        entry = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        keys.append(block.item[entry].astype(np.int64) * len(h) + np.repeat(at, count))
    key = np.unique(np.concatenate(keys))
    if not len(key):
        return
    item, word = np.divmod(key, len(h))
    last = np.arange(len(key)) + block.least[item] - 1
    first = np.flatnonzero(last < len(key))
    last = last[first]
    held = (item[last] == item[first]) & (word[last] - word[first] < block.span[item[first]]) & (word[last] < end[word[first]])
    first, last = first[held], last[held]
    item, row = item[first], np.searchsorted(bounds, word[first], "right") - 1
    lo = np.maximum(word[last] - block.span[item] + 1, bounds[row])
    hi = np.minimum(word[first] + block.span[item], bounds[row + 1])
    new = np.ones(len(first) + 1, bool)
    new[1:-1] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (lo[1:] >= hi[:-1])
    a, b = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
    yield from zip(row[a].tolist(), item[a].tolist(), lo[a].tolist(), hi[b].tolist(), strict=True)


def _rows(item: np.ndarray, doc: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The rows of an alignment for the words of item, after the row above."""
    rows = np.zeros((len(item) + 1, len(doc) + 1), np.int32)
    rows[0] = above
    slope = np.arange(len(doc) + 1, dtype=np.int32) * -GAP
    for i in range(1, len(item) + 1):
        gain = np.where(doc == item[i - 1], MATCH, MISMATCH)
        best = np.maximum(rows[i - 1] + GAP, 0)
        np.maximum(best[1:], rows[i - 1, :-1] + gain, out=best[1:])
        rows[i] = np.maximum.accumulate(best + slope) - slope
    return rows


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, int]:
    """(score, matched words, first word, word after the last) of the best local alignment of item in doc; the leftmost of the best.

    Where the alignment of a long item is followed back, its rows are made again from the last one kept.
    """
    kept = [np.zeros(len(doc) + 1, np.int32)]
    score = i = j = base = 0
    rows = kept[0][None]
    for base in range(0, len(item), ROWS):
        rows = _rows(item[base : base + ROWS], doc, kept[-1])
        kept.append(rows[-1].copy())
        k, c = np.unravel_index(int(rows.argmax()), rows.shape)
        if rows[k, c] > score:
            score, i, j = int(rows[k, c]), base + int(k), int(c)
    end, matched = j, 0
    while i > 0:
        if (i - 1) // ROWS * ROWS != base:
            base = (i - 1) // ROWS * ROWS
            rows = _rows(item[base : base + ROWS], doc, kept[base // ROWS])
        k = i - base
        if rows[k, j] <= 0:
            break
        same = item[i - 1] == doc[j - 1]
        if rows[k, j] == rows[k - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += bool(same)
            i, j = i - 1, j - 1
        elif rows[k, j] == rows[k - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matched, j, end


def _search(block: Block, h: np.ndarray, bounds: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(row, item, score, matched words, first word, word after the last) for each row and item that reach the threshold."""
    for (r, s), found in groupby(_windows(block, h, bounds), itemgetter(0, 1)):
        item, first = block.items[s], int(bounds[r])
        best = (0, 0, 0, 0)
        for _, _, lo, hi in found:
            for a in range(lo, hi, STRETCH):
                got = align(item, h[a : min(hi, a + STRETCH + 3 * len(item))])
                if got[0] > best[0]:
                    best = (got[0], got[1], got[2] + a - first, got[3] + a - first)
        score = best[0] / (MATCH * len(item))
        if score >= threshold:
            yield r, s, score, best[1], best[2], best[3]


def _prepared(spark: SparkSession, benchmark: DataFrame, threshold: float) -> Iterator[Broadcast]:
    for block in blocks(benchmark, threshold):
        yield spark.sparkContext.broadcast(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, matched_words, first_word, end_word: the documents that hold an item or an edited copy.

    One row for each row of docs and item (item_id) whose best alignment reaches the threshold, with where it lies in
    the document, in words. Other documents have no row. Words are lower-cased runs of letters, digits and bytes
    over 127. Null and empty texts hold nothing and items without a word are in nothing; repeated documents have rows of
    their own; null ids stay null; items of equal ids within a block count as one item.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    base = texts(docs).withColumn("text", F.lower("text"))
    schema = "doc_id long, item_id long, score double, matched_words int, first_word int, end_word int"
    out = spark.createDataFrame([], schema)
    for shared in _prepared(spark, benchmark, threshold):

        def search(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for lo, _, raw, offs in textvec.chunks(batch.column(1)):
                    h, _, _, bounds = words(raw, offs)
                    best: dict[tuple[int, int | None], tuple] = {}
                    for r, s, *rest in _search(own, h, bounds, threshold):
                        key = (lo + r, own.item_ids[s])
                        if key not in best or rest[0] > best[key][0]:
                            best[key] = tuple(rest)
                    rows += [(ids[r], item, *rest) for (r, item), rest in best.items()]
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], ["doc_id", "item_id", "score", "matched_words", "first_word", "end_word"])

        out = out.union(base.mapInArrow(returning(search), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark: those without a row in contaminated()."""
    bound_batches(docs.sparkSession)
    name = "_lower"
    while name in docs.columns:
        name += "_"
    out = docs
    for shared in _prepared(docs.sparkSession, benchmark, threshold):

        def keep(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                for lo, _, raw, offs in textvec.chunks(batch.column(batch.num_columns - 1)):
                    h, _, _, bounds = words(raw, offs)
                    for r, *_ in _search(shared.value, h, bounds, threshold):
                        stays[lo + r] = False
                rows = batch.filter(pa.array(stays))
                yield pa.RecordBatch.from_arrays(rows.columns[:-1], rows.schema.names[:-1])

        out = out.withColumn(name, F.lower(F.col("text").cast("string"))).mapInArrow(returning(keep), docs.schema)
    return out
