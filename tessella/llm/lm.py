"""Language-model scoring by a weighted backoff automaton over word n-grams.

States are contexts of up to order - 1 tokens that occur in the training texts. A state's arcs are its seen successors,
weighted with their smoothed probability; its failure arc leads to the context without its first token and is weighted
with what the state leaves to it. The weights interpolate the orders (Jelinek-Mercer), with one weight for each bucket of
context counts, estimated by leaving one out: a context of count c has a new successor as often as those of count c + 1
have one that occurs once. The unigrams give the unknown word the share of tokens that occur once (Good-Turing).

The automaton grows with the corpus, so no worker holds it. Texts are packed into blocks, which are written once; each
block asks for the counts of its own distinct n-grams, in sorted, compressed arrays by ranges of their hashes; each range
adds up all blocks' training counts and answers in the order asked. An answer also tells which n-grams no other block
has: longer ones that hold one of these are known to the block itself, and are neither asked for nor moved. From the
answers a block has the part of the automaton that its texts can reach, and walks it once from left to right. Blocks have
a bounded size and ranges grow in number with the blocks, so that no task grows with the corpus.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textvec
from tessella.llm.shared import bound_batches, written_by
from tessella.llm.textvec import U

ORDER = 3
#: Bytes of text in a block, a longer text by itself, and of text for each range of hashes.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: Context counts up to EXACT have buckets of their own, larger ones by powers of two.
EXACT, BUCKETS = 8, 64
#: Bounds of an interpolation weight.
LEAST_WEIGHT, MOST_WEIGHT = 1e-4, 0.999

BEGIN, END = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for no occurrence, then the count up to EXACT, then one for each power of two."""
    large = EXACT + 1 + np.floor(np.log2(np.maximum(count, EXACT + 1) / (EXACT + 1))).astype(np.int64)
    return np.where(count <= EXACT, count, np.minimum(large, BUCKETS - 1)).astype(np.int64)


# --- packed arrays -----------------------------------------------------------------------------------------------------


def _planes(a: np.ndarray) -> bytes:
    """The bytes of numbers by their place, each place compressed by itself where that makes it smaller."""
    size = a.dtype.itemsize
    places = np.ascontiguousarray(a.view(np.uint8).reshape(-1, size).T)
    parts = [min((p.tobytes(), zstandard.compress(p.tobytes(), 3)), key=len) for p in places]
    return struct.pack(f"<I{size}I", len(a), *map(len, parts)) + b"".join(parts)


def _unplanes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    n, *lengths = struct.unpack_from(f"<I{size}I", data)
    at, out = 4 + 4 * size, np.empty((n, size), np.uint8)
    for k, length in enumerate(lengths):
        part = data[at : at + length]
        out[:, k] = np.frombuffer(part if length == n else zstandard.decompress(part), np.uint8)
        at += length
    return out.reshape(-1).view(dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as compressed differences."""
    with np.errstate(over="ignore"):
        return _planes(np.diff(keys, prepend=U(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(_unplanes(data, np.uint64), dtype=np.uint64)


def _bits(mask: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(mask).tobytes(), 1)


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8), count=n).astype(bool)


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the parts of sorted keys, by equal ranges of their 32 upper bits."""
    edges = (np.arange(1, parts, dtype=np.uint64) << U(32)) // U(parts) << U(32)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


# --- tokens ------------------------------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """A block's tokens: each text's words between a begin and an end mark. bounds: where texts begin (at the mark)."""

    hashes: np.ndarray
    bounds: np.ndarray
    train: np.ndarray

    def level(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct n-grams, places of their last tokens, which n-gram at each place). Begin marks end none."""
        h = self.hashes
        first = np.repeat(self.bounds[:-1].astype(np.int32), np.diff(self.bounds))
        last = np.flatnonzero(np.arange(len(h), dtype=np.int32) - first >= max(n - 1, 1)).astype(np.int32)
        grams = textvec.ngrams(h, n)[last - (n - 1)]
        keys, which = np.unique(grams, return_inverse=True)
        return keys, last, which.astype(np.int32)

    def own(self, last: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """Occurrences in the block's training texts of the n-grams of level()."""
        return np.bincount(which, np.repeat(self.train, np.diff(self.bounds))[last], n).astype(np.int64)


def tokens(raw: np.ndarray, offs: np.ndarray, train: np.ndarray) -> Tokens:
    parts, sizes = [], []
    lo, n = 0, len(offs) - 1
    while lo < n:  # a megabyte at a time bounds what hashing holds
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + textvec.CHUNK, "right")) - 1)
        h, _, _, bounds = textvec.words(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        parts.append(h)
        sizes.append(np.diff(bounds))
        lo = hi
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(size + 2)])
    hashes = np.empty(int(bounds[-1]), np.uint64)
    hashes[bounds[:-1]], hashes[bounds[1:] - 1] = BEGIN, END
    inner = np.ones(len(hashes), bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    hashes[inner] = words
    return Tokens(hashes, bounds, train)


# --- blocks ------------------------------------------------------------------------------------------------------------

BLOCK = "block long, ids binary, nulls binary, train binary, lengths binary, text binary"
REQUEST = "part int, block long, level int, keys binary, counts binary, buckets binary, stats binary, local binary"
ANSWER = "block long, level int, part int, counts binary, stats binary, local binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text, train) packed into blocks. A block's number is a hash of what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]] = []
        size, seen = 0, {}

        def flush() -> pa.RecordBatch:
            nonlocal size
            ids, nulls, train, lengths = (np.concatenate([x[i] for x in held]) for i in range(4))
            text = b"".join(x[4] for x in held)
            held.clear()
            size = 0
            h = int(textvec.mix(np.array([zlib.crc32(text) << 32 | zlib.crc32(ids.tobytes() + lengths.tobytes())], np.uint64))[0] >> U(1))
            seen[h] = seen.get(h, -1) + 1
            h = (h + seen[h] * 0x9E3779B9) & ((1 << 63) - 1)  # equal blocks of one task have numbers of their own
            row = [h, ids.tobytes(), nulls.tobytes(), train.tobytes(), lengths.tobytes(), zstandard.compress(text, 9)]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in row[1:]]], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            ids = batch.column(0)
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            for lo, hi, raw, offs in textvec.chunks(batch.column(1)):
                part = ids.slice(lo, hi - lo)
                if held and size + len(raw) > BLOCK_BYTES:
                    yield flush()
                held.append((part.fill_null(0).to_numpy(), part.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), train[lo:hi], np.diff(offs), raw.tobytes()))
                size += len(raw)
        if held:
            yield flush()

    return docs.mapInArrow(run, BLOCK)


def _open(block: pa.Table) -> tuple[int, np.ndarray, np.ndarray, Tokens]:
    row = block.to_pylist()[0]
    lengths = np.frombuffer(row["lengths"], np.int64)
    offs = np.concatenate([[0], np.cumsum(lengths)])
    raw = np.frombuffer(zstandard.decompress(row["text"]), np.uint8)
    return row["block"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], np.uint8) > 0, tokens(raw, offs, np.frombuffer(row["train"], np.uint8) > 0)


def _stats(counts: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """By the bucket of the n-grams' contexts: occurrences, n-grams that occur once, n-grams that occur."""
    return np.array([np.bincount(buckets, counts, BUCKETS), np.bincount(buckets[counts == 1], minlength=BUCKETS), np.bincount(buckets[counts > 0], minlength=BUCKETS)], float)


def _request(number: int, t: Tokens, level: int, before: Level | None, parts: int) -> pa.RecordBatch:
    """One row for each part: the block's n-grams in it, their counts in its training texts, their contexts' buckets.

    before: what is known of the (n-1)-grams. Of n-grams that no other block can have, only their statistics are sent, and
    which they are, both with part 0."""
    keys, last, which = t.level(level)
    counts = t.own(last, which, len(keys))
    buckets, local = np.zeros(len(keys), np.uint8), np.zeros(len(keys), bool)
    if before is not None:
        buckets[which] = bucket(_contexts(t, before, level)[last])
        local[which] = before.alone[last] | before.alone[last - 1]
    told = _stats(counts[local], buckets[local])
    keys, counts, buckets = keys[~local], counts[~local].astype(np.uint32), buckets[~local]
    cut = ranges(keys, parts).tolist()
    pieces = [(pack_keys(keys[a:b]), _planes(counts[a:b]), zstandard.compress(buckets[a:b].tobytes(), 1), told.tobytes() if k == 0 else None, _bits(local) if k == 0 else None) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(parts, dtype=np.int32)), pa.array(np.full(parts, number)), pa.array(np.full(parts, level, np.int32)), *[pa.array([p[i] for p in pieces], pa.binary()) for i in range(5)]],
        [c.split()[0] for c in REQUEST.split(", ")],
    )


def _answer(group: pa.Table) -> pa.Table:
    """Add up one part of one level, and answer every block in the order that it asked: twice the count, plus 1 for an
    n-gram that no other block has asked for."""
    rows = group.select(["block", "level", "part", "keys", "counts", "buckets", "stats", "local"]).to_pylist()
    keys = [unpack_keys(r["keys"]) for r in rows]
    counts = np.concatenate([_unplanes(r["counts"], np.uint32) for r in rows])
    buckets = np.concatenate([np.frombuffer(zstandard.decompress(r["buckets"]), np.uint8) for r in rows])
    ends = np.cumsum([len(k) for k in keys])
    distinct, first, which, asked = np.unique(np.concatenate(keys), return_index=True, return_inverse=True, return_counts=True)
    total = np.bincount(which, counts, len(distinct)).astype(np.int64)
    stats = _stats(total, buckets[first]) + sum(np.frombuffer(r["stats"], float).reshape(3, BUCKETS) for r in rows if r["stats"] is not None)
    packed = zstandard.compress(stats.tobytes(), 1)
    told = (total << 1 | (asked == 1)).astype(np.uint64)
    out = [_planes(told[which[b - len(k) : b]]) for k, b in zip(keys, ends.tolist())]
    return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "level": pa.array([r["level"] for r in rows], pa.int32()), "part": pa.array([r["part"] for r in rows], pa.int32()), "counts": pa.array(out, pa.binary()), "stats": pa.array([packed] * len(rows), pa.binary()), "local": pa.array([r["local"] for r in rows], pa.binary())})


@dataclass
class Level:
    """Of a block's places at one order: training count of the n-gram that ends there (0 where none), whether no other
    block has it, and all stats."""

    counts: np.ndarray
    stats: np.ndarray
    alone: np.ndarray

    def weights(self) -> np.ndarray:
        """What a context of each bucket leaves to its failure arc."""
        total, once = self.stats[0], self.stats[1]
        share = np.where(total > 0, once / np.maximum(total, 1), MOST_WEIGHT)
        up = np.append(share[1:], share[-1])
        up[EXACT + 1 :] = share[EXACT + 1 :]
        seen = np.append(total[1:], 0) > 0
        seen[EXACT + 1 :] = total[EXACT + 1 :] > 0
        return np.clip(np.where(seen, up, share), LEAST_WEIGHT, MOST_WEIGHT)


def _levels(t: Tokens, answers: pa.Table, parts: int) -> dict[int, Level]:
    out = {}
    rows = sorted(answers.to_pylist(), key=lambda r: (r["level"], r["part"]))
    for level in sorted({r["level"] for r in rows}):
        mine = [r for r in rows if r["level"] == level]
        if [r["part"] for r in mine] != list(range(parts)):
            raise ValueError("a block's requests and answers don't match")
        keys, last, which = t.level(level)
        local = _unbits(mine[0]["local"], len(keys))
        told = np.concatenate([_unplanes(r["counts"], np.uint64) for r in mine]).astype(np.int64)
        if len(told) != len(keys) - int(local.sum()):
            raise ValueError("a block's requests and answers don't match")
        total, lone = t.own(last, which, len(keys)), local.copy()
        total[~local], lone[~local] = told >> 1, told & 1
        counts, alone = np.zeros(len(t.hashes), np.int64), np.zeros(len(t.hashes), bool)
        counts[last], alone[last] = total[which], lone[which]
        out[level] = Level(counts, sum(np.frombuffer(zstandard.decompress(r["stats"]), np.float64).reshape(3, BUCKETS) for r in mine), alone)
    return out


def _contexts(t: Tokens, before: Level, level: int) -> np.ndarray:
    """For each place the count of the context before it, of level - 1 tokens. All training texts have the begin mark."""
    counts = before.counts.copy()
    if level == 2:
        counts[t.bounds[:-1]] = before.counts[t.bounds[1:] - 1]
    out = np.zeros(len(counts), np.int64)
    out[1:] = counts[:-1]
    return out


def walk(t: Tokens, levels: dict[int, Level]) -> tuple[np.ndarray, np.ndarray, int]:
    """(log10 of the base's and of the automaton's probability at each place, tokens in all). Begin marks have 0.

    Each place enters at the state of the longest context that occurs, and takes failure arcs until a state has an arc of
    the token; the root has one for every token, the unknown word's for those that never occur."""
    one = levels[1]
    total, once, kinds = (int(x) for x in one.stats.sum(1))
    at = np.ones(len(t.hashes), bool)
    at[t.bounds[:-1]] = False
    base = np.where(at, np.log10((one.counts + 0.5) / (total + 0.5 * (kinds + 1))), 0.0)
    unknown = min(max(once / total, LEAST_WEIGHT), 0.5) if total else 1.0
    p = np.where(one.counts > 0, (1 - unknown) * one.counts / max(total, 1), unknown)
    score = np.log10(p)
    for n in range(2, max(levels) + 1):
        context = _contexts(t, levels[n - 1], n)
        state = context > 0
        left = levels[n].weights()[bucket(context)]
        arc = state & (levels[n].counts > 0)
        p = np.where(state, left * p, p)
        p[arc] += (1 - left[arc]) * levels[n].counts[arc] / context[arc]
        score = np.where(arc, np.log10(p), np.where(state, np.log10(left) + score, score))
    return base, np.where(at, score, 0.0), total


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(number: int, ids: np.ndarray, nulls: np.ndarray, t: Tokens, levels: dict[int, Level]) -> pa.Table:
    del number
    base, score, total = walk(t, levels)
    starts = t.bounds[:-1]
    add = lambda x: np.add.reduceat(x, starts)
    known = (levels[1].counts > 0).astype(np.int64)
    return pa.table(
        {
            "doc_id": pa.array(ids, mask=nulls),
            "held_out": pa.array(~t.train),
            "n_tokens": pa.array(np.diff(t.bounds) - 1),
            "n_known": pa.array(add(known)),
            "train_tokens": pa.array(np.full(len(ids), total)),
            "base_score": pa.array(add(base)),
            "score": pa.array(add(score)),
        }
    )


def score(docs: DataFrame, held_out, order: int = ORDER, parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row, learnt from rows not held out.

    held_out: a boolean column of docs; null counts as false. Tokens are lower-cased (A-Z) words and one end; a null or
    empty text has the end alone. base_score adds log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens; score is the
    automaton's log10 probability. Without training rows every token is unknown, and score is 0 (probability 1 of the
    only token there is). Repeated rows and null doc_ids stay; an empty table gives no rows. parts: ranges of hashes that
    are counted apart, each in one task; where not given, one for each RANGE_BYTES of text.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written_by(_blocks(base), "blocks", "block", shuffled)
    parts = parts or max(8, -(-blocks.count() * BLOCK_BYTES // RANGE_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, _, _, t = _open(pa.Table.from_batches([batch.slice(i, 1)]))
                yield _request(number, t, 1, None, parts)

    def counted(requests: DataFrame) -> DataFrame:
        # In as many parts as the blocks: all that is asked of answers then shares one shuffle.
        return requests.groupBy("part").applyInArrow(_answer, ANSWER).repartition(shuffled, "block")

    def asker(level: int):
        def ask_more(block: pa.Table, given: pa.Table) -> pa.Table:
            number, _, _, t = _open(block)
            return pa.Table.from_batches([_request(number, t, level, _levels(t, given, parts)[level - 1], parts)])

        return ask_more

    answers = [counted(blocks.mapInArrow(ask, REQUEST))]
    for level in range(2, order + 1):
        # Contexts are the n-grams of the level before: no other answers are needed.
        answers.append(counted(blocks.groupBy("block").cogroup(answers[-1].groupBy("block")).applyInArrow(asker(level), REQUEST)))
    every = reduce(DataFrame.union, answers)

    def finish(block: pa.Table, given: pa.Table) -> pa.Table:
        number, ids, nulls, t = _open(block)
        return _score(number, ids, nulls, t, _levels(t, given, parts))

    return blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(finish, SCORED)


def split(docs: DataFrame):
    """Whether crc32 of doc_id as text leaves 1 when divided by 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))) % 5 == 1
