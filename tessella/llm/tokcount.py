"""Token counts of a SentencePiece BPE model by pre-token, without a shuffle.

No piece of such a model has the space mark after another character, so merges never cross from a pre-token (a run of
marks and the characters after it) to the next, and a text's count is the sum over its pre-tokens. Counts are looked up
in two tiers: a table of frequent pre-tokens (those of a sample of the first rows) that is broadcast, and each worker's cache, whose misses are
encoded by the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textvec
from tessella.llm.shared import bound_batches, returning, texts

#: Entries of the broadcast table and bytes of each at most: 92 bytes an entry, 6 MB in all, whatever the corpus.
FREQUENT, LONGEST = 1 << 16, 64
#: Rows, and characters of each at most, from which the table is made. They affect speed alone: what it lacks is encoded where it occurs.
WARM_ROWS, WARM_CHARS = 1024, 20_000

MARK = "▁".encode()


@cache
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if "▁" in p.lstrip("▁")]
    if inner or sp.encode(" a  b ", out_type=str)[-1:] != ["▁"]:
        raise ValueError("pre-tokens of this model can't be counted one by one")
    return sp


@cache
def cached(path: str) -> textvec.Table:
    return textvec.Table()


def split(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, whether it begins a text) of pre-tokens. One that begins a text has no mark of its own yet."""
    n = len(raw)
    if n == 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    space = raw == 0x20
    mark = np.flatnonzero((raw[:-2] == MARK[0]) & (raw[1:-1] == MARK[1]) & (raw[2:] == MARK[2])) if n > 2 else np.zeros(0, np.int64)
    tail = space.copy()
    space[mark] = True
    tail[mark + 2] = True
    begins = space.copy()
    begins[1:] &= ~tail[:-1]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    begins |= first[:n]
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n), first[starts]


def count_piece(sp: sentencepiece.SentencePieceProcessor, piece: bytes, begins: bool) -> int:
    """Tokens of a pre-token. The library puts one mark before what it encodes: that replaces the piece's own first."""
    if begins:
        return len(sp.encode(piece.decode()))
    rest = piece[1:] if piece[:1] == b" " else piece[3:]
    return len(sp.encode(rest.decode())) if rest else 1


def keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textvec.mix(textvec.hash_spans(raw, starts, ends, lower=False) + begins.astype(np.uint64))


@dataclass
class Known:
    """The broadcast tier: pre-tokens' sorted keys, their counts, and their bytes, by which they are compared."""

    keys: np.ndarray
    counts: np.ndarray
    spelt: np.ndarray
    at: np.ndarray
    size: np.ndarray

    def find(self, k: np.ndarray, room: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each pre-token of padded bytes, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(k), -1)
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        there = (self.keys[at] == k) & (self.size[at] == size)
        seen = np.flatnonzero(there)
        there[seen] = textvec.equal_spans(room, starts[seen], self.spelt, self.at[at[seen]], size[seen])
        return np.where(there, at, -1)


def frequent(docs: DataFrame, model_path: str, rows: int = WARM_ROWS, most: int = FREQUENT) -> Known:
    """The most frequent pre-tokens of the first rows that Spark finds, most entries at most, none over LONGEST bytes.

    take() reads no more partitions than it needs, so that warming the table doesn't read the corpus once more. Texts
    over WARM_CHARS characters are no part of the sample, which bounds what comes to the driver.
    """
    sp, seen = processor(model_path), {}
    sample = texts(docs).filter(F.length("text") <= WARM_CHARS)
    for row in sample.take(rows) if rows else []:
        for _, _, raw, offs in textvec.chunks(pa.array([row.text or ""])):
            starts, ends, begins = split(raw, offs)
            whole = raw.tobytes()
            for k, a, b, c in zip(keys(raw, starts, ends, begins).tolist(), starts.tolist(), ends.tolist(), begins.tolist(), strict=True):
                if k in seen:
                    seen[k][1] += 1
                elif b - a <= LONGEST:
                    seen[k] = [whole[a:b], 1, c]
    best = sorted(sorted(seen, key=lambda k: -seen[k][1])[:most])
    size = np.array([len(seen[k][0]) for k in best], np.int64)
    spelt = textvec.padded(np.frombuffer(b"".join(seen[k][0] for k in best), np.uint8))
    return Known(np.array(best, np.uint64), np.array([count_piece(sp, seen[k][0], seen[k][2]) for k in best], np.int32), spelt, np.cumsum(size) - size, size)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, warm_rows: int = WARM_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row.

    Counts are the library's for the whole text, without begin or end tokens. A null text counts as the empty one, which
    has no tokens; repeated rows and null doc_ids stay; an empty table gives no rows. No row is shuffled.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    table = spark.sparkContext.broadcast(frequent(docs, model_path, warm_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, own, known = processor(model_path), cached(model_path), table.value
        for batch in batches:
            n_tokens = []
            for _, _, raw, offs in textvec.chunks(batch.column(1)):
                starts, ends, begins = split(raw, offs)
                k = keys(raw, starts, ends, begins)
                at = known.find(k, textvec.padded(raw), starts, ends - starts)
                n = np.zeros(len(k), np.int64)
                n[at >= 0] = known.counts[at[at >= 0]]
                rest, whole = np.flatnonzero(at < 0), raw.tobytes()

                def make(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    which = rest[which]
                    counts = [count_piece(sp, whole[a:b], c) for a, b, c in zip(starts[which].tolist(), ends[which].tolist(), begins[which].tolist(), strict=True)]
                    return np.array(counts, np.uint32), np.ones(len(counts), np.int64)

                start, _ = own.get(k[rest], raw, starts[rest], ends[rest], make)
                n[rest] = own.pool[start]
                sums = np.concatenate([[0], np.cumsum(n)])
                n_tokens.append(np.diff(sums[np.searchsorted(starts, offs)]))
            total = np.concatenate(n_tokens) if n_tokens else np.zeros(0, np.int64)
            _, offs = textvec.buffers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    return texts(docs).mapInArrow(returning(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
