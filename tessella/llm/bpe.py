"""Byte-level BPE: pre-tokens by array scans over codepoint classes, cached pair merging, exact decoding.

The split is that of public_tokenizers.PATTERN without a regular expression. Every codepoint has a class; a class is a
transition function over eight states, and functions compose associatively. The closure of the classes under
composition is a small monoid, so an element is one byte and composing is one look-up: an inclusive scan of a text is
done in two levels, along columns of a matrix and then over the rows' totals. The state before a codepoint and its
class tell whether a pre-token begins there; the two rules that look ahead (contractions, last of a run of white space)
read the following classes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessella.llm import textvec
from tessella.llm.shared import bound_batches, returning, texts

# Codepoint classes: letter, number, other, the space, other white space, an apostrophe that begins a contraction of one or two letters,
# the end of a text.
L, N, O, S, WS, A1, A2, END = range(8)
# States after a codepoint: what the current pre-token is. C2, C1: so many letters of a contraction are to come. CE: a pre-token has ended.
QL, QN, QO, QS, QW, C2, C1, CE = range(8)

SURROGATES = range(0xD800, 0xE000)
#: Bytes of a pre-token from which on its pairs are kept in a heap.
HEAPED = 256


@cache
def classes() -> np.ndarray:
    """The class of every codepoint, for the Unicode version of the installed tables."""
    out = np.full(0x110000, O, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if c not in SURROGATES)
    for pattern, kind in ((r"\p{L}+", L), (r"\p{N}+", N), (r"\s+", WS)):
        for m in regex.finditer(pattern, every):
            at = np.frombuffer(m.group().encode("utf-32-le"), np.uint32)
            out[at] = kind
    out[0x20] = S
    return out


def _step(state: int, kind: int) -> int:
    if kind == L:
        return {C2: C1, C1: CE}.get(state, QL)
    if kind in (A1, A2):
        return QO if state in (QO, QS) else C1 if kind == A1 else C2
    return {N: QN, O: QO, S: QS, WS: QW, END: CE}[kind]


def _begins(state: int, kind: int) -> bool:
    """Whether a pre-token begins at a codepoint, white space after white space apart."""
    if state in (C2, C1):
        return False
    if state in (QS, QW) and kind in (S, WS):
        return False
    same = {QL: (L,), QN: (N,), QO: (O, A1, A2), QS: (L, N, O, A1, A2)}
    return kind not in same.get(state, ())


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, product table at 16 * first + then, state reached from CE by each element, begins[state, class])."""
    generators = [tuple(_step(q, k) for q in range(8)) for k in range(8)]
    elements, at = [tuple(range(8))], 0
    index = {elements[0]: 0}
    while at < len(elements):
        for g in generators:
            f = tuple(g[q] for q in elements[at])
            if f not in index:
                index[f] = len(elements)
                elements.append(f)
        at += 1
    product = np.zeros((16, 16), np.uint8)
    product[: len(elements), : len(elements)] = [[index[tuple(b[q] for q in a)] for b in elements] for a in elements]
    return np.array([index[g] for g in generators], np.uint8), product.ravel(), np.array([e[CE] for e in elements], np.uint8), np.array([[_begins(q, k) for k in range(8)] for q in range(8)])


def scan(elements: np.ndarray, product: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive products from the left: along the columns of a matrix, then over the rows' totals, in the same way.

    Elements are under 16, so that a pair of them is one byte, and product is flat."""
    n = len(elements)
    if n <= width:
        out, acc = np.empty(n, np.uint8), 0
        table = product.tolist()
        for i, e in enumerate(elements.tolist()):
            out[i] = acc = table[acc << 4 | e]
        return out
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint8)
    padded[:n] = elements
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)
    for c in range(1, width):
        np.take(product, grid[c - 1] << 4 | grid[c], out=grid[c])
    before = np.zeros(rows, np.uint8)
    before[1:] = scan(grid[-1].copy(), product, width)[:-1]
    return np.take(product, (before << 4)[None, :] | grid).T.ravel()[:n]


def boundaries(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each codepoint. codes: texts one after another; lengths: codepoints of each."""
    ends = np.cumsum(lengths)
    kind = np.insert(classes()[codes], ends, END)
    padded = np.concatenate([np.insert(codes, ends, 0), np.zeros(2, codes.dtype)])
    apostrophe = np.flatnonzero((padded[:-2] == 39) & (kind == O))
    if len(apostrophe):
        one, two = padded[apostrophe + 1].astype(np.int64), padded[apostrophe + 2]
        kind[apostrophe[np.isin(one, [115, 100, 109, 116])]] = A1
        kind[apostrophe[np.isin(one << 32 | two, [a << 32 | b for a, b in ((108, 108), (118, 101), (114, 101))])]] = A2
    generators, product, reached, begins = monoid()
    states = np.empty(len(kind), np.uint8)
    states[0] = CE
    states[1:] = reached[scan(generators[kind], product)[:-1]]
    out = begins[states, kind]
    space = (kind == S) | (kind == WS)
    # The last of several white-space codepoints before anything but the text's end is a pre-token by itself, or begins one.
    out[1:-1] |= space[1:-1] & space[:-2] & ~space[2:] & (kind[2:] != END)
    return np.delete(out, ends + np.arange(len(ends)))


def pretokens(texts_: list[str]) -> list[list[str]]:
    """The pre-tokens of each text."""
    joined = "".join(texts_)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts_], np.int64)
    at = np.flatnonzero(boundaries(codes, lengths)).tolist()
    pieces = [joined[a:b] for a, b in zip(at, at[1:] + [len(joined)])]
    ends = np.searchsorted(at, np.cumsum(lengths)).tolist()
    return [pieces[a:b] for a, b in zip([0] + ends, ends)]


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merging, again and again, the pair of the lowest rank; of equal pairs the leftmost."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > HEAPED:
        return _merge_long(piece, ranks)
    rank, none = ranks.get, len(ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge_pairs() by a heap of pairs over a linked list of parts, for time in n log n."""
    n = len(piece)
    after, before, none = list(range(1, n + 1)), list(range(-1, n - 1)), len(ranks)
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2], none)) < none]
    heapify(heap)

    def push(i: int) -> None:
        if i >= 0 and after[i] < n:
            end = after[after[i]]
            if (r := ranks.get(piece[i:end], none)) < none:
                heappush(heap, (r, i, after[i], end))

    while heap:
        _, i, middle, end = heappop(heap)
        # A part that is gone has after -1; one that has grown has another middle or end.
        if after[i] != middle or after[middle] != end:
            continue
        after[i], after[middle] = end, -1
        if end < n:
            before[end] = i
        push(before[i])
        push(i)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Bpe:
    """Encodes and decodes by a file of ranks. Ids of pre-tokens are kept in a bounded table, by a hash of their bytes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair_keys, self.pair_ids = self._pairs()
        self.table = textvec.Table()

    def merge(self, piece: bytes) -> list[int]:
        return merge_pairs(piece, self.ranks)

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted pairs of ids (two in one number) that merge, and the ids that they merge to."""
        ranks = self.ranks
        found = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None:
                    found[a << 32 | b] = rank
        keys = np.array(sorted(found), np.int64)
        return keys, np.array([found[k] for k in keys.tolist()], np.int64)

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of all pieces: ids one after another, and how many of each. All pieces take a merge at a time, each its
        own pair of the lowest rank; long ones are merged by themselves."""
        whole = [self.ranks.get(p) for p in pieces]
        alone = {i: [r] if r is not None else merge_pairs(p, self.ranks) for i, (r, p) in enumerate(zip(whole, pieces, strict=True)) if r is not None or len(p) > HEAPED}
        rest = [i for i in range(len(pieces)) if i not in alone]
        owner = np.repeat(np.array(rest, np.int64), [len(pieces[i]) for i in rest])
        ids = self.single[np.frombuffer(b"".join(pieces[i] for i in rest), np.uint8)]
        done = [(np.array([i for i, run in alone.items() for _ in run], np.int64), np.array([x for run in alone.values() for x in run], np.int64))]
        while len(ids):
            key = ids[:-1] << 32 | ids[1:]
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            pos = np.flatnonzero((owner[1:] == owner[:-1]) & (self.pair_keys[at] == key))
            mine = owner[pos]
            first = np.flatnonzero(np.diff(mine, prepend=-1))
            live = np.zeros(len(pieces), bool)
            live[mine] = True
            kept = live[owner]
            done.append((owner[~kept], ids[~kept]))
            if not len(pos):
                break
            best = np.minimum.reduceat(self.pair_ids[at[pos]] << 32 | pos, first)
            place = best & 0xFFFFFFFF
            ids[place] = best >> 32
            kept[place + 1] = False
            owner, ids = owner[kept], ids[kept]
        owner, ids = (np.concatenate([d[k] for d in done]) for k in range(2))
        return ids[np.argsort(owner, kind="stable")].astype(np.uint32), np.bincount(owner, minlength=len(pieces))

    def encode_batch(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's begin (with the end). raw, offs: the texts' bytes and where each begins."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts = lead[boundaries(codes, np.diff(np.searchsorted(lead, offs)))]
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        whole = raw.tobytes()

        def make(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self.merge_many([whole[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])

        start, length = self.table.get(textvec.hash_spans(raw, starts, ends, lower=False), raw, starts, ends, make)
        ids = textvec.gather(self.table.pool, start, length)
        return ids, np.concatenate([[0], np.cumsum(length)])[np.searchsorted(starts, offs)]

    def decode(self, ids: np.ndarray) -> bytes:
        return textvec.gather(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


@cache
def codec(path: str) -> Bpe:
    """One per worker process and file."""
    return Bpe(path)


def encode(docs: DataFrame, ranks_path: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, offsets (both binary, little-endian unsigned 32-bit; only where keep), ids_sha256, decoded_sha256.

    offsets has the byte of the text at which each id begins. Every whole text is encoded and its ids decoded again. A null or empty text has no ids, and the hashes are those of
    no bytes. Rows are kept one to one: repeated rows and null doc_ids stay; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path)
        sha = hashlib.sha256
        for batch in batches:
            n_tokens, kept, places, ids_sha, decoded_sha = [], [], [], [], []
            for _, _, raw, offs in textvec.chunks(batch.column(1)):
                every, at = bpe.encode_batch(raw, offs)
                every, text = every.astype("<u4"), bpe.decode(every)
                # A row's ids decode to its own bytes or to as many others: its part of the text is found by its ids' lengths.
                begins = np.concatenate([[0], np.cumsum(bpe.lengths[every])])
                cut, at = begins[at].tolist(), at.tolist()
                for k in range(len(offs) - 1):
                    ids = every[at[k] : at[k + 1]].tobytes()
                    n_tokens.append(at[k + 1] - at[k])
                    ids_sha.append(sha(ids).hexdigest())
                    decoded_sha.append(sha(text[cut[k] : cut[k + 1]]).hexdigest())
                    if keep:
                        kept.append(ids)
                        places.append((begins[at[k] : at[k + 1]] - cut[k]).astype("<u4").tobytes())
            cols = [batch.column(0), pa.array(n_tokens, pa.int64()), *([pa.array(kept, pa.binary()), pa.array(places, pa.binary())] if keep else []), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", *(["ids", "offsets"] if keep else []), "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(returning(run), "doc_id long, n_tokens long" + ", ids binary, offsets binary" * keep + ", ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, ranks_path: str, first: int = 0, end: int | None = None) -> DataFrame:
    """doc_id, text of rows doc_id, ids, offsets as encode() gives them; a null value of ids or offsets gives the empty text.

    first, end: bytes of the text to decode (all where not given). Of ids that lie outside by their offsets none is
    decoded; characters that the bounds cut become U+FFFD.
    """
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path)
        for batch in batches:
            out = []
            for x, y in zip(batch.column(1), batch.column(2), strict=True):
                ids, begins = (np.frombuffer(v.as_py() or b"", "<u4") for v in (x, y))
                if len(ids) != len(begins):
                    ids = begins = ids[:0]
                a = max(int(np.searchsorted(begins, first, "right")) - 1, 0)
                b = len(ids) if end is None else int(np.searchsorted(begins, end, "left"))
                at = int(begins[a]) if a < b else first
                out.append(bpe.decode(ids[a:b])[max(first - at, 0) : None if end is None else max(end - at, 0)].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(returning(run), "doc_id long, text string")
