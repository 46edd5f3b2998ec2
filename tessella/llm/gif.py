"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames and colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm import textvec
from tessella.llm.shared import bound_batches, texts

#: Samples in a row of a stored frame, and rows in a frame. A payload is a multiple of the width.
WIDTH, ROWS = 576, 64
DELAY_CS = 10
BINS = 8


# --- LZW ---------------------------------------------------------------------------------------------------------------


@cache
def _widths(size: int) -> np.ndarray:
    """Bits of the code at each place after a clear code, until the table of 4096 entries is full."""
    first = (1 << size) + 1 + np.arange(4096 - (1 << size) - 1)
    return np.minimum(12, np.maximum(size + 1, np.floor(np.log2(first)).astype(np.int64) + 1))


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The code stream of samples below 2^size, beginning with a clear code and ended by the end code."""
    clear = 1 << size
    full = 4096
    codes: list[int] = []
    cuts: list[int] = []
    put = codes.append
    table: dict[int, int] = {}
    free = clear + 2
    put(clear)
    if data:
        cuts.append(1)
        w = data[0]
        get = table.get
        for b in memoryview(data)[1:]:
            k = w << 8 | b
            c = get(k)
            if c is not None:
                w = c
                continue
            put(w)
            table[k] = free
            free += 1
            w = b
            if free == full:
                put(clear)
                cuts.append(len(codes))
                table.clear()
                free = clear + 2
        put(w)
    put(clear + 1)
    values = np.array(codes, np.uint16)
    place = np.arange(len(values))
    if cuts:
        starts = np.zeros(len(values), np.int64)
        starts[cuts] = cuts
        place = place - np.maximum.accumulate(starts)
    else:
        place = place - 1
    bits = _widths(size)[np.maximum(place, 0)]
    bits[0] = size + 1
    grid = (values[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(grid[np.arange(12) < bits[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(data: bytes, size: int, most: int) -> bytes:
    """The samples of a code stream, most at the most. Raises ValueError on a code that isn't there."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    total, bit = len(data) * 8, 0
    out = bytearray()
    table_bits = _widths(size)
    while len(out) < most:
        bits = table_bits
        left = total - bit
        at = bit + np.concatenate([[0], np.cumsum(bits)])
        room = int(np.searchsorted(at[1:], total, "right"))
        at, bits = at[:room], bits[:room]
        codes = window[at >> 3] >> (at & 7).astype(np.uint32) & ((1 << bits) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and room == len(table_bits):  # the table is full, and codes of 12 bits go on
            more = bit + int(table_bits.sum()) + 12 * np.arange((left - int(table_bits.sum())) // 12)
            codes = np.concatenate([codes, window[more >> 3] >> (more & 7).astype(np.uint32) & np.uint32(4095)])
            at = np.concatenate([at, more])
            stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        base = len(out)
        pos: list[int] = []
        for i, c in enumerate(codes[:n].tolist()):
            here = len(out)
            pos.append(here)
            if c < clear:
                out.append(c)
                continue
            j = c - end - 1
            if j < i - 1:
                out += out[pos[j] : pos[j + 1] + 1]
            elif j == i - 1:
                out += out[pos[j] : here]
                out.append(out[pos[j]])
            else:
                raise ValueError("LZW code without an entry")
        if n == len(codes) or codes[n] == end:
            break
        if n == 0 and base == len(out) and not left:
            break
        bit = int(at[n]) + (int(table_bits[n]) if n < len(table_bits) else 12)
    return bytes(out[:most])


# --- container ---------------------------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    parts = [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(parts) + b"\0"


GRAY = bytes(v for i in range(256) for v in (i, i, i))


def encode_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS, palette: bytes = GRAY) -> bytes:
    """An animated GIF89a whose frames hold the samples in order: width a row, rows rows a frame, fewer in the last."""
    if not samples or len(samples) % width:
        raise ValueError("samples: a positive multiple of the width")
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for at in range(0, len(samples), width * rows):
        part = samples[at : at + width * rows]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """A frame as shown: canvas is the whole screen as RGBA, the rest describes its own image."""

    left: int
    top: int
    width: int
    height: int
    start_ms: int
    delay_ms: int
    disposal: int
    transparent: int
    canvas: np.ndarray


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, drawn one over another. Raises ValueError on what isn't a whole GIF."""
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("GIF ends early") from e


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    screen_w, screen_h, flags = struct.unpack_from("<HHB", data, 6)
    at = 13

    def colours(bits: int) -> np.ndarray:
        nonlocal at
        n = 3 << ((bits & 7) + 1)
        if at + n > len(data):
            raise ValueError("GIF ends early")
        at += n
        return np.frombuffer(data, np.uint8, n, at - n).reshape(-1, 3)

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            if at + 1 + n >= len(data):
                raise ValueError("GIF ends early")
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    everywhere = colours(flags) if flags & 0x80 else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
    canvas = np.zeros((screen_h, screen_w, 4), np.uint8)
    disposal, delay, transparent, start = 0, 0, -1, 0
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = bits >> 2 & 7, index if bits & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError("GIF block of an unknown kind")
        left, top, width, height, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        palette = colours(flags) if flags & 0x80 else everywhere
        size = data[at]
        at += 1
        if not 1 <= size <= 11:
            raise ValueError("LZW code size")
        samples = lzw_decode(blocks(), size, width * height)
        if len(samples) < width * height:
            raise ValueError("GIF frame lacks samples")
        image = np.frombuffer(samples, np.uint8).reshape(height, width)
        if flags & 0x40:
            plain = np.empty_like(image)
            plain[_interlaced(height)] = image
            image = plain
        before = canvas.copy() if disposal == 3 else None
        if left + width > screen_w or top + height > screen_h:
            raise ValueError("GIF frame outside the screen")
        if len(palette) < 256 and image.size and int(image.max()) >= len(palette):
            raise ValueError("GIF sample without a colour")
        place = canvas[top : top + height, left : left + width]
        if transparent >= 0:
            seen = image != transparent
            place[seen, :3] = palette[image[seen]]
            place[seen, 3] = 255
        else:
            place[..., :3] = palette[image]
            place[..., 3] = 255
        yield Frame(left, top, width, height, start, delay * 10, disposal, transparent, canvas)
        start += delay * 10
        if disposal == 2:
            place[...] = 0
        elif before is not None:
            canvas = before
        disposal, delay, transparent = 0, 0, -1


# --- columns -----------------------------------------------------------------------------------------------------------


def store(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, filled with 255 up to a positive multiple of width, as a GIF.

    A null text counts as the empty one (a payload of width bytes 255); equal texts have equal media; repeated rows and
    null doc_ids stay; an empty table gives no rows. No UTF-8 text has a byte 255, so the length can be told again.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = textvec.buffers(batch.column(1))
            whole, at = raw.tobytes(), offs.tolist()
            for lo in range(0, len(at) - 1, 64):
                hi = min(lo + 64, len(at) - 1)
                media = []
                for k in range(lo, hi):
                    n = at[k + 1] - at[k]
                    media.append(encode_gif(whole[at[k] : at[k + 1]] + b"\xff" * (max(1, -(-n // width)) * width - n), width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs[lo : hi + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FRAME_TYPE = pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("red", pa.list_(pa.int64())), ("green", pa.list_(pa.int64())), ("blue", pa.list_(pa.int64()))])
FRAMES = "array<struct<frame:int,start_ms:bigint,delay_ms:bigint,left:int,top:int,width:int,height:int,red:array<bigint>,green:array<bigint>,blue:array<bigint>>>"


def _read(media: bytes | None) -> tuple[list[dict], bytes, str | None]:
    """Frames with histograms of what is shown, the frames' own red samples in order, and what is wrong."""
    frames: list[dict] = []
    samples: list[bytes] = []
    if media is None:
        return frames, b"", "null"
    try:
        for i, f in enumerate(decode_gif(media)):
            shown = f.canvas[f.canvas[..., 3] > 0] if (f.canvas[..., 3] == 0).any() else f.canvas.reshape(-1, 4)
            red, green, blue = (np.bincount(shown[:, c] >> 5, minlength=BINS).tolist() for c in range(3))
            frames.append({"frame": i, "start_ms": f.start_ms, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "red": red, "green": green, "blue": blue})
            samples.append(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
    except ValueError as e:
        return frames, b"".join(samples), str(e)
    return frames, b"".join(samples), None


def read(media: DataFrame) -> DataFrame:
    """Every column of media and, from its column media, frames (timed, with colour histograms of the drawn screen in 8
    bins a channel), payload_bytes, payload_sha256, tail_crc32 (last 32 bytes), media_bytes, media_sha256 and error.

    Histograms count opaque pixels alone. What can't be decoded, or is null, has an error text, the frames before it
    and the payload that those hold; other rows have a null error.
    """
    bound_batches(media.sparkSession)
    names = media.columns
    out = ["frames", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "error"]
    if clash := set(out) & set(names):
        raise ValueError(f"columns that read() adds: {sorted(clash)}")
    schema = ", ".join(f"`{n}` {t}" for n, t in media.dtypes) + f", frames {FRAMES}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for x in batch.column(names.index("media")):
                stored = x.as_py()
                frames, payload, error = _read(stored)
                rows.append((frames, len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored or b""), sha(stored or b"").hexdigest(), error))
            types = [pa.list_(FRAME_TYPE), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*names, *out])

    return media.mapInArrow(run, schema)
