"""GIF as a media column: LZW code streams, palettes, disposal and transparency rules, timed frames, histograms.

The decoder unpacks the codes of a whole stretch up to the next clear code with numpy (their widths depend only on how
many codes came since the last clear) and expands them with a table. Frames are painted on a canvas by the rules of the format and come
with start times and colour histograms. An encoder stores bytes losslessly as palette indices.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.shared import bounded_batches, table, text_bytes

#: Samples of a row and rows of a frame of stored bytes.
ROW, FRAME_ROWS = 64, 512
#: Levels of each of red, green and blue in a histogram (the top two bits).
LEVELS = 4
#: Pixels of a canvas or a frame that a decoder accepts at most.
MOST_PIXELS = 1 << 26
TABLE = 4096
_BITS = np.arange(16)


class GifError(ValueError):
    """A stream that breaks the format; the message says where."""


@lru_cache(64)
def code_widths(minimum: int, count: int) -> np.ndarray:
    """Bits of the 0th, 1st, ... code after a clear code."""
    held = (1 << minimum) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.clip(np.frexp(held)[1], minimum + 1, 12)


@lru_cache(64)
def code_ends(minimum: int, count: int) -> np.ndarray:
    return np.cumsum(code_widths(minimum, count))


def lzw_encode(samples: bytes, minimum: int = 8) -> bytes:
    """Code stream of samples below ``1 << minimum``."""
    clear, stop = 1 << minimum, (1 << minimum) + 1
    codes, known, free = [clear], {}, stop + 1
    get = known.get
    add = codes.append
    marks = [0]  # places of the clear codes
    if samples:
        prefix = samples[0]
        for sample in memoryview(samples)[1:]:
            key = prefix << 8 | sample
            code = get(key)
            if code is not None:
                prefix = code
                continue
            add(prefix)
            known[key] = free
            free += 1
            prefix = sample
            if free == TABLE:
                marks.append(len(codes))
                add(clear)
                known.clear()
                free = stop + 1
        add(prefix)
    add(stop)
    # a clear code after the first is still as wide as its place in the stretch before it says
    table = code_widths(minimum, TABLE)
    widths = np.concatenate([[minimum + 1], *[table[: b - a] for a, b in zip(marks, [*marks[1:], len(codes) - 1], strict=True)]])
    bits = np.unpackbits(np.array(codes, "<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[_BITS < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, minimum: int, limit: int) -> bytes:
    """At most ``limit`` samples of a code stream; fewer if the stream ends early."""
    if not 1 <= minimum <= 8:
        raise GifError(f"code size {minimum}")
    clear, stop = 1 << minimum, (1 << minimum) + 1
    packed = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    bits, at, size = 8 * len(data), 0, 0
    root: list[bytes | None] = [bytes([k]) for k in range(clear)] + [None, None]
    out: list[bytes] = []
    add = out.append
    while size < limit:
        # all codes up to the next clear or stop code
        count = TABLE
        while True:
            fit = int(np.searchsorted(code_ends(minimum, count), bits - at, "right"))
            widths, ends = code_widths(minimum, count)[:fit], code_ends(minimum, count)[:fit] + at
            starts = ends - widths
            byte = starts >> 3
            window = packed[byte] | packed[byte + 1] << 8 | packed[byte + 2] << 16
            codes = window >> (starts & 7) & ((1 << widths) - 1)
            marks = np.flatnonzero((codes == clear) | (codes == stop))
            if len(marks) or fit < count:
                break
            count *= 4
        stretch = codes[: marks[0]] if len(marks) else codes
        known, last = root[:], None
        grow, room = known.append, TABLE - len(root)
        for code in stretch.tolist():
            if code < len(known):
                entry = known[code]
                if room and last is not None:
                    grow(last + entry[:1])
                    room -= 1
            elif code == len(known) and last is not None and room:
                entry = last + last[:1]
                grow(entry)
                room -= 1
            else:
                raise GifError(f"code {code} before it is known")
            add(entry)
            last = entry
        size += sum(map(len, out[-len(stretch) :])) if len(stretch) else 0
        if not len(marks) or codes[marks[0]] == stop:
            break
        at = int(ends[marks[0]])
    return b"".join(out)[:limit]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    samples: bytes  # palette indices, row by row, as stored (interlacing undone)
    palette: np.ndarray  # of shape (n, 3)
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None


def blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """Contents of the chain of sub-blocks at ``at``, and the place after it."""
    parts = []
    while True:
        if at >= len(data):
            raise GifError("the file ends within a chain of blocks")
        size = data[at]
        if not size:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size


def chain(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def row_order(height: int, interlaced: bool) -> np.ndarray:
    """Row of the image that each stored row is."""
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes, most_pixels: int = MOST_PIXELS) -> tuple[int, int, list[Frame]]:
    """Canvas width and height and the frames of a GIF file; a canvas or frame of more than ``most_pixels`` is an error."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > most_pixels:
        raise GifError(f"a canvas of {width} x {height} pixels")
    at = 13

    def colours(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        size = 2 << (flags & 7)
        if at + 3 * size > len(data):
            raise GifError("the file ends within a palette")
        return np.frombuffer(data, np.uint8, 3 * size, at).reshape(-1, 3), at + 3 * size

    shared, at = colours(flags, at)
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while True:
        if at >= len(data):
            raise GifError("the file ends without a trailer")
        kind = data[at]
        if kind == 0x3B:
            return width, height, frames
        if kind == 0x21:
            label = data[at + 1 : at + 2]
            body, at = blocks(data, at + 2)
            if label == b"\xf9" and len(body) >= 4:
                delay, disposal = 10 * struct.unpack_from("<H", body, 1)[0], body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            if at + 11 > len(data):
                raise GifError("the file ends within an image")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            if w * h > most_pixels:
                raise GifError(f"a frame of {w} x {h} pixels")
            own, at = colours(flags, at + 10)
            palette = shared if own is None else own
            if palette is None:
                raise GifError("an image without a palette")
            minimum = data[at]
            body, at = blocks(data, at + 1)
            samples = lzw_decode(body, minimum, w * h)
            if len(samples) < w * h:
                raise GifError(f"{len(samples)} of {w * h} samples")
            if flags & 0x40:
                rows = np.empty((h, w), np.uint8)
                rows[row_order(h, True)] = np.frombuffer(samples, np.uint8).reshape(h, w)
                samples = rows.tobytes()
            frames.append(Frame(left, top, w, h, samples, palette, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise GifError(f"block of kind {kind}")


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels in each of LEVELS^3 colour cells, red first."""
    pixels = canvas.reshape(-1, 4).view(np.uint32).ravel()
    red, green, blue, alpha = (pixels >> shift for shift in (6, 14, 22, 24))
    cells = (red & 3) * LEVELS**2 + (green & 3) * LEVELS + (blue & 3)
    return np.bincount(cells[alpha > 0].astype(np.int64), minlength=LEVELS**3)


def painted(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The RGBA canvas as shown with each frame. Disposal 2 clears the frame's area, 3 brings back what was there before it."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        index = np.frombuffer(f.samples, np.uint8).reshape(f.height, f.width)[: area.shape[0], : area.shape[1]]
        rgba = np.zeros((256, 4), np.uint8)
        rgba[: len(f.palette), :3], rgba[:, 3] = f.palette, 255
        shown = rgba.view(np.uint32).ravel()[index].view(np.uint8).reshape(*index.shape, 4)
        if f.transparent is None:
            area[...] = shown
        else:
            opaque = index != f.transparent
            area[opaque] = shown[opaque]
        yield canvas
        if f.disposal == 2:
            area[...] = 0
        elif before is not None:
            canvas = before


def byte_palette() -> np.ndarray:
    """256 colours by rule: three bits of red, three of green, two of blue."""
    k = np.arange(256)
    return np.stack([(k >> 5) * 255 // 7, (k >> 2 & 7) * 255 // 7, (k & 3) * 255 // 3], 1).astype(np.uint8)


_PALETTE = byte_palette()


def encode_bytes(payload: bytes, row: int = ROW, frame_rows: int = FRAME_ROWS, delay_ms: int = 100) -> bytes:
    """A GIF whose frames hold ``payload`` (a multiple of ``row``) as palette indices, ``frame_rows`` rows a frame."""
    if not payload or len(payload) % row:
        raise ValueError(f"{len(payload)} bytes are no positive multiple of {row}")
    height = min(len(payload) // row, frame_rows)
    out = [b"GIF89a", struct.pack("<HHBBB", row, height, 0xF7, 0, 0), _PALETTE.tobytes()]
    for at in range(0, len(payload), row * frame_rows):
        part = payload[at : at + row * frame_rows]
        out += [b"\x21\xf9\x04\x04", struct.pack("<HBB", delay_ms // 10, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, row, len(part) // row, 0), b"\x08", chain(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def padded(data: bytes, multiple: int = ROW) -> bytes:
    """``data`` with zeros up to a positive multiple of ``multiple``."""
    return data + bytes(-len(data) % multiple or (0 if data else multiple))


FRAME_SCHEMA = (
    "frame int, left int, top int, width int, height int, start_ms long, delay_ms long, disposal int, transparent int,"
    " samples binary, histogram array<long>, canvas_width int, canvas_height int, error string"
)


def gif_frames(df: DataFrame, id_col: str, gif_col: str, with_samples: bool = True) -> DataFrame:
    """One row per frame of a binary column of GIF files: the id, rectangle, start time, delay, rules, samples and histogram.

    The histogram counts the opaque pixels of the whole canvas as shown with the frame. A null, empty or broken file, and one that declares more than
    ``MOST_PIXELS`` pixels, gives one row with its error and no frame; a file without frames gives none. Repeated rows each give their frames; null ids
    stay null; other columns are not read, whatever their names; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", *[c.split()[0] for c in FRAME_SCHEMA.split(", ")]]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ident, data in zip(pdf["id"], pdf["gif"], strict=True):
                try:
                    if data is None:
                        raise GifError("null")
                    width, height, frames = decode(bytes(data))
                except (GifError, IndexError, struct.error) as error:
                    rows.append((ident, *[None] * (len(names) - 2), str(error) or type(error).__name__))
                    continue
                start = 0
                for k, (f, canvas) in enumerate(zip(frames, painted(width, height, frames), strict=True)):
                    rows.append((ident, k, f.left, f.top, f.width, f.height, start, f.delay_ms, f.disposal, f.transparent,
                                 f.samples if with_samples else None, histogram(canvas).tolist(), width, height, None))
                    start += f.delay_ms
            yield pd.DataFrame(rows, columns=names).astype(object)

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(gif_col).alias("gif")).mapInPandas(read, f"id string, {FRAME_SCHEMA}")
    return rows.select(F.col("id").cast(kind).alias(id_col), *names[1:])


def digest(payload: bytes) -> tuple:
    """Store a payload, read it back, and describe what was read."""
    media = encode_bytes(payload)
    width, height, frames = decode(media)
    read = b"".join(f.samples for f in frames)
    start, parts = 0, []
    for f, canvas in zip(frames, painted(width, height, frames), strict=True):
        counts = histogram(canvas)
        parts.append(f"{start}+{f.delay_ms}ms;" + ",".join(f"{k}:{counts[k]}" for k in np.flatnonzero(counts)))
        start += f.delay_ms
    feature = f"{width}x{height}x{len(frames)}|" + "|".join(parts)
    return len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its text as a padded payload, stored as a GIF and read back; the feature has each frame's start, time and histogram.

    Null and empty texts give 64 zeros; repeated rows give equal rows; long texts take several frames. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(ident, len(data), *digest(padded(bytes(data)))) for ident, data in zip(pdf["id"], pdf["data"], strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": object})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_bytes(text_col).alias("data"))
    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInPandas(store, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(table(spark, sf_dir, "documents"))
