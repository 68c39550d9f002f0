"""Media columns: PNG bytes in, cosine-transform hashes out."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
_ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Bytes of a scan line above which an image is refused, as a small file may claim lines of any length; of images there is no limit.
MAX_LINE = 1 << 26
#: Bytes of scan lines above which an image is inflated and hashed by itself, band by band.
WHOLE_BYTES = 1 << 24
#: Pixels that are turned into luminance at once.
BAND_PIXELS = 1 << 20


class BadImage(ValueError):
    """Why a PNG can't be read."""


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """The (kind, body) of each chunk up to IEND, checksums tested."""
    if data[:8] != SIGNATURE:
        raise BadImage("not a png")
    out, at = [], 8
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            break
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise BadImage("bad checksum")
        out.append((kind, body))
        if kind == b"IEND":
            return out
        at += 12 + size
    raise BadImage("truncated")


def parse(data: bytes) -> tuple[tuple[int, int, int, int, int], bytes, bytes]:
    """(width, height, depth, colour type, interlace), the deflated scan lines, and the palette."""
    parts = chunks(data)
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise BadImage("bad header")
    w, h, depth, colour, method, filters, lace = struct.unpack(">IIBBBBB", parts[0][1])
    if not w or not h or depth not in _DEPTHS.get(colour, ()) or method or filters or lace > 1:
        raise BadImage("bad header")
    if _stride(w, depth, colour) > MAX_LINE:
        raise BadImage("too wide")
    palette = b"".join(b for k, b in parts if k == b"PLTE")
    if colour == 3 and (not palette or len(palette) % 3):
        raise BadImage("bad palette")
    return (w, h, depth, colour, lace), b"".join(b for k, b in parts if k == b"IDAT"), palette


def line_bytes(shape: tuple[int, int, int, int, int]) -> int:
    """Bytes of an image's scan lines with their filters."""
    w, h, depth, colour, lace = shape
    return sum(ph * (1 + _stride(pw, depth, colour)) for _, _, pw, ph in _passes(w, h, lace))


class Inflated:
    """Scan lines in order, inflated no further than asked for."""

    def __init__(self, deflated: bytes):
        self.inflate, self.rest = zlib.decompressobj(), deflated

    def take(self, size: int) -> bytes:
        out = []
        try:
            while size:
                out.append(self.inflate.decompress(self.rest, size))
                self.rest = self.inflate.unconsumed_tail
                size -= len(out[-1])
                if not out[-1]:
                    raise BadImage("bad data")
        except zlib.error:
            raise BadImage("bad data") from None
        return b"".join(out)

    def end(self) -> None:
        """Fails unless all has been taken."""
        try:
            if self.inflate.decompress(self.rest, 1) or not self.inflate.eof:
                raise BadImage("bad data")
        except zlib.error:
            raise BadImage("bad data") from None


def _stride(w: int, depth: int, colour: int) -> int:
    return (w * depth * _CHANNELS[colour] + 7) // 8


def _passes(w: int, h: int, lace: int) -> list[tuple[tuple, tuple, int, int]]:
    if not lace:
        return [((0, 1), (0, 1), w, h)]
    each = [((x, dx), (y, dy), -(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in _ADAM7]
    return [p for p in each if p[2] > 0 and p[3] > 0]


def unfilter(lines: np.ndarray, bpp: int, above: np.ndarray | None = None) -> np.ndarray:
    """Undoes the line filters of many images of one shape: uint8 [images, rows, 1 + stride] to [images, rows, stride].
    ``above`` has the rows before the first, if there are any.

    Rows go one by one; within a row, images with the same filter are done together. None, left (running sums) and up take whole rows; mean
    and Paeth advance by a pixel over all their images."""
    n, h, stride = lines.shape[0], lines.shape[1], lines.shape[2] - 1
    out = np.zeros((n, h + 1, stride), np.uint8)
    if above is not None:
        out[:, 0] = above
    if (lines[:, :, 0] > 4).any():
        raise BadImage("bad filter")
    for y in range(h):
        kind, row, up = lines[:, y, 0], lines[:, y, 1:], out[:, y]
        now = row.copy()
        m = kind == 2
        now[m] += up[m]
        m = kind == 1
        if m.any():
            wide = np.zeros((m.sum(), -(-stride // bpp) * bpp), np.uint8)
            wide[:, :stride] = row[m]
            now[m] = np.cumsum(wide.reshape(len(wide), -1, bpp), axis=1, dtype=np.uint8).reshape(len(wide), -1)[:, :stride]
        for k in (3, 4):
            m = np.flatnonzero(kind == k)
            if not len(m):
                continue
            r, u = row[m].astype(np.int16), up[m].astype(np.int16)
            done = np.zeros((len(m), stride + bpp), np.int16)
            left_up = np.concatenate([np.zeros((len(m), bpp), np.int16), u], axis=1)
            for x in range(0, stride, bpp):
                end = min(x + bpp, stride)
                a, b, c = done[:, x:end], u[:, x:end], left_up[:, x:end]
                if k == 3:
                    guess = (a + b) >> 1
                else:
                    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                done[:, x + bpp : end + bpp] = (r[:, x:end] + guess) & 255
            now[m] = done[:, bpp:].astype(np.uint8)
        out[:, y + 1] = now
    return out[:, 1:]


def samples(rows: np.ndarray, w: int, depth: int, colour: int) -> np.ndarray:
    """Samples [images, rows, w, channels] in 0..255; palette places stay as they are, 16 bits lose their low byte."""
    n, h, _ = rows.shape
    ch = _CHANNELS[colour]
    if depth == 16:
        rows = rows[:, :, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=2)[:, :, : w * ch * depth].reshape(n, h, w * ch, depth)
        rows = np.packbits(bits, axis=3)[..., 0] >> (8 - depth)
        if colour != 3:
            rows = rows * np.uint8(255 // ((1 << depth) - 1))
    return rows[:, :, : w * ch].reshape(n, h, w, ch)


def grey(x: np.ndarray, colour: int, palette: bytes = b"") -> np.ndarray:
    """Luminance [images, rows, w], transparent pixels over white."""
    if colour == 3:
        table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        if x.size and x.max() >= len(table):
            raise BadImage("bad palette")
        x, colour = table[x[..., 0]], 2
    x = x.astype(np.float64)
    light = x[..., :3] @ [0.299, 0.587, 0.114] if colour in (2, 6) else x[..., 0]
    if colour in (4, 6):
        alpha = x[..., -1] / 255
        light = light * alpha + 255 * (1 - alpha)
    return light


def bands(shape: tuple[int, int, int, int, int], n: int, take: Callable[[int], np.ndarray], palette: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and luminance [images, rows, columns] of ``n`` images of one shape, some pixels at a time; ``take`` gives the next scan
    lines' bytes, uint8 [images, bytes]."""
    w, h, depth, colour, lace = shape
    bits = depth * _CHANNELS[colour]
    wide = min(1 << 16, max(8, BAND_PIXELS // n // 8 * 8))  # whole bytes
    for (x, dx), (y, dy), pw, ph in _passes(w, h, lace):
        line, above = 1 + _stride(pw, depth, colour), None
        step = max(1, BAND_PIXELS // (n * pw))
        for top in range(0, ph, step):
            k = min(step, ph - top)
            rows = unfilter(take(k * line).reshape(n, k, line), max(1, bits // 8), above)
            above = rows[:, -1]
            for c in range(0, pw, wide):
                m = min(wide, pw - c)
                part = rows[:, :, c * bits // 8 : ((c + m) * bits + 7) // 8]
                yield y + dy * np.arange(top, top + k), x + dx * np.arange(c, c + m), grey(samples(part, m, depth, colour), colour, palette)


def _shrink(n: int, at: np.ndarray | None = None, to: int = 32) -> np.ndarray:
    """Rows that average n places, or those at ``at`` of them, into ``to`` boxes of equal width."""
    edges = np.linspace(0, n, to + 1)
    at = np.arange(n) if at is None else at
    part = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
    return np.maximum(part, 0) * (to / n)


_DCT = np.cos(np.pi * (2 * np.arange(32) + 1) * np.arange(8)[:, None] / 64)


def cosine_hashes(small: np.ndarray) -> np.ndarray:
    """64 bits for each image averaged to 32 x 32, as uint8 [images, 8]: which of its 8 x 8 lowest frequencies exceed
    the median of those without the constant one, whose bit is 0."""
    low = np.round(_DCT @ small @ _DCT.T, 4).reshape(len(small), 64)
    out = low > np.median(low[:, 1:], axis=1, keepdims=True)
    out[:, 0] = False
    return np.packbits(out, axis=1)


def averaged(shape: tuple[int, int, int, int, int], n: int, take: Callable[[int], np.ndarray], palette: bytes) -> np.ndarray:
    """The images averaged to 32 x 32, band by band."""
    small = np.zeros((n, 32, 32))
    for rows, columns, light in bands(shape, n, take, palette):
        small += _shrink(shape[1], rows) @ light @ _shrink(shape[0], columns).T
    return small


def _stacked(raws: list[bytes]) -> Callable[[int], np.ndarray]:
    data, at = np.frombuffer(b"".join(raws), np.uint8).reshape(len(raws), -1), 0

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return data[:, at - size : at]

    return take


def hash_images(images: list[bytes | None]) -> tuple[list, list, list, list]:
    """Widths, heights, states and hashes. Images of one shape and palette are unfiltered and hashed together, large ones by themselves."""
    n = len(images)
    width, height, state, out = [None] * n, [None] * n, [None] * n, [None] * n
    groups: dict[tuple, list[tuple[int, bytes]]] = {}
    held = 0

    def flush() -> None:
        for (shape, palette), rows in groups.items():
            parts = [rows]
            while parts:
                part = parts.pop()
                try:
                    small = averaged(shape, len(part), _stacked([r for _, r in part]), palette)
                    for (i, _), code in zip(part, cosine_hashes(small)):
                        state[i], out[i] = "ok", code.tobytes()
                except BadImage as e:
                    if len(part) == 1:
                        state[part[0][0]] = str(e)
                    else:  # one of them is bad: each alone
                        parts += [[x] for x in part]
        groups.clear()

    for i, data in enumerate(images):
        if data is None:
            continue
        try:
            shape, deflated, palette = parse(data)
            lines, size = Inflated(deflated), line_bytes(shape)
            width[i], height[i] = shape[:2]
            if size > WHOLE_BYTES:
                small = averaged(shape, 1, lambda k: np.frombuffer(lines.take(k), np.uint8)[None], palette)  # noqa: B023
                lines.end()
                state[i], out[i] = "ok", cosine_hashes(small)[0].tobytes()
                continue
            raw = lines.take(size)
            lines.end()
        except BadImage as e:
            state[i] = str(e)
            continue
        groups.setdefault((shape, palette), []).append((i, raw))
        held += size
        if held > WHOLE_BYTES:
            flush()
            held = 0
    flush()
    return width, height, state, out


def image_hashes(media: DataFrame, key: str, image: str = "image") -> DataFrame:
    """``(key, width, height, state, hash)`` for every row: ``hash`` is binary, 8 bytes; ``state`` is ``ok`` or why there is none.

    A null image has nulls throughout, an image that can't be read has its reason. All PNG colour types, depths, filters and
    interlacing are read, of any size up to scan lines of ``MAX_LINE`` bytes; the palette's transparency is not. Rows that repeat have equal results; null keys stay. Other
    columns are not read. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, state, code = hash_images(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(state, pa.string()), pa.array(code, pa.binary())], [key, "width", "height", "state", "hash"])

    schema = T.StructType([media.schema[key], T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("state", T.StringType()), T.StructField("hash", T.BinaryType())])
    return media.select(key, image).mapInArrow(run, schema)


def encode(pixels: np.ndarray, filters: np.ndarray | None = None, level: int = 1) -> bytes:
    """An 8-bit grey PNG of a uint8 [rows, w] image; ``filters`` gives each row's (0 to 4)."""
    h, w = pixels.shape
    kind = np.zeros(h, np.uint8) if filters is None else np.asarray(filters, np.uint8)
    x = pixels.astype(np.int16)
    a = np.pad(x, ((0, 0), (1, 0)))[:, :-1]
    b = np.pad(x, ((1, 0), (0, 0)))[:-1]
    c = np.pad(x, ((1, 0), (1, 0)))[:-1, :-1]
    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    guess = np.stack([0 * x, a, b, (a + b) >> 1, np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))])
    rows = (x - guess[kind, np.arange(h)]) & 255
    raw = np.concatenate([kind[:, None], rows.astype(np.uint8)], axis=1).tobytes()
    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(raw, level)), (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def rendered(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 4) -> DataFrame:
    """``(key, image)``: each vector as a square grey PNG, an entry a block of ``scale`` x ``scale`` pixels, rows filtered in turn by
    all five filters. A null or empty vector has a null image; null and missing entries are middle grey."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                if not v:
                    out.append(None)
                    continue
                side = int(np.ceil(np.sqrt(len(v))))
                x = np.zeros(side * side)
                x[: len(v)] = [0.0 if e is None else e for e in v]
                x = np.clip(np.nan_to_num(x) * 400 + 128, 0, 255).astype(np.uint8).reshape(side, side).repeat(scale, 0).repeat(scale, 1)
                out.append(encode(x, np.arange(len(x)) % 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "image"])

    return embeddings.select(key, vector).mapInArrow(run, T.StructType([embeddings.schema[key], T.StructField("image", T.BinaryType())]))
