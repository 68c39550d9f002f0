import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import media
from sextant.llm.media import _ADAM7, SIGNATURE, Inflated, _shrink, averaged, bands, cosine_hashes, encode, hash_images, image_hashes, line_bytes, parse, rendered


def build(raw: bytes, w, h, depth, colour, lace=0, extra=()):
    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, lace)), *extra, (b"IDAT", zlib.compress(raw)), (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def decoded(data):
    shape, deflated, palette = parse(data)
    lines, out = Inflated(deflated), np.full((shape[1], shape[0]), -1.0)
    for rows, columns, light in bands(shape, 1, lambda k: np.frombuffer(lines.take(k), np.uint8)[None], palette):
        out[np.ix_(rows, columns)] = light[0]
    lines.end()
    return out


def whole(light):
    return cosine_hashes((_shrink(light.shape[0]) @ light @ _shrink(light.shape[1]).T)[None])[0]


def test_all_filters_round_trip():
    r = np.random.default_rng(1)
    for w, h in ((1, 1), (7, 5), (33, 20)):
        pixels = r.integers(0, 256, (h, w), dtype=np.uint8)
        for kinds in (*([k] * h for k in range(5)), np.arange(h) % 5):
            assert (decoded(encode(pixels, np.array(kinds))) == pixels).all()


def test_colour_types_depths_and_interlacing():
    r = np.random.default_rng(2)
    rgb = r.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    assert np.allclose(decoded(build(raw, 5, 6, 8, 2)), rgb @ np.array([0.299, 0.587, 0.114]))
    rgba = np.concatenate([rgb, r.integers(0, 256, (6, 5, 1), dtype=np.uint8)], axis=2)
    light, alpha = rgb @ np.array([0.299, 0.587, 0.114]), rgba[..., 3] / 255
    assert np.allclose(decoded(build(b"".join(b"\0" + row.tobytes() for row in rgba), 5, 6, 8, 6)), light * alpha + 255 * (1 - alpha))
    bits = r.integers(0, 2, (4, 11), dtype=np.uint8)
    assert (decoded(build(b"".join(b"\0" + np.packbits(row).tobytes() for row in bits), 11, 4, 1, 0)) == bits * 255).all()
    wide = r.integers(0, 65536, (3, 4)).astype(">u2")
    assert (decoded(build(b"".join(b"\0" + row.tobytes() for row in wide), 4, 3, 16, 0)) == wide >> 8).all()
    palette = r.integers(0, 256, (4, 3), dtype=np.uint8)
    places = r.integers(0, 4, (3, 6), dtype=np.uint8)
    data = build(b"".join(b"\0" + row.tobytes() for row in places), 6, 3, 8, 3, extra=[(b"PLTE", palette.tobytes())])
    assert np.allclose(decoded(data), palette[places] @ np.array([0.299, 0.587, 0.114]))
    grey = r.integers(0, 256, (13, 9), dtype=np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for x, y, dx, dy in _ADAM7 for row in grey[y::dy, x::dx] if row.size)
    assert (decoded(build(raw, 9, 13, 8, 0, 1)) == grey).all()


def test_hash_against_the_sum_of_its_definition():
    x = np.random.default_rng(3).integers(0, 256, (32, 32)).astype(float)
    low = np.array([[sum(x[i, j] * np.cos(np.pi * (2 * i + 1) * u / 64) * np.cos(np.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)]).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    assert (np.unpackbits(whole(x)) == bits).all()
    assert (whole(x.repeat(3, 0).repeat(3, 1)) == whole(x)).all()


@pytest.mark.parametrize("lace", [0, 1])
@pytest.mark.parametrize("band,wide", [(1 << 20, 1 << 24), (300, 1 << 24), (300, 1000), (8, 0)])
def test_bands_of_any_size_give_one_hash(monkeypatch, lace, band, wide):
    monkeypatch.setattr(media, "BAND_PIXELS", band)
    monkeypatch.setattr(media, "WHOLE_BYTES", wide)
    r = np.random.default_rng(8)
    grey, rgb = r.integers(0, 256, (61, 47), dtype=np.uint8), r.integers(0, 256, (61, 47, 3), dtype=np.uint8)
    one = r.integers(0, 2, (61, 47), dtype=np.uint8)
    passes = _ADAM7 if lace else ((0, 0, 1, 1),)
    lines = lambda x, f: b"".join(b"\0" + f(row) for a, b, dx, dy in passes for row in x[b::dy, a::dx] if row.size)
    cases = [(lines(grey, bytes), 8, 0, grey), (lines(rgb, lambda row: row.tobytes()), 8, 2, rgb @ np.array([0.299, 0.587, 0.114])), (lines(one, lambda row: np.packbits(row).tobytes()), 1, 0, one * 255.0)]
    images = [build(raw, 47, 61, depth, colour, lace) for raw, depth, colour, _ in cases for _ in range(2)]
    *_, states, out = hash_images(images)
    assert states == ["ok"] * 6
    assert [bytes(x) for x in out] == [whole(light).tobytes() for *_, light in cases for _ in range(2)]


def test_a_large_image_takes_little_memory():
    import tracemalloc

    data = encode(np.zeros((6000, 6000), np.uint8), np.full(6000, 2))
    tracemalloc.start()
    *_, state, out = hash_images([data])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert state == ["ok"] and len(out[0]) == 8 and peak < 60 << 20
    assert line_bytes(parse(data)[0]) == 6000 * 6001 and averaged(parse(data)[0], 1, Counted(6001), b"").max() == 0


class Counted:
    """Scan lines of nothing."""

    def __init__(self, line):
        self.line = line

    def __call__(self, size):
        assert size % self.line == 0
        return np.zeros((1, size), np.uint8)


@pytest.mark.parametrize("damage,state", [
    (lambda d: b"GIF89a" + d[6:], "not a png"),
    (lambda d: d[:-20], "truncated"),
    (lambda d: d[:40] + bytes([d[40] ^ 1]) + d[41:], "bad checksum"),
    (lambda d: b"", "not a png"),
    (lambda d: build(b"\7" + bytes(4), 4, 1, 8, 0), "bad filter"),
    (lambda d: build(bytes(3), 4, 1, 8, 0), "bad data"),
    (lambda d: build(b"", 0, 1, 8, 0), "bad header"),
    (lambda d: build(b"", 1 << 20, 1 << 20, 8, 0), "bad data"),
    (lambda d: build(b"", 1 << 28, 4, 8, 0), "too wide"),
    (lambda d: build(bytes(6), 4, 1, 8, 0), "bad data"),
    (lambda d: build(bytes(5), 4, 1, 8, 3), "bad palette"),
])
def test_damage_is_named(damage, state):
    good = encode(np.arange(64, dtype=np.uint8).reshape(8, 8))
    w, h, states, out = hash_images([damage(good), good, None])
    assert states == [state, "ok", None] and out[0] is None and len(out[1]) == 8 and out[2] is None


def test_every_case_has_a_result(spark):
    good = encode(np.random.default_rng(4).integers(0, 256, (300, 200), dtype=np.uint8))
    rows = [(1, good), (1, good), (None, good), (2, None), (3, b"x")]
    media = spark.createDataFrame([(k, bytearray(d) if d is not None else None) for k, d in rows], "k long, image binary").withColumns({"hash": F.lit(1), "state": F.lit(2)})
    got = sorted((x.k or 0, x.state, x.width) for x in image_hashes(media, "k").collect() if x.state)
    assert got == [(0, "ok", 200), (1, "ok", 200), (1, "ok", 200), (3, "not a png", None)]
    assert image_hashes(media, "k").where("state is null").count() == 1 and image_hashes(media.limit(0), "k").count() == 0
    vectors = spark.createDataFrame([(1, [0.1, None, -0.2]), (2, None), (3, [])], "vec_id long, embedding array<float>")
    assert sorted((x.vec_id, x.state) for x in image_hashes(rendered(vectors), "vec_id").where("state is not null").collect()) == [(1, "ok")]
