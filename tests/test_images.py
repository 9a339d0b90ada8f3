"""Image decoding: every line filter, depth and header form, and damaged files."""

import struct
import zlib

import numpy as np
import pytest

from scorelake.operators import nets
from scorelake.operators import scoring as SC
from scorelake.operators.registry import Model
from scorelake.session import scratch_path
from scorelake.sinks.tables import write_blobs
from scorelake.sources import images as IM
from scorelake.sources.signals import read_blobs


def png(pixels, methods, depth=8, colour=0):
    """A PNG whose lines use the given filters, written byte by byte from their definitions."""
    height, width, channels = pixels.shape
    raw = pixels.astype(">u2" if depth == 16 else "u1").reshape(height, -1).view(np.uint8).reshape(height, -1).astype(int)
    step, body = channels * depth // 8, b""
    for y in range(height):
        body += bytes([methods[y % len(methods)]])
        for x in range(raw.shape[1]):
            a = raw[y, x - step] if x >= step else 0
            b = raw[y - 1, x] if y else 0
            c = raw[y - 1, x - step] if y and x >= step else 0
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            guess = [0, a, b, (a + b) // 2, nearest][methods[y % len(methods)]]
            body += bytes([(raw[y, x] - guess) % 256])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = zlib.compress(body)
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("depth, colour, channels", [(8, 0, 1), (8, 2, 3), (8, 4, 2), (8, 6, 4), (16, 0, 1), (16, 2, 3)])
@pytest.mark.parametrize("methods", [(0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)])
def test_png(depth, colour, channels, methods):
    rng = np.random.default_rng(depth + colour)
    pixels = rng.integers(0, 2**depth, (9, 7, channels))
    found = IM.decode_image(png(pixels, methods, depth, colour))
    assert found.dtype == (np.uint16 if depth == 16 else np.uint8) and (found == pixels).all()


def test_netpbm_headers():
    grey = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    body = grey.tobytes()
    for header in (b"P5 3 2 255\n", b"P5\n# a comment\n3 2\n# and\n# another\n255\n", b"P5\t3\r\n2 255 "):
        assert (IM.decode_image(header + body) == grey).all()
    wide = np.array([[[1, 256, 65535]]], dtype=np.uint16)
    assert (IM.decode_image(b"P6 1 1 65535\n" + wide.astype(">u2").tobytes()) == wide).all()


def test_round_trips_and_input():
    pixels = np.random.default_rng(1).integers(0, 256, (5, 4))
    for encode in (IM.encode_pgm, IM.encode_png):
        assert (IM.decode_image(encode(pixels))[:, :, 0] == pixels).all()
        assert np.allclose(IM.image_input(encode(pixels)), pixels.ravel() / 255 * 2 - 1)


@pytest.mark.parametrize("bad", [b"", b"GIF89a", b"P5 3 2 255\nabc", b"P5 3 2 0\n", IM.encode_png(np.zeros((3, 3)))[:40], IM.encode_png(np.zeros((3, 3))).replace(b"IDAT", b"IDAX")])
def test_damaged_files_are_errors(bad):
    with pytest.raises(ValueError):
        IM.decode_image(bad)


def test_files_of_a_folder_are_scored(spark):
    rng = np.random.default_rng(3)
    images = {f"{i}.png": rng.integers(0, 256, (4, 4)) for i in range(12)}
    path = scratch_path(spark, "images")
    rows = spark.createDataFrame([(n, bytearray(IM.encode_png(p))) for n, p in images.items()], "name string, content binary")
    assert write_blobs(rows, path).count() == 12
    model = Model("m", nets.linear, {"fc.weight": rng.normal(size=(3, 16)), "fc.bias": np.zeros(3)}, (1, 4, 4), "logits")
    found = SC.score_blobs(read_blobs(spark, path, "*.png"), model, IM.image_input, dtype="float64", batch_size=5).collect()
    assert len(found) == 12
    for r in found:
        z = model.weights["fc.weight"] @ (images[r["path"].rsplit("/", 1)[-1]].ravel() / 255 * 2 - 1)
        assert r["pred"] == z.argmax() and np.allclose(r["logits"], z) and r["device"] == "cpu"
    with pytest.raises(Exception, match="no gpu resource"):
        SC.score_blobs(read_blobs(spark, path, "*.png"), model, IM.image_input, device_mode="gpu_only").collect()
