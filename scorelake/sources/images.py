"""Encoded images: binary PGM and PPM, and PNG, decoded in the scoring batch."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"
#: A header's numbers, with comments between them; one white space ends it.
_NETPBM = re.compile(rb"P([56])" + rb"(?:\s+(?:#[^\n]*\n\s*)*(\d+))" * 3 + rb"\s", re.DOTALL)
# Channels of the colour types without a palette.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_image(content: bytes) -> np.ndarray:
    """Pixels as ``(height, width, channels)``, 8 or 16 bits as stored; any other content is an error."""
    if content.startswith(_PNG):
        return _decode_png(content)
    header = _NETPBM.match(content)
    if header is None:
        raise ValueError("neither PNG nor binary PGM or PPM")
    kind, width, height, most = (int(x) for x in header.groups())
    if not 0 < most < 65536:
        raise ValueError(f"greatest value {most} is not between 1 and 65535")
    shape = height, width, 1 if kind == 5 else 3
    dtype = np.dtype(">u2" if most > 255 else "u1")
    size = shape[0] * shape[1] * shape[2] * dtype.itemsize
    body = content[header.end() : header.end() + size]
    if len(body) < size:
        raise ValueError(f"image ends after {len(body)} of {size} bytes")
    return np.frombuffer(body, dtype=dtype).reshape(shape).astype(dtype.newbyteorder("="))


def _decode_png(content: bytes) -> np.ndarray:
    at, data, header = len(_PNG), [], None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        at += 12 + size
        if len(body) < size or len(content) < at or zlib.crc32(kind + body) != int.from_bytes(content[at - 4 : at], "big"):
            raise ValueError(f"damaged {kind.decode('latin-1')} chunk")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if header is None or not data:
        raise ValueError("no image data")
    width, height, depth, colour, _, _, interlaced = header
    if depth not in (8, 16) or colour not in _CHANNELS or interlaced:
        raise ValueError(f"depth {depth}, colour type {colour}, interlacing {interlaced} are not supported")
    step = _CHANNELS[colour] * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8)
    if len(raw) != height * (1 + width * step):
        raise ValueError("wrong number of bytes")
    lines = raw.reshape(height, 1 + width * step)
    out, above = np.zeros((height, width * step), dtype=np.uint8), np.zeros(width * step, dtype=np.uint8)
    for i, (method, line) in enumerate(zip(lines[:, 0].tolist(), lines[:, 1:], strict=True)):
        above = out[i] = _unfiltered(method, line, above, step)
    pixels = out.view(">u2").astype(np.uint16) if depth == 16 else out
    return pixels.reshape(height, width, _CHANNELS[colour])


def _unfiltered(method: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line as it was before its filter, from the line above it. Sums are modulo 256."""
    if method == 0:
        return line
    if method == 2:
        return line + above
    if method == 1:
        # Each byte adds to the one a pixel before: a running sum for each place in a pixel.
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if method not in (3, 4):
        raise ValueError(f"unknown line filter {method}")
    out, values, up = [0] * (len(line) + step), line.tolist(), [0] * step + above.tolist()
    for i, value in enumerate(values):
        left, top, corner = out[i], up[i + step], up[i]
        if method == 3:
            guess = (left + top) // 2
        else:
            base = left + top - corner
            guess = min((abs(base - x), order, x) for order, x in enumerate((left, top, corner)))[2]
        out[i + step] = (value + guess) & 255
    return np.array(out[step:], dtype=np.uint8)


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Grey pixels of 8 bits, ``(height, width)``, as a binary PGM."""
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + pixels.astype(np.uint8).tobytes()


def encode_png(pixels: np.ndarray) -> bytes:
    """Grey pixels of 8 bits, ``(height, width)``, as a PNG whose lines are filtered by the line above."""
    height, width = pixels.shape
    pixels = pixels.astype(np.uint8)
    lines = np.full((height, 1 + width), 2, dtype=np.uint8)
    lines[:, 1:] = pixels - np.vstack([np.zeros((1, width), dtype=np.uint8), pixels[:-1]])

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def image_input(content: bytes) -> np.ndarray:
    """An image as a model reads it: values from -1 to 1, channel by channel."""
    pixels = decode_image(content)
    most = 255.0 if pixels.dtype == np.uint8 else 65535.0
    return (pixels.astype(np.float64) / most * 2 - 1).transpose(2, 0, 1).ravel()
