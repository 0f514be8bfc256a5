"""Decoding of small pictures without an imaging library: PNG (8 bit, not interlaced) and BMP (24 or 32 bit)."""

from __future__ import annotations

import base64
import binascii
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np


def _png(data: bytes) -> np.ndarray:
    at, idat, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced or width * height > 1 << 26:
        raise ValueError("kind of PNG")
    raw = zlib.decompressobj().decompress(b"".join(idat))
    rows = np.frombuffer(raw, np.uint8, height * (1 + width * channels)).reshape(height, 1 + width * channels)
    kinds, x = rows[:, 0], rows[:, 1:].reshape(height, width, channels)
    large = x.size > 1 << 22  # as numbers eight times that many bytes
    if kinds.any():
        x = x.copy() if large else x.astype(np.int64)
    above = np.zeros((width, channels), np.int64)
    for y, f in enumerate(kinds.tolist() if kinds.any() else ()):
        line = x[y].astype(np.int64) if large else x[y]
        if f == 1:
            np.cumsum(line, axis=0, out=line)
            line &= 255
        elif f == 2:
            line += above
            line &= 255
        elif f in (3, 4):
            _unfilter(line, above, f)
        elif f:
            raise ValueError("filter")
        if large:
            x[y] = line
        above = line
    if colour == 3:
        return palette[x[:, :, 0]].astype(np.uint8)
    if channels < 3:
        return np.repeat(x[:, :, :1], 3, axis=2).astype(np.uint8)
    return x[:, :, :3].astype(np.uint8)


def _unfilter(line: np.ndarray, above: np.ndarray, kind: int) -> None:
    """Undoes the average (3) and Paeth (4) filters of a line, channel by channel."""
    up = above.tolist()
    out = line.tolist()
    zero = [0] * len(up[0])
    left, corner = zero, zero
    for i, own in enumerate(out):
        top = up[i]
        for c in range(len(own)):
            if kind == 3:
                own[c] = (own[c] + ((left[c] + top[c]) >> 1)) & 255
            else:
                p = left[c] + top[c] - corner[c]
                a, b, d = abs(p - left[c]), abs(p - top[c]), abs(p - corner[c])
                own[c] = (own[c] + (left[c] if a <= b and a <= d else top[c] if b <= d else corner[c])) & 255
        left, corner = own, top
    line[:] = out


def _bmp(data: bytes) -> np.ndarray:
    offset, size, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packed not in (0, 3) or size < 40 or not 0 < width * abs(height) <= 1 << 26:
        raise ValueError("kind of BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)
    x = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return x[::-1] if height > 0 else x


def decode(data: bytes | None) -> np.ndarray | None:
    """Pixels (height, width, 3) of a picture; base64 text of a picture is read too; None if it can't be decoded."""
    if not data:
        return None
    for again in (True, False):
        try:
            if data[:8] == b"\x89PNG\r\n\x1a\n":
                return _png(data)
            if data[:2] == b"BM":
                return _bmp(data)
        except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
            return None
        if again:
            try:
                text = data.split(b",", 1)[1] if data[:5] == b"data:" else data
                data = base64.b64decode(b"".join(text.split()), validate=True)
            except (binascii.Error, ValueError, IndexError):
                return None
    return None


def shrink(pixels: np.ndarray, side: int = 24) -> np.ndarray | None:
    """The picture averaged down to side x side; None if its sides aren't a multiple of that."""
    h, w, _ = pixels.shape
    if h % side or w % side or h == 0:
        return None
    return pixels.reshape(side, h // side, side, w // side, 3).mean(axis=(1, 3))


def decode_or_blank(data: bytes | None, side: int = 512) -> np.ndarray:
    """The picture, or a white square where it can't be decoded."""
    pixels = decode(data)
    return np.full((side, side, 3), 255, np.uint8) if pixels is None else pixels


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _weights(old: int, new: int, first: int, last: int) -> tuple[int, np.ndarray]:
    """The new pixels from first to last in bicubic resampling of old ones: the first old pixel they need, and their weights of it and the next; the kernel is widened where the picture gets smaller."""
    scale = max(1.0, old / new)
    centre = (np.arange(first, last) + 0.5) * old / new - 0.5
    low, high = max(0, int(centre[0] - 2 * scale)), min(old, int(centre[-1] + 2 * scale) + 2)
    w = _cubic((np.arange(low, high)[None, :] - centre[:, None]) / scale)
    return low, w / w.sum(axis=1, keepdims=True)


def _bands(old: int, new: int, step: int) -> list[tuple[int, int, np.ndarray]]:
    """(first new pixel, first old pixel, weights) of every ``step`` new pixels; those of a small side are cut from the whole table."""
    whole, bands = _weights(old, new, 0, new)[1] if old <= KEPT else None, []
    for first in range(0, new, step):
        low, w = _weights(old, new, first, min(first + step, new))
        bands.append((first, low, w if whole is None else whole[first : first + step, low : low + w.shape[1]].copy()))
    return bands


#: Sides up to which weights are kept; numbers of a strip of the old picture, or of its weights, that are held at once; columns of the new one that fit in the cache.
KEPT, STRIP, COLUMNS = 1024, 1 << 23, 52
_kept_bands = lru_cache(maxsize=64)(_bands)


def _wide(x: np.ndarray, height: int, width: int) -> bool:
    """Whether columns first costs more than rows first."""
    return height * x.shape[1] * (x.shape[0] + width) > width * x.shape[0] * (x.shape[1] + height)


def _resampled(x: np.ndarray, height: int, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, whole numbers by column, channel and row) of the parts of the picture resampled to height x width; a part's room is used again for the next, so that memory doesn't follow the picture."""
    h, w, _ = x.shape
    n = height
    while n > 1 and (n + 4) * max(1.0, h / height) * max(3 * w, n) > STRIP:
        n //= 2
    bands = _kept_bands if max(h, w) <= KEPT else _bands
    across = bands(w, width, COLUMNS)
    for top, low, down in bands(h, height, n):
        strip = down @ x[low : low + down.shape[1]].reshape(-1, w * 3).astype(np.float64)
        strip = strip.reshape(-1, w, 3).transpose(1, 2, 0).reshape(w, -1)
        room = np.empty((COLUMNS, strip.shape[1]))
        for left, first, weights in across:
            y = np.matmul(weights, strip[first : first + weights.shape[1]], out=room[: len(weights)])
            np.rint(y, out=y)
            y.clip(0, 255, out=y)
            yield top, left, y.reshape(len(weights), 3, -1)


def bicubic(x: np.ndarray, height: int = 364, width: int = 364) -> np.ndarray:
    """The picture resampled to height x width."""
    if _wide(x, height, width):
        return bicubic(x.transpose(1, 0, 2), width, height).transpose(1, 0, 2)
    out = np.empty((width, 3, height), np.uint8)
    for top, left, y in _resampled(x, height, width):
        out[left : left + y.shape[0], :, top : top + y.shape[2]] = y
    return out.transpose(2, 0, 1)


def summary(x: np.ndarray, side: int = 364) -> tuple[int, float, float]:
    """Side, mean and spread of the picture resampled to side x side, from exact sums over its parts."""
    total = squares = 0
    for _, _, y in _resampled(x.transpose(1, 0, 2) if _wide(x, side, side) else x, side, side):
        y = y.reshape(len(y), -1)
        total += int((y @ np.ones(y.shape[1])).sum())
        squares += int(np.vdot(y, y))
    n = 3 * side * side
    return side, total / n, math.sqrt(n * squares - total * total) / n


_blank_summary = lru_cache(maxsize=1)(lambda: summary(decode_or_blank(None)))


def model_input(data: bytes | None) -> tuple[int, float, float]:
    """Side, mean and spread of the picture, or the blank one, as a model takes it; the resampled picture isn't kept."""
    pixels = decode(data)
    return _blank_summary() if pixels is None else summary(pixels)
