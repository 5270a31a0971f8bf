"""A bit-serial reader of any FLAC stream: 4 to 32 bits, up to eight channels, all subframe kinds, partitioned Rice and escape codes.

It follows the format's description step by step and shares no code with the lane reader of ``flac``, which reads only the streams
that module writes; streams of other encoders, and the tests, come here. Frames are read one behind the other, so nothing is searched.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np


class BadStream(ValueError):
    pass


#: Block sizes and sample sizes of header codes, predictors of the fixed orders (newest sample first).
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


@dataclass
class Audio:
    samples: np.ndarray  # a row for each sample, a column for each channel
    bits: int
    rate: int
    frames: list[tuple[int, int, int]]  # byte offset, first sample, samples

    def pcm(self, first: int = 0, count: int | None = None) -> bytes:
        """Interleaved samples as in a WAV file: unsigned bytes up to 8 bits, else signed little-endian."""
        part, width = self.samples[first : None if count is None else first + count], -(-self.bits // 8)
        if width == 1:
            return (part + 128).astype(np.uint8).tobytes()
        return np.ascontiguousarray(part.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


class _Reader:
    def __init__(self, raw: bytes, at: int):
        self.raw, self.bit = raw, at * 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        end = self.bit + n
        if end > len(self.raw) * 8:
            raise BadStream("the stream ends early")
        word = int.from_bytes(self.raw[self.bit >> 3 : (end + 7) >> 3], "big")
        self.bit = end
        return word >> (-end & 7) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def zeros(self) -> int:
        """Zero bits before the next one bit, which is taken too."""
        n = 0
        while not self.take(1):
            n += 1
        return n


def _check(raw: bytes, polynomial: int, bits: int) -> int:
    c, top = 0, 1 << bits
    for byte in raw:
        c ^= byte << (bits - 8)
        for _ in range(8):
            c = c << 1 ^ polynomial if c << 1 & top else c << 1
            c &= top - 1
    return c


def _number(r: _Reader) -> int:
    first = r.take(8)
    if first < 0x80:
        return first
    more = 0
    while first >> (6 - more) & 1:
        more += 1
    if not first & 0x40 or more > 6:
        raise BadStream("a frame's number is wrong")
    n = first & (0x3F >> more)
    for _ in range(more):
        n = n << 6 | r.take(8) & 0x3F
    return n


def _residual(r: _Reader, n: int, order: int) -> list[int]:
    method, depth = r.take(2), r.take(4)
    if method > 1 or n % (1 << depth) or n >> depth < order:
        raise BadStream("a residual's partitions are wrong")
    width, out = 4 + method, []
    for part in range(1 << depth):
        count, k = (n >> depth) - (0 if part else order), r.take(width)
        if k == (1 << width) - 1:
            size = r.take(5)
            out += [r.signed(size) for _ in range(count)]
            continue
        for _ in range(count):
            u = r.zeros() << k | r.take(k)
            out.append(u >> 1 ^ -(u & 1))
    return out


def _subframe(r: _Reader, n: int, bits: int) -> list[int]:
    if r.take(1):
        raise BadStream("a subframe does not begin with a zero")
    kind = r.take(6)
    wasted = r.zeros() + 1 if r.take(1) else 0
    bits -= wasted
    if kind == 0:
        x = [r.signed(bits)] * n
    elif kind == 1:
        x = [r.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        x, shift, weights = [r.signed(bits) for _ in range(order)], 0, FIXED[order] if kind < 32 else ()
        if kind >= 32:
            width, shift = r.take(4) + 1, r.signed(5)
            if width == 16 or shift < 0:
                raise BadStream("a predictor is wrong")
            weights = [r.signed(width) for _ in range(order)]
        for e in _residual(r, n, order):
            x.append(e + (sum(w * x[-1 - j] for j, w in enumerate(weights)) >> shift))
    else:
        raise BadStream("unknown subframe")
    return [v << wasted for v in x] if wasted else x


def read(stream: bytes) -> Audio:
    """All samples of a stream, every checksum verified; raises BadStream for damaged ones."""
    if stream[:4] != b"fLaC":
        raise BadStream("no FLAC marker")
    at, last, info = 4, False, None
    while not last:
        if at + 4 > len(stream):
            raise BadStream("the stream ends early")
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = stream[at + 4 : at + 4 + size]
        at += 4 + size
    if info is None or len(info) < 34:
        raise BadStream("no stream information")
    word = int.from_bytes(info[10:18], "big")
    rate, channels, width, total = word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1
    r, parts, frames, done = _Reader(stream, at), [], [], 0
    while r.bit < len(stream) * 8 and (done < total or not total):
        begin = r.bit >> 3
        if r.take(15) != 0x7FFC:
            raise BadStream("no frame where one should begin")
        r.take(1)
        code, speed, layout, depth = r.take(4), r.take(4), r.take(4), r.take(3)
        if r.take(1) or code == 0 or speed == 15 or layout > 10 or depth == 3:
            raise BadStream("a frame's header is wrong")
        _number(r)
        n = r.take(8) + 1 if code == 6 else r.take(16) + 1 if code == 7 else SIZES[code]
        r.take({12: 8, 13: 16, 14: 16}.get(speed, 0))
        if _check(stream[begin : r.bit >> 3], 0x07, 8) != r.take(8):
            raise BadStream("a header's checksum is wrong")
        bits = WIDTHS.get(depth, width)
        x = [_subframe(r, n, bits + (layout in (8, 10) and c == 1 or layout == 9 and c == 0)) for c in range(2 if layout >= 8 else layout + 1)]
        if len(x) != channels:
            raise BadStream("a frame's channels are not the stream's")
        a = np.array(x, np.int64)
        if layout == 8:
            a[1] = a[0] - a[1]
        elif layout == 9:
            a[0] = a[0] + a[1]
        elif layout == 10:
            mid = a[0] << 1 | a[1] & 1
            a = np.stack([mid + a[1] >> 1, mid - a[1] >> 1])
        r.bit = (r.bit + 7) & ~7
        if _check(stream[begin : r.bit >> 3], 0x8005, 16) != r.take(16):
            raise BadStream("a frame's checksum is wrong")
        parts.append(a.T)
        frames.append((begin, done, n))
        done += n
    samples = np.concatenate(parts) if parts else np.empty((0, channels), np.int64)
    out = Audio(samples, width, rate, frames)
    if total and done != total:
        raise BadStream("frames are missing")
    raw = samples.astype(np.int8).tobytes() if width <= 8 else out.pcm()
    if any(info[18:34]) and hashlib.md5(raw).digest() != info[18:34]:
        raise BadStream("the decoded samples differ from the stream's digest")
    return out
