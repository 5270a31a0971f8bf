"""FLAC media columns: payloads as mono 8-bit streams, written and read with numpy over many frames at once.

Writing: blocks of 256 samples (the last one shorter), each as constant, fixed or quantised linear predictor with one Rice
partition, or verbatim, whichever is least; a seek table names every sixteenth frame. Reading: frames are found by their sync code,
header checksum and number; where samples look like headers, by decoding from the points of the seek table on; all frames of a batch
are lanes that read one Rice code and restore one sample a step; every frame's CRC-16 and every stream's MD5 is verified. Decoded blocks carry their
sample and byte offsets, so that a reader can seek. Streams of other encoders are read bit by bit (``flac_reader``).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rallyspark.llm import flac_reader
from rallyspark.llm.common import key, text_of, with_key
from rallyspark.llm.flac_reader import BadStream

BLOCK = 256
UNIT = 64
SEEK_EVERY = 16
RATE_HZ = 8000
LPC_ORDER = 4
LPC_BITS = 8
#: Frames that are coded at once, which bounds memory for texts of any length.
LANES = 8192
#: Fixed predictors of orders 0 to 4, as the format defines them.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    out, top, mask = np.zeros(256, np.uint32), 1 << (bits - 1), (1 << bits) - 1
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial) & mask if c & top else c << 1 & mask
        out[i] = c
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(buf: np.ndarray, at: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of many byte ranges, a byte of each at a step."""
    order = np.argsort(-sizes, kind="stable")
    at, n = at[order], sizes[order]
    crc, counts = np.zeros(len(at), np.uint32), np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")
    for j, a in enumerate(counts.tolist()):
        byte = buf[at[:a] + j]
        if bits == 8:
            crc[:a] = CRC8[crc[:a] ^ byte]
        else:
            c = crc[:a]
            crc[:a] = (c << np.uint32(8)) & np.uint32(0xFFFF) ^ CRC16[(c >> np.uint32(8)) ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    first = (0xFF00 >> size & 0xFF) | n >> 6 * (size - 1)
    return bytes([first] + [0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 63)


def _rice(total: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameter and estimated bits for residuals whose zigzag values sum to ``total``."""
    mean = np.maximum(total / n, 1e-9)
    k = np.clip(np.floor(np.log2(mean * 0.72 + 1)), 0, 14).astype(np.int64)
    return k, n * (k + 1) + total / 2.0**k


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of each row: coefficients (newest first) and shifts."""
    rows, n = x.shape
    f = x.astype(np.float64) * np.hanning(n + 2)[1:-1]
    auto = np.stack([np.einsum("ij,ij->i", f[:, lag:], f[:, : n - lag]) for lag in range(LPC_ORDER + 1)], 1)
    auto[:, 0] = auto[:, 0] * (1 + 1e-9) + 1e-3
    a, error = np.zeros((rows, LPC_ORDER)), auto[:, 0].copy()
    for i in range(LPC_ORDER):
        k = (auto[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], auto[:, i:0:-1][:, :i])) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 14)
    limit = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * 2.0 ** shift[:, None]), -limit - 1, limit).astype(np.int64), shift


def _residual(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order, n = coef.shape[1], x.shape[1]
    sums = np.zeros((len(x), n - order), np.int64)
    for j in range(order):
        sums += coef[:, j : j + 1] * x[:, order - 1 - j : n - 1 - j]
    return x[:, order:] - (sums >> shift[:, None])


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of one frame for each row of samples (all rows equally long), and their sizes."""
    rows, n = x.shape
    x = x.astype(np.int64)
    # 0..2: fixed predictors of that order; 3: linear predictor; then verbatim and constant
    kinds: list[tuple[np.ndarray, np.ndarray]] = []
    costs, ks, residuals = [], [], []
    for kind in range(4):
        coef, shift = (np.tile(np.array(FIXED[kind], np.int64), (rows, 1)), np.zeros(rows, np.int64)) if kind < 3 else _predictors(x)
        u = _zigzag(_residual(x, coef, shift))
        k, bits = _rice(u.sum(1), u.shape[1])
        kinds.append((coef, shift))
        residuals.append(u)
        ks.append(k)
        costs.append(bits + 10 + 8 * coef.shape[1] + (9 + LPC_BITS * LPC_ORDER) * (kind == 3))
    best = np.argmin(np.stack(costs, 1), 1)
    best[np.stack(costs, 1).min(1) >= 8 * n] = 4
    best[(x == x[:, :1]).all(1)] = 5
    # headers
    code = {256: 8, 192: 1}.get(n, 6)
    heads = [b"\xff\xf8" + bytes([code << 4 | 4, 0x02]) + _number(i) + (bytes([n - 1]) if code == 6 else b"") for i in numbers.tolist()]
    head_len = np.array(list(map(len, heads)), np.int64)
    spot, length, value, frame = [], [], [], []  # bit fields: place within the frame's subframe, bits, value, row

    def put(at, size, what, row):
        size = np.broadcast_to(np.asarray(size, np.int64), row.shape)
        spot.append(np.broadcast_to(at, row.shape))
        length.append(size)
        value.append(np.asarray(what, np.int64) & ((np.int64(1) << size) - 1))
        frame.append(row)

    body = np.zeros(rows, np.int64)  # bits of the subframe
    for kind in range(6):
        at = np.flatnonzero(best == kind)
        if not len(at):
            continue
        if kind >= 4:
            put(0, 8, np.full(len(at), 2 if kind == 4 else 0), at)
            width = n if kind == 4 else 1
            put(8 + 8 * np.tile(np.arange(width), len(at)), 8, x[at, :width].ravel(), np.repeat(at, width))
            body[at] = 8 + 8 * width
            continue
        coef, shift = kinds[kind][0][at], kinds[kind][1][at]
        order, k, u = coef.shape[1], ks[kind][at], residuals[kind][at]
        put(0, 8, np.full(len(at), (8 | order) << 1 if kind < 3 else (32 | order - 1) << 1), at)
        for j in range(order):
            put(8 + 8 * j, 8, x[at, j], at)
        b = 8 + 8 * order
        if kind == 3:
            put(b, 4, np.full(len(at), LPC_BITS - 1), at)
            put(b + 4, 5, shift, at)
            for j in range(order):
                put(b + 9 + LPC_BITS * j, LPC_BITS, coef[:, j], at)
            b += 9 + LPC_BITS * order
        put(b, 10, k, at)  # Rice coding, one partition, parameter
        b += 10
        q = u >> k[:, None]
        sizes = q + 1 + k[:, None]
        ends = np.cumsum(sizes, 1)
        put((b + ends - k[:, None] - 1).ravel(), np.repeat(k + 1, u.shape[1]), ((np.int64(1) << k[:, None]) | (u & ((np.int64(1) << k[:, None]) - 1))).ravel(), np.repeat(at, u.shape[1]))
        body[at] = b + ends[:, -1]
    sizes = head_len + 1 + (body + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(sizes)])
    spot, length, value, frame = map(np.concatenate, (spot, length, value, frame))
    bit = (starts[:-1] + head_len + 1)[frame] * 8 + spot
    words = (int(starts[-1]) + 11) // 4
    wide = value.astype(np.uint64) << (64 - (bit & 31) - length).astype(np.uint64)
    total = np.bincount(bit >> 5, (wide >> np.uint64(32)).astype(np.float64), words)
    total += np.bincount((bit >> 5) + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    buf = total.astype(">u4").view(np.uint8)[: starts[-1]].copy()
    flat = np.frombuffer(b"".join(heads), np.uint8)
    buf[np.repeat(starts[:-1] - (np.cumsum(head_len) - head_len), head_len) + np.arange(len(flat))] = flat
    buf[starts[:-1] + head_len] = _crc(buf, starts[:-1], head_len, 8)
    crc = _crc(buf, starts[:-1], sizes - 2, 16)
    buf[starts[1:] - 2], buf[starts[1:] - 1] = crc >> 8, crc & 0xFF
    return buf, sizes


def _head(samples: np.ndarray, sizes: np.ndarray) -> bytes:
    """Marker, stream information and seek table."""
    n = len(samples)
    info = struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + struct.pack(">Q", RATE_HZ << 44 | 0 << 41 | 7 << 36 | n) + hashlib.md5(samples.tobytes()).digest()
    at = np.concatenate([[0], np.cumsum(sizes)])
    points = b"".join(struct.pack(">QQH", i * BLOCK, at[i], min(BLOCK, n - i * BLOCK)) for i in range(0, len(sizes), SEEK_EVERY))
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload (unsigned bytes; a positive multiple of 64 of them)."""
    samples = [(np.frombuffer(p, np.uint8) ^ np.uint8(0x80)).view(np.int8) for p in payloads]
    full = [len(s) // BLOCK for s in samples]
    numbers = np.concatenate([np.arange(f) for f in full]) if full else np.empty(0, np.int64)
    blocks = np.concatenate([s[: f * BLOCK] for s, f in zip(samples, full, strict=True)]).reshape(-1, BLOCK) if full else np.empty((0, BLOCK))
    made, sizes = [], []
    for i in range(0, len(blocks), LANES):
        buf, size = encode_frames(blocks[i : i + LANES], numbers[i : i + LANES])
        made.append(buf.tobytes())
        sizes.append(size)
    whole, sizes = b"".join(made), np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    tails: dict[int, tuple[bytes, int]] = {}
    for rest in range(UNIT, BLOCK, UNIT):
        own = [i for i, s in enumerate(samples) if len(s) % BLOCK == rest]
        for j in range(0, len(own), LANES):
            part = own[j : j + LANES]
            buf, size = encode_frames(np.stack([samples[i][-rest:] for i in part]), np.array([full[i] for i in part]))
            at = np.concatenate([[0], np.cumsum(size)])
            tails |= {i: (buf[at[m] : at[m + 1]].tobytes(), int(size[m])) for m, i in enumerate(part)}
    out, first = [], 0
    for i, s in enumerate(samples):
        tail, size = tails.get(i, (b"", 0))
        own = sizes[first : first + full[i]]
        out.append(_head(s, np.append(own, size) if size else own) + whole[ends[first] : ends[first + full[i]]] + tail)
        first += full[i]
    return out


_POINT = np.dtype([("first", ">u8"), ("at", ">u8"), ("n", ">u2")])


def _meta(stream: bytes) -> tuple[int, int, int, bytes, np.ndarray]:
    """Where the frames begin, samples, block size and MD5 of a stream, and the offsets in a seek table like this module's."""
    if stream[:4] != b"fLaC":
        raise BadStream("no FLAC marker")
    at, last, found, points = 4, False, None, np.empty(0, np.int64)
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            body = stream[at + 4 : at + 4 + size]
            word = int.from_bytes(body[10:18], "big")
            if (word >> 41 & 7, word >> 36 & 31) != (0, 7):
                raise BadStream("only mono streams of 8 bits are read")
            found = (word & (1 << 36) - 1, int.from_bytes(body[2:4], "big"), body[18:34])
        if kind == 3:
            table = np.frombuffer(stream, _POINT, size // 18, at + 4)
            points = table["at"][table["first"] == np.arange(len(table), dtype=np.uint64) * np.uint64(SEEK_EVERY * BLOCK)].astype(np.int64)
        at += 4 + size
    if found is None:
        raise BadStream("no stream information")
    return at, *found, points


def _headers(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of candidate frames: whether the header is sound, its number, block size and length."""
    safe = np.concatenate([buf, np.zeros(32, np.uint8)])
    first = safe[at + 4].astype(np.int64)
    extra = np.select([first < 0x80, first >> 5 == 6, first >> 4 == 14, first >> 3 == 30, first >> 2 == 62, first >> 1 == 126], range(6), -1)
    number = np.where(extra > 0, first & (0x3F >> np.maximum(extra, 0)), first)
    for j in range(1, 6):
        number = np.where(extra >= j, number << 6 | (safe[at + 4 + j] & 0x3F), number)
    code, rest = safe[at + 2].astype(np.int64) >> 4, at + 5 + np.maximum(extra, 0)
    size = np.select([code == 1, (code >= 2) & (code < 6), code == 6, code == 7, code >= 8], [192, 576 << np.maximum(code - 2, 0), safe[rest].astype(np.int64) + 1, (safe[rest].astype(np.int64) << 8 | safe[rest + 1]) + 1, 256 << np.maximum(code - 8, 0)], 0)
    length = 5 + np.maximum(extra, 0) + np.select([code == 6, code == 7], [1, 2], 0)
    ok = (extra >= 0) & (size > 0) & (safe[at + 3] == 0x02) & (safe[at + 2] & 15 == 4)
    ok &= _crc(safe, at, length, 8) == safe[at + length]
    return ok, number, size, length + 1


class _Bits:
    """64 bits from any place of a buffer, for many places at once."""

    def __init__(self, buf: np.ndarray):
        padded = np.concatenate([buf, np.zeros(24, np.uint8)])
        n = len(buf) + 16
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)

    def at(self, bit: np.ndarray) -> np.ndarray:
        """At least 57 valid bits from ``bit`` on, in the high places."""
        return self.words[bit >> 3] << (bit & 7).astype(np.uint64)

    def take(self, bit: np.ndarray, size: int) -> np.ndarray:
        return (self.at(bit) >> np.uint64(64 - size)).astype(np.int64)


def _signed(x: np.ndarray, bits: int) -> np.ndarray:
    return x - ((x >> (bits - 1)) << bits)


def _codes(bits: _Bits, p: np.ndarray, k: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` Rice codes of each lane from its place and parameter on: values by step, and the places after them."""
    out, p, ku = np.empty((n, len(p)), np.int32), p.copy(), k.astype(np.uint64)
    one, low = np.uint64(1), np.uint64(63) - ku
    limit = len(bits.words) * 8 - 64
    for t in range(n):
        top = bits.at(p) >> np.uint64(32)
        q = 31 - ((top.astype(np.float64).view(np.int64) >> 52) - 1023)
        if (far := np.flatnonzero(top == 0)).size:  # long runs of zeros
            q[far] = 32
            while far.size:
                if (p[far] + q[far]).max() > limit:
                    raise BadStream("a code runs past the end")
                more = bits.at(p[far] + q[far]) >> np.uint64(32)
                zero = more == 0
                step = np.where(zero, 32, 31 - ((more.astype(np.float64).view(np.int64) >> 52) - 1023))
                q[far] += step
                far = far[zero]
        s = p + q + 1
        u = (q << k) | ((bits.at(s) >> one) >> low).astype(np.int64)
        out[t] = (u >> 1) ^ -(u & 1)
        p = s + k
        if p.max() > limit:
            raise BadStream("a code runs past the end")
    return out, p


def _decode_lanes(bits: _Bits, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (a row for each frame) of subframes of ``n`` samples at bit places, and the places after them."""
    rows = len(at)
    out, after = np.empty((rows, n), np.int8), np.empty(rows, np.int64)
    kind = bits.take(at, 8)
    if (kind & 0x81).any():
        raise BadStream("wasted bits are not read")
    kind >>= 1
    for which in np.unique(kind).tolist():
        lanes = np.flatnonzero(kind == which)
        p = at[lanes] + 8
        if which < 2:
            width = n if which else 1
            raw = np.stack([bits.take(p + 8 * j, 8) for j in range(width)], 1).astype(np.uint8).view(np.int8)
            out[lanes], after[lanes] = raw if which else np.repeat(raw, n, 1), p + 8 * width
            continue
        if not (8 <= which <= 12 or which >= 32):
            raise BadStream("unknown subframe")
        order = which & 7 if which < 32 else (which & 31) + 1
        x = np.zeros((n, len(lanes)), np.int32)
        for j in range(order):
            x[j] = _signed(bits.take(p + 8 * j, 8), 8)
        p = p + 8 * order
        if which < 32:
            coef, shift = [np.full(len(lanes), c, np.int32) for c in FIXED[order]], np.zeros(len(lanes), np.int32)
        else:
            size, shift = bits.take(p, 4) + 1, bits.take(p + 4, 5).astype(np.int32)
            coef = []
            for j in range(order):
                raw = (bits.at(p + 9 + size * j) >> (64 - size).astype(np.uint64)).astype(np.int64)
                coef.append((raw - ((raw >> (size - 1)) << size)).astype(np.int32))
            p = p + 9 + size * order
        head = bits.take(p, 10)
        if (head >> 4).any() or (head == 15).any():
            raise BadStream("only one Rice partition is read")
        residual, after[lanes] = _codes(bits, p + 10, head & 15, n - order)
        for t in range(order, n):
            if order:
                guess = coef[0] * x[t - 1]
                for j in range(1, order):
                    guess += coef[j] * x[t - 1 - j]
                np.add(guess >> shift, residual[t - order], out=x[t])
            else:
                x[t] = residual[t]
        out[lanes] = x.T
    return out, after


def _walk(buf: np.ndarray, bits: _Bits, begin: np.ndarray, end: np.ndarray, count: np.ndarray, points: list[np.ndarray]) -> list[np.ndarray]:
    """Places of the frames of some streams, from their seek tables: a frame's end follows from decoding it.

    Every stretch between two points of a table is a lane, so all stretches go forward together and the work is linear in the bytes.
    """
    stretches = -(-count // SEEK_EVERY)
    if any(len(p) != n for p, n in zip(points, stretches, strict=True)):
        raise BadStream("frames are ambiguous and the seek table does not tell them apart")
    owner = np.repeat(np.arange(len(count)), stretches)
    first = np.concatenate([np.arange(n) for n in stretches]) * SEEK_EVERY
    at = begin[owner] + np.concatenate(points)
    found = [np.full(n, -1, np.int64) for n in count.tolist()]
    for step in range(SEEK_EVERY):
        live = np.flatnonzero(first + step < count[owner])
        for i in range(0, len(live), LANES):
            part = live[i : i + LANES]
            if (at[part] + 8 > end[owner[part]]).any():
                raise BadStream("a frame lies behind the end of its stream")
            ok, number, size, head = _headers(buf, at[part])
            if not ok.all() or (number != first[part] + step).any():
                raise BadStream("a frame is not where it should be")
            for o in np.unique(owner[part]).tolist():
                own = owner[part] == o
                found[o][first[part][own] + step] = at[part][own]
            for n in np.unique(size).tolist():
                lanes = part[size == n]
                _, after = _decode_lanes(bits, (at[lanes] + head[size == n]) * 8, n)
                at[lanes] = (after + 7) // 8 + 2
    return found


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each stream: its samples as unsigned bytes, and the byte offsets of its frames. Raises BadStream for damaged ones."""
    metas = [_meta(s) for s in streams]
    buf = np.frombuffer(b"".join(streams), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    begin = base[:-1] + [m[0] for m in metas]
    at = np.flatnonzero((buf[:-1] == 0xFF) & (buf[1:] == 0xF8)).astype(np.int64)
    owner = np.searchsorted(base, at, side="right") - 1
    at = at[at >= begin[owner]]
    ok, number, size, head = _headers(buf, at)
    at, number, size, head = at[ok], number[ok], size[ok], head[ok]
    owner = np.searchsorted(base, at, side="right") - 1
    bits = _Bits(buf)
    counts = np.array([-(-m[1] // m[2]) for m in metas], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(at) != first[-1] or (number != np.arange(len(at)) - first[owner]).any():
        cuts, keep, asked = np.searchsorted(owner, np.arange(len(streams) + 1)), [], []
        for i, count in enumerate(counts.tolist()):
            own = slice(cuts[i], cuts[i + 1])
            if cuts[i + 1] - cuts[i] == count and (number[own] == np.arange(count)).all():
                keep.append(np.arange(cuts[i], cuts[i + 1]))
            else:  # samples that look like a header
                asked.append(i)
                keep.append(None)
        walked = _walk(buf, bits, begin[asked], base[1:][asked], counts[asked], [metas[i][4] for i in asked]) if asked else []
        for i, places in zip(asked, walked, strict=True):
            keep[i] = np.searchsorted(at, places)
        keep = np.concatenate(keep)
        at, size, head, owner = at[keep], size[keep], head[keep], owner[keep]
    ends = np.append(at[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True) if len(at) else np.empty(0, bool)
    ends[last] = base[1:][owner[last]]
    if (begin != at[first[:-1]]).any():
        raise BadStream("bytes before the first frame")
    stored = buf[ends - 2].astype(np.uint32) << np.uint32(8) | buf[ends - 1]
    if (_crc(buf, at, ends - at - 2, 16) != stored).any():
        raise BadStream("a frame's checksum is wrong")
    sample_at = np.concatenate([[0], np.cumsum(size)])
    pcm = np.empty(int(sample_at[-1]), np.int8)
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        for i in range(0, len(own), LANES):
            part = own[i : i + LANES]
            got, after = _decode_lanes(bits, (at[part] + head[part]) * 8, n)
            if ((after + 7) // 8 + 2 != ends[part]).any():
                raise BadStream("a frame's length is wrong")
            pcm[sample_at[part][:, None] + np.arange(n)] = got
    out = []
    for i, (_, n, _, md5, _) in enumerate(metas):
        own = pcm[sample_at[first[i]] : sample_at[first[i + 1]]]
        if len(own) != n or hashlib.md5(own.tobytes()).digest() != md5:
            raise BadStream("the decoded samples differ from the stream's digest")
        out.append((own.view(np.uint8) ^ np.uint8(0x80), at[first[i] : first[i + 1]] - base[i]))
    return out


def payload(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


def _batches(batches: Iterator[pd.DataFrame], size: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """Runs of rows with about ``size`` characters."""
    for batch in batches:
        run = batch["text"].str.len().cumsum() // size
        for _, part in batch.groupby(run, sort=False):
            yield part


def _feature(pcm: np.ndarray) -> str:
    """Exact integer features of the samples: sum, energy, zero crossings, range."""
    x = pcm.astype(np.int64) - 128
    return f"sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))};low={x.min()};high={x.max()}"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in _batches(batches):
        made = [payload(t) for t in part["text"]]
        streams = encode([p for _, p in made])
        read = decode(streams)
        raw = [pcm.tobytes() for pcm, _ in read]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        yield pd.DataFrame({
            "doc_id": part["doc_id"].array, "n_bytes": [n for n, _ in made], "payload_bytes": list(map(len, raw)), "payload_sha256": list(map(sha, raw)),
            "tail_crc32": [zlib.crc32(r[-UNIT:]) for r in raw], "media_bytes": list(map(len, streams)), "media_sha256": list(map(sha, streams)), "feature": [_feature(pcm) for pcm, _ in read],
        })


DIGESTS = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(key(), text_of().alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Every text stored as FLAC, read back and described; null and empty texts are 64 zero bytes; equal texts, equal values."""
    return with_key(_rows(docs).mapInPandas(_digests, DIGESTS))


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the FLAC stream of every row's text."""

    def run(batches):
        for part in _batches(batches):
            made = [payload(t) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_bytes": [n for n, _ in made], "media": encode([p for _, p in made])})

    return with_key(_rows(docs).mapInPandas(run, "doc_id string, n_bytes long, media binary"))


def read_blocks(stream: bytes) -> list[tuple[int, int, bytes]]:
    """First sample, byte offset and PCM bytes of every frame: by lanes where this module wrote the stream, else bit by bit."""
    try:
        (pcm, at), = decode([stream])
        return [(i * BLOCK, int(a), pcm[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i, a in enumerate(at)]
    except (BadStream, IndexError):
        audio = flac_reader.read(stream)
        return [(first, at, audio.pcm(first, n)) for at, first, n in audio.frames]


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Decoded blocks of FLAC streams (doc_id, media): block number, first sample, byte offset in the stream and PCM bytes.

    Null streams give no rows; a damaged stream fails with BadStream. Streams of other encoders give the samples of all channels
    interleaved, unsigned up to 8 bits, else signed little-endian.
    """

    def run(batches):
        for batch in batches:
            batch = batch[batch["media"].notna()]
            for doc_id, stream in zip(batch["doc_id"], batch["media"], strict=True):
                rows = read_blocks(bytes(stream))
                yield pd.DataFrame({"doc_id": [doc_id] * len(rows), "block": np.arange(len(rows)), "first_sample": [r[0] for r in rows], "byte_offset": [r[1] for r in rows], "pcm": [r[2] for r in rows]})

    return with_key(media.select(key(), "media").mapInPandas(run, "doc_id string, block long, first_sample long, byte_offset long, pcm binary"))
