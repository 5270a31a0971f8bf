import hashlib
import time
import zlib

import numpy as np
import pytest

from rallyspark.llm import flac, flac_reader


def padded(text):
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def test_round_trip_of_payloads():
    rng = np.random.default_rng(5)
    waves = (128 + 60 * np.sin(np.arange(4096) / 7)).astype(np.uint8).tobytes()
    payloads = [bytes(64), bytes([255]) * 320, rng.bytes(64 * 9), waves, waves[:192], b"\xff\xf8" * 160, bytes(range(256)) * 2 + bytes(64)]
    streams = flac.encode(payloads)
    read = flac.decode(streams)
    assert [pcm.tobytes() for pcm, _ in read] == payloads
    assert len(streams[3]) < 0.7 * len(waves) and all(s[:4] == b"fLaC" for s in streams)
    for stream, (_, at) in zip(streams, read, strict=True):
        assert all(stream[a : a + 2] == b"\xff\xf8" for a in at)


def test_damage_is_found():
    stream = bytearray(flac.encode([b"some text that is stored here    " * 20 + bytes(44)])[0])
    stream[-10] ^= 1
    with pytest.raises(flac.BadStream):
        flac.decode([bytes(stream)])


def test_digests_and_blocks(spark, docs, wide, empty):
    want = set()
    for r in docs.collect():
        n, p = padded(r.text)
        want.add((r.doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    got = flac.digests(wide).collect()
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want and len(got) == docs.count()
    media = flac.encode_media(docs.where("doc_id in (1, 8)"))
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    by = {r.doc_id: r for r in got}
    assert all(hashlib.sha256(s).hexdigest() == by[d].media_sha256 and len(s) == by[d].media_bytes for d, s in stored.items())
    blocks = flac.pcm_blocks(media).orderBy("doc_id", "block").collect()
    for d, s in stored.items():
        own = [b for b in blocks if b.doc_id == d]
        n, p = padded(docs.where(f"doc_id = {d}").first().text)
        assert b"".join(bytes(b.pcm) for b in own) == p
        assert [b.first_sample for b in own] == [i * flac.BLOCK for i in range(len(own))] and all(s[b.byte_offset : b.byte_offset + 2] == b"\xff\xf8" for b in own)
    assert flac.digests(empty).count() == 0


def test_samples_that_look_like_a_header():
    rng = np.random.default_rng(3)
    pool = [chr(c) for c in [*range(32, 127), *range(0xC0, 0x180), *range(0x4E00, 0x4F00)]]
    texts = []
    for i in range(20):
        words = "".join(rng.choice(pool, 400))
        texts.append(words[:40] + "\x7fx\u4081\x00x" * (1 + i % 3) + words[40:])
    payloads = [flac.payload(t)[1] for t in texts]
    assert [pcm.tobytes() for pcm, _ in flac.decode(flac.encode(payloads))] == payloads
    fake = bytearray(rng.integers(0, 256, 64 * 12, dtype=np.uint8).tobytes())
    for at in range(5, len(fake) - 16, 24):  # headers with the right checksum and the next number, as 8-bit samples
        head = bytes([0xFF, 0xF8, 0x84, 0x02, at * 3 // len(fake) + 1])
        head += bytes([flac_reader._check(head, 7, 8)])
        fake[at : at + 6] = bytes(b ^ 0x80 for b in head)
    assert flac.decode(flac.encode([bytes(fake)]))[0][0].tobytes() == bytes(fake)


def test_streams_by_the_bit_serial_reader():
    rng = np.random.default_rng(6)
    waves = (128 + 60 * np.sin(np.arange(4096) / 7)).astype(np.uint8).tobytes()
    for payload in (bytes(64), rng.bytes(64 * 9), waves, b"plain text of a document with words " * 64):
        stream = flac.encode([payload])[0]
        audio = flac_reader.read(stream)
        assert audio.pcm() == payload and (audio.bits, audio.rate, audio.samples.shape[1]) == (8, flac.RATE_HZ, 1)
        assert [f[0] for f in audio.frames] == flac.decode([stream])[0][1].tolist()


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value & (1 << n) - 1, f"0{n}b") if n else ""

    def bytes(self):
        self.text += "0" * (-len(self.text) % 8)
        return int(self.text, 2).to_bytes(len(self.text) // 8, "big")


def rice(out, values, depth, order, method, escaped=()):
    out.put(method, 2)
    out.put(depth, 4)
    n, at = (len(values) + order) >> depth, 0
    for part in range(1 << depth):
        own = values[at : at + n - (0 if part else order)]
        at += len(own)
        if part in escaped:
            size = 0 if not any(own) else max(v.bit_length() for v in own) + 1
            out.put((16 << method) - 1, 4 + method)
            out.put(size, 5)
            for v in own:
                out.put(v, size)
            continue
        k = 3 + part
        out.put(k, 4 + method)
        for v in own:
            u = v << 1 if v >= 0 else (-v << 1) - 1
            out.put(1, (u >> k) + 1)
            out.put(u, k)


def stereo_stream(left, right, layout):
    """16-bit stereo of one frame: a fixed predictor of order 2 with four partitions, two of them escaped, and a linear predictor."""
    n, a, b = len(left), list(left), list(right)
    first, second = {1: (a, b), 8: (a, [x - y for x, y in zip(a, b)]), 9: ([x - y for x, y in zip(a, b)], b), 10: ([(x + y) >> 1 for x, y in zip(a, b)], [x - y for x, y in zip(a, b)])}[layout]
    wide = [16 + (layout == 9), 16 + (layout in (8, 10))]
    out = Bits()
    for x, n_bits in zip((0x7FFC, 0, 7, 9, layout, 4, 0, 0), (15, 1, 4, 4, 4, 3, 1, 8)):
        out.put(x, n_bits)
    out.put(n - 1, 16)
    out.put(flac_reader._check(out.bytes(), 7, 8), 8)
    out.put(10 << 1, 8)  # fixed, order 2
    for v in first[:2]:
        out.put(v, wide[0])
    rice(out, [first[i] - 2 * first[i - 1] + first[i - 2] for i in range(2, n)], 2, 2, 1, (1, 3))
    wasted = 2 if all(v % 4 == 0 for v in second) else 0
    second = [v >> wasted for v in second]
    out.put(32 << 1 | bool(wasted), 8)  # linear, order 1
    if wasted:
        out.put(1, wasted)
    out.put(second[0], wide[1] - wasted)
    out.put(5, 4)
    out.put(3, 5)
    out.put(7, 6)
    rice(out, [second[i] - (7 * second[i - 1] >> 3) for i in range(1, n)], 1, 1, 0)
    frame = out.bytes()
    frame += flac_reader._check(frame, 0x8005, 16).to_bytes(2, "big")
    pcm = np.stack([left, right], 1).astype("<i2").tobytes()
    info = bytes(10) + (44100 << 44 | 1 << 41 | 15 << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + info + frame, pcm


@pytest.mark.parametrize("layout", [1, 8, 9, 10])
def test_other_encoders_streams(layout):
    rng = np.random.default_rng(layout)
    left = (3000 * np.sin(np.arange(1000) / 20) + rng.integers(-40, 40, 1000)).astype(int).tolist()
    right = (2000 * np.cos(np.arange(1000) / 30) + rng.integers(-40, 40, 1000)).astype(int)
    right = (right * 4 if layout == 1 else right).tolist()
    stream, pcm = stereo_stream(left, right, layout)
    assert flac.read_blocks(stream) == [(0, 42, pcm)]
    with pytest.raises(flac.BadStream):
        flac.read_blocks(stream[:-9] + bytes([stream[-9] ^ 1]) + stream[-8:])


def test_a_long_text_of_lines_like_headers_takes_linear_time():
    n, raw = padded("\x7fx\u4081\x00x" * 150_000)
    assert n > 1_000_000
    stream = flac.encode([raw, bytes(64)])
    began = time.process_time()
    (pcm, at), _ = flac.decode(stream)
    assert time.process_time() - began < 10 and pcm.tobytes() == raw and len(at) == -(-len(raw) // flac.BLOCK)
    damaged = bytearray(stream[0])
    damaged[len(damaged) // 2] ^= 4
    with pytest.raises(flac.BadStream):
        flac.decode([bytes(damaged)])
