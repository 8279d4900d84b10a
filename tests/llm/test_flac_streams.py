"""Hand-built FLAC streams against the decoder, and every digest column against plain Python."""

import hashlib
import math
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from stowage.llm import flac  # noqa: E402


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value & ((1 << n) - 1), f"0{n}b") if n else ""
        return self

    def bytes(self):
        self.text += "0" * (-len(self.text) % 8)
        return bytes(int(self.text[i : i + 8], 2) for i in range(0, len(self.text), 8))


def crc(data, poly, bits):
    out = 0
    for byte in data:
        out ^= byte << (bits - 8)
        for _ in range(8):
            out = ((out << 1) ^ poly if out >> (bits - 1) & 1 else out << 1) & ((1 << bits) - 1)
    return out


def residual(bits, values, order, parts, k, block):
    """Rice-coded residuals of one frame, in 2 ** parts partitions."""
    bits.put(0, 2).put(parts, 4)
    size = block >> parts
    for p in range(1 << parts):
        bits.put(k, 4)
        for i in range(max(p * size, order), (p + 1) * size):
            v = values[i - order]
            u = 2 * v if v >= 0 else -2 * v - 1
            bits.put(0, u >> k).put(1, 1).put(u, k)


def frame(number, x, kind, order, parts=0, coef=(), shift=0, precision=6):
    head = Bits().put(0xFFF8, 16).put(6, 4).put(0, 4).put(0, 4).put(1, 3).put(0, 1).put(number, 8).put(len(x) - 1, 8).bytes()
    head += bytes([crc(head, 0x07, 8)])
    bits = Bits().put(0, 1)
    if kind == "fixed":
        bits.put(8 | order, 6).put(0, 1)
        for v in x[:order]:
            bits.put(v, 8)
        diff = [sum((-1) ** j * math.comb(order, j) * x[i - j] for j in range(order + 1)) for i in range(order, len(x))]
        residual(bits, diff, order, parts, 2, len(x))
    elif kind == "lpc":
        bits.put(32 | (order - 1), 6).put(0, 1)
        for v in x[:order]:
            bits.put(v, 8)
        bits.put(precision - 1, 4).put(shift, 5)
        for c in coef:
            bits.put(c, precision)
        rest = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coef)) >> shift) for i in range(order, len(x))]
        residual(bits, rest, order, parts, 2, len(x))
    elif kind == "constant":
        bits.put(0, 6).put(0, 1).put(x[0], 8)
    else:
        bits.put(1, 6).put(0, 1)
        for v in x:
            bits.put(v, 8)
    body = head + bits.bytes()
    return body + crc(body, 0x8005, 16).to_bytes(2, "big")


def stream(x, block, frames, md5=True):
    digest = hashlib.md5(np.array(x, np.int8).tobytes()).digest() if md5 else bytes(16)
    info = Bits().put(block, 16).put(block, 16).put(0, 48).put(8000, 20).put(0, 3).put(7, 5).put(len(x), 36).bytes() + digest
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames)


def samples(n, seed=1):
    r = np.random.default_rng(seed)
    return np.clip(np.cumsum(r.integers(-4, 5, n)), -100, 100).tolist()


@pytest.mark.parametrize("order", range(5))
@pytest.mark.parametrize("parts", [0, 2])
def test_fixed_predictors(order, parts):
    x = samples(32 + 32 + 16, order)
    s = stream(x, 32, [frame(i, x[32 * i : 32 * i + 32], "fixed", order, parts) for i in range(3)])
    assert flac.decode_samples([s])[0].tolist() == x


@pytest.mark.parametrize(("coef", "shift"), [((1,), 0), ((2, -1), 0), ((7, -3), 2), ((9, -5, 2, 1), 3)])
@pytest.mark.parametrize("parts", [0, 1])
def test_linear_predictors(coef, shift, parts):
    x = samples(64, 7)
    s = stream(x, 32, [frame(i, x[32 * i : 32 * i + 32], "lpc", len(coef), parts, coef, shift) for i in range(2)])
    assert flac.decode_samples([s])[0].tolist() == x


def test_kinds_of_frames_together():
    x = [5] * 32 + samples(64, 3)
    frames = [frame(0, x[:32], "constant", 0), frame(1, x[32:64], "verbatim", 0), frame(2, x[64:], "fixed", 2, 1)]
    other = samples(32, 4)
    got = flac.decode_samples([stream(x, 32, frames), stream(other, 32, [frame(0, other, "lpc", 1, 0, (1,))], md5=False)])
    assert [g.tolist() for g in got] == [x, other]


def test_checksums_are_checked():
    x = samples(64)
    good = stream(x, 32, [frame(i, x[32 * i : 32 * i + 32], "fixed", 1) for i in range(2)])
    for at in (len(good) - 1, len(good) - 5, 42 + 6, 30):  # frame, residual, header, MD5
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode_samples([bytes(bad)])


def test_every_digest_column(spark):
    texts = ["some text " * 60, "some text " * 60, "é" * 192, "", None, "x" * 192]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = flac.to_media(docs)
    streams = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    got = {r["doc_id"]: r.asDict() for r in flac.digests(media).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        data, n = data.ljust(192 * max(1, -(-len(data) // 192))), len(data)
        y = [b - 128 for b in data]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(y, y[1:], strict=False))
        travel = sum(abs(b - a) for a, b in zip(y, y[1:], strict=False))
        assert got[i] == {
            "doc_id": i, "n_bytes": n, "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-16:]),
            "media_bytes": len(streams[i]), "media_sha256": hashlib.sha256(streams[i]).hexdigest(),
            "feature": f"n={len(y)};sum={sum(y)};energy={sum(v * v for v in y)};peak={max(map(abs, y))};crossings={crossings};travel={travel}",
        }
    assert {k: v for k, v in got[0].items() if k != "doc_id"} == {k: v for k, v in got[1].items() if k != "doc_id"}
