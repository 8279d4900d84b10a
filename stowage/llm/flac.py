"""Operator 6: FLAC media columns.

``encode`` stores byte payloads as mono FLAC streams of 8-bit samples (byte - 128) in blocks of
192; ``decode`` reads streams back: it checks the CRC-8 of each frame header and the CRC-16 of
each frame, decodes Rice residuals, undoes fixed and general linear predictors and checks the
MD5 of the samples. Both work on all frames of a batch at once: sample i of every frame is one
vector step.

Cases: null and empty texts store one block of spaces; payloads of any length are stored whole
(a batch is worked on in slices; one stream is at most one slice longer); equal texts give equal
streams; an empty table gives an empty table; further columns of the input are ignored, so their
names can't clash. A damaged stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, map_batches, slices

BLOCK, RATE = 192, 8000
#: Bytes of payload that one vectorised step works on (about 60 bytes of memory each).
STEP_BYTES = 1 << 20


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out.astype(np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_LEADING = np.array([16, *(16 - int(x).bit_length() for x in range(1, 1 << 16))], np.uint8)  # zeros before the first 1 of 16 bits


def crc8(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-8 of the first size[f] bytes of each row."""
    crc = np.zeros(len(rows), np.uint16)
    for i in range(int(size.max(initial=0))):
        crc = np.where(i < size, _CRC8[crc ^ rows[:, i]], crc)
    return crc


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:start + size] for each frame; frames in step, longest first."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    crc = np.zeros(len(order), np.uint16)
    live = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), "left")
    for i, n in enumerate(live):
        c = crc[:n]
        crc[:n] = (c << np.uint16(8)) ^ _CRC16[(c >> np.uint16(8)) ^ data[at[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: int) -> bytes:
    """The frame number in UTF-8's manner, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(0xFF ^ (2 * lead + 1)) | n, *reversed(tail)])


def payload(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of the block size."""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b" ")


def _predicted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fixed predictor of each frame (order 0 to 2): order, residuals, and warm-up mask."""
    res = [x, x.copy(), x.copy()]
    res[1][:, 1:] -= x[:, :-1]
    res[2][:, 2:] = res[1][:, 2:] - res[1][:, 1:-1]
    cost = np.stack([np.abs(r[:, k:]).sum(1) + 48 * k for k, r in enumerate(res)])
    order = cost.argmin(0)
    return order, np.choose(order[:, None], res), np.arange(BLOCK)[None, :] < order[:, None]


def _frames(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All frames of some payloads: their bytes, start and size of each, frames of each payload."""
    x = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    frames = len(x)
    per = np.array([len(p) // BLOCK for p in payloads])
    number = np.arange(frames) - np.repeat(np.cumsum(per) - per, per)
    order, res, warm = _predicted(x)
    u = np.where(res < 0, -2 * res - 1, 2 * res).astype(np.uint16)
    u[warm] = 0
    left = BLOCK - order
    mean = np.maximum(u.sum(1) / left, 1e-9)
    k = np.clip(np.floor(np.log2(mean * 0.7 + 1e-9)), 0, 7).astype(np.int64)
    q = (u >> k[:, None].astype(np.uint16)).astype(np.int64)
    size = np.where(warm, 0, q + 1 + k[:, None])
    bits = 8 + 8 * order + 10 + size.sum(1)
    plain = (bits > 8 + 8 * BLOCK) | (q.max(1) > 15)
    bits[plain] = 8 + 8 * BLOCK
    constant = (x == x[:, :1]).all(1)
    bits[constant], plain[constant] = 16, False
    rice = ~(plain | constant)

    heads = np.zeros((frames, 12), np.uint8)
    codes = [coded_number(int(n)) for n in range(int(number.max()) + 1)]
    width = np.array([len(c) for c in codes])
    table = np.zeros((len(codes), 7), np.uint8)
    for n, c in enumerate(codes):
        table[n, : len(c)] = list(c)
    heads[:, :4] = [0xFF, 0xF8, 1 << 4 | 4, 1 << 1]  # fixed block size of 192, 8 kHz, mono, 8 bits
    heads[:, 4:11] = table[number]
    head = 4 + width[number]
    heads[np.arange(frames), head] = crc8(heads, head)
    head = head + 1

    body = -(-bits // 8)
    whole = head + body + 2
    start = np.cumsum(whole) - whole
    out = np.zeros(int(whole.sum()), np.uint8)
    # Rice codes: a 1 after q zeros, then k low bits; the rest of a code is 0 already.
    at = (start + head)[:, None] * 8 + 18 + 8 * order[:, None] + np.cumsum(size, 1) - size
    stop = (at + q)[rice][~warm[rice]]
    low, wide = u[rice][~warm[rice]], np.repeat(k[rice], left[rice])
    stream = np.zeros(len(out) * 8, bool)
    stream[stop] = True
    for j in range(1, 8):
        if not (has := wide >= j).any():
            break
        stream[stop[has] + j] = (low[has] >> (wide[has] - j).astype(np.uint16)) & 1
    out |= np.packbits(stream)
    for f in range(int(head.max())):
        has = f < head
        out[start[has] + f] = heads[has, f]
    kind = np.where(rice, 8 | order, np.where(plain, 1, 0)) << 1
    out[start + head] = kind
    for j in range(2):
        has = rice & (order > j)
        out[start[has] + head[has] + 1 + j] = x[has, j].astype(np.uint8)
    # 2 bits of coding method and 4 of partition order are 0, then 4 bits of k.
    p = start[rice] + head[rice] + 1 + order[rice]
    out[p] |= (k[rice] >> 2).astype(np.uint8)
    out[p + 1] |= ((k[rice] & 3) << 6).astype(np.uint8)
    if plain.any():
        at = (start + head + 1)[plain][:, None] + np.arange(BLOCK)
        out[at] = x[plain].astype(np.uint8)
    if constant.any():
        out[(start + head + 1)[constant]] = x[constant, 0].astype(np.uint8)
    check = crc16(out, start, whole - 2)
    out[start + whole - 2], out[start + whole - 1] = check >> 8, check & 255
    return out, start, whole, per


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, with a seek point for each frame."""
    data, start, size, per = _frames(payloads)
    out, f = [], 0
    for p, n in zip(payloads, per, strict=True):
        begin, sizes = int(start[f]), size[f : f + n]
        end = begin + int(sizes.sum())
        samples = np.frombuffer(p, np.uint8) ^ np.uint8(128)  # byte - 128 as a signed byte
        info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(samples.tobytes()).digest()
        points = np.zeros((n, 18), np.uint8)
        points[:, 0:8] = (np.arange(n, dtype=">u8") * BLOCK).astype(">u8").view(np.uint8).reshape(n, 8)
        points[:, 8:16] = (start[f : f + n] - begin).astype(">u8").view(np.uint8).reshape(n, 8)
        points[:, 16:18] = [BLOCK >> 8, BLOCK & 255]
        # A metadata block has a 24-bit size; longer tables of seek points keep every n-th.
        points = points[:: -(-n * 18 // 0xFFFF00)]
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + points.size.to_bytes(3, "big") + points.tobytes() + data[begin:end].tobytes())
        f += n
    return out


class Stream:
    """Metadata of a FLAC stream: block size, sample count, MD5 and (sample, byte) of each seek point."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, np.zeros((0, 2), np.int64)
        while not last:
            kind, n = data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            last, body = bool(data[at] & 128), data[at + 4 : at + 4 + n]
            if kind == 0:
                self.block = int.from_bytes(body[0:2], "big")
                if self.block != int.from_bytes(body[2:4], "big"):
                    raise ValueError("variable block sizes aren't supported")
                rest = int.from_bytes(body[10:18], "big")
                self.bits, self.channels, self.samples = (rest >> 36 & 31) + 1, (rest >> 41 & 7) + 1, rest & (1 << 36) - 1
                self.md5 = body[18:34]
                if self.channels != 1 or self.bits != 8:
                    raise ValueError("only mono streams of 8 bits are supported")
            elif kind == 3:
                raw = np.frombuffer(body, np.uint8).reshape(-1, 18)
                self.points = np.stack([np.ascontiguousarray(raw[:, a : a + 8]).view(">u8")[:, 0].astype(np.int64) for a in (0, 8)], 1)
            at += 4 + n
        self.audio = at
        self.frames = -(-self.samples // self.block)


def _explicit(code: np.ndarray) -> np.ndarray:
    """Bytes of a block size and a sample rate that follow the frame number, by the third byte of the header."""
    size, rate = code >> 4, code & 15
    return np.where(size == 6, 1, np.where(size == 7, 2, 0)) + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))


def _frame_starts(data: bytes, info: Stream) -> np.ndarray:
    """Byte of each frame: from the seek points if they are complete, else by headers that check and count on."""
    if len(info.points) == info.frames and (info.points[:, 0] == np.arange(info.frames) * info.block).all():
        return info.audio + info.points[:, 1]
    out, at = [], info.audio
    for n in range(info.frames):
        code = coded_number(n)
        while True:
            at = data.find(b"\xff\xf8", at)
            if at < 0:
                raise ValueError("a frame is missing")
            m = 4 + len(code) + int(_explicit(np.uint8(data[at + 2] if at + 2 < len(data) else 0)))
            if data[at + 4 : at + 4 + len(code)] == code and at + m < len(data) and crc8(np.frombuffer(data, np.uint8, m, at)[None, :], np.array([m]))[0] == data[at + m]:
                break
            at += 1
        out.append(at)
        at += m + 1
    return np.array(out, np.int64)


def decode_samples(streams: list[bytes]) -> list[np.ndarray]:
    """Signed 8-bit samples of each stream. Frames of one block size are decoded in step."""
    infos = [Stream(s) for s in streams]
    if len({i.block for i in infos}) > 1:
        return [decode_samples([s])[0] for s in streams]
    block = infos[0].block
    base = np.cumsum([0] + [len(s) for s in streams])[:-1]
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    starts = [_frame_starts(s, i) for s, i in zip(streams, infos, strict=True)]
    per = np.array([len(s) for s in starts])
    start = np.concatenate([s + b for s, b in zip(starts, base, strict=True)])
    stop = np.concatenate([np.append(s[1:], len(d)) + b for s, d, b in zip(starts, streams, base, strict=True)])
    number = np.concatenate([np.arange(n) for n in per])
    length = np.minimum(block, np.repeat([i.samples for i in infos], per) - number * block)

    lead = data[start + 4]
    width = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    head = 4 + width + _explicit(data[start + 2])
    rows = data[start[:, None] + np.arange(16)]
    if ((rows[:, 0] != 0xFF) | (rows[:, 1] != 0xF8) | (crc8(rows, head) != rows[np.arange(len(rows)), head])).any():
        raise ValueError("a frame header's checksum is wrong")
    value = np.where(width == 1, lead, lead & (0xFF >> (width + 1))).astype(np.int64)
    for j in range(1, int(width.max())):
        value = np.where(j < width, value << 6 | (rows[np.arange(len(rows)), 4 + j] & 63), value)
    if (value != number).any():
        raise ValueError("frames are out of order")
    check = crc16(data, start, stop - start - 2)
    if ((data[stop - 2].astype(np.int64) << 8 | data[stop - 1]) != check).any():
        raise ValueError("a frame's checksum is wrong")

    sub = start + head + 1
    kind = data[sub] >> 1 & 63
    if (data[sub] & 1).any():
        raise ValueError("wasted bits aren't supported")
    at = (sub + 1) * 8
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind <= 1)).all():
        raise ValueError("a reserved predictor")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0)).astype(np.int64)
    x = np.zeros((len(start), block), np.int64)
    signed = data.view(np.int8)
    for f in np.flatnonzero(kind == 0):
        x[f, : length[f]] = signed[sub[f] + 1]
    whole = np.flatnonzero((kind == 1) & (length == block))
    x[whole] = signed[(sub[whole] + 1)[:, None] + np.arange(block)]
    for f in np.flatnonzero((kind == 1) & (length < block)):
        x[f, : length[f]] = signed[sub[f] + 1 : sub[f] + 1 + length[f]]
    for j in range(int(order.max(initial=0))):
        has = order > j
        x[has, j] = signed[sub[has] + 1 + j]
    at += 8 * order

    window = np.zeros(len(data) - 4, np.uint32)  # 32 bits from each byte on
    for j in range(4):
        window |= data[j : j + len(window)].astype(np.uint32) << np.uint32(24 - 8 * j)

    def take(who: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        w = window[at[who] >> 3] << (at[who] & 7).astype(np.uint32)
        at[who] += n
        return w >> (32 - np.broadcast_to(np.asarray(n, np.int64), w.shape)).astype(np.uint32)

    quant: dict[int, tuple[int, np.ndarray]] = {}
    for f in np.flatnonzero(lpc):
        who = np.array([f])
        precision, shift = int(take(who, 4)[0]) + 1, int(take(who, 5)[0])
        coef = [int(take(who, precision)[0]) for _ in range(order[f])]
        quant[int(f)] = (shift, np.array([c - (1 << precision) if c >> (precision - 1) else c for c in coef], np.int64))
    rice = np.flatnonzero(fixed | lpc)
    if len(rice):
        method, parts = take(rice, 2).astype(np.int64), 1 << take(rice, 4).astype(np.int64)
        if (method > 1).any():
            raise ValueError("a reserved residual coding")
        each = np.maximum(length[rice] // parts, 1)
        k = np.zeros(len(rice), np.int64)
        for i in range(block):
            begin = (i % each == 0) | (i == 0)
            ready = (order[rice] <= i) & (i < length[rice])
            new = begin & (i < length[rice])
            if new.any():
                k[new] = take(rice[new], 4 + method[new])
                if (k[new] == 15 + 16 * method[new]).any():
                    raise ValueError("escaped residuals aren't supported")
            if ready.all():
                who, kk = rice, k
            elif ready.any():
                who, kk = rice[ready], k[ready]
            else:
                continue
            p = at[who]
            w = window[p >> 3] << (p & 7).astype(np.uint32)
            zeros = _LEADING[w >> np.uint32(16)].astype(np.int64)
            if (long := zeros == 16).any():  # a run of zeros beyond the window: go on until its 1
                zeros[long] = 0
                while long.any():
                    some = np.flatnonzero(long)
                    q = p[some] + zeros[some]
                    z = _LEADING[(window[q >> 3] << (q & 7).astype(np.uint32)) >> np.uint32(16)]
                    zeros[some] += z
                    long[some] = z == 16
            p = p + zeros + 1
            w = window[p >> 3] << (p & 7).astype(np.uint32)
            low = np.where(kk > 0, w >> (32 - np.maximum(kk, 1)).astype(np.uint32), 0)
            u = zeros << kk | low
            x[who, i] = (u >> 1) ^ -(u & 1)
            at[who] = p + kk
        for n in range(1, 5):
            if len(who := rice[fixed[rice] & (order[rice] == n)]):
                y = x[who]
                warm = [np.diff(y[:, :n], n=d, axis=1)[:, :1] for d in range(n)]
                y = y[:, n:]
                for d in range(n - 1, -1, -1):  # from the d+1-th difference to the d-th
                    last = sum((-1) ** (j) * _choose(d, j) * x[who, n - 1 - j] for j in range(d + 1))
                    y = np.cumsum(y, 1) + np.asarray(last)[:, None]
                x[who, n:] = y
        for f, (shift, coef) in quant.items():
            for i in range(len(coef), int(length[f])):
                x[f, i] += int((coef * x[f, i - len(coef) : i][::-1]).sum()) >> shift
    out, f = [], 0
    for info, n in zip(infos, per, strict=True):
        y = x[f : f + n].reshape(-1)[: info.samples].astype(np.int8)
        if any(info.md5) and hashlib.md5(y.tobytes()).digest() != info.md5:
            raise ValueError("the samples' checksum is wrong")
        out.append(y)
        f += n
    return out


def _choose(n: int, k: int) -> int:
    import math

    return math.comb(n, k)


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads that ``encode`` stored."""
    return [(y.view(np.uint8) ^ np.uint8(128)).tobytes() for y in decode_samples(streams)]


def feature(y: np.ndarray) -> str:
    """Sum, energy, peak, sign changes and mean step of signed samples, as whole numbers."""
    z = y.astype(np.int64)
    return f"n={len(z)};sum={z.sum()};energy={(z * z).sum()};peak={np.abs(z).max(initial=0)};crossings={int(((z[1:] < 0) != (z[:-1] < 0)).sum())};travel={np.abs(np.diff(z)).sum()}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the FLAC stream of each text's payload (column media)."""

    def step(batch: pa.RecordBatch):
        texts = encoded(batch.column(1))
        for a, b in slices([max(BLOCK, len(t)) for t in texts], STEP_BYTES):
            media = encode([payload(t) for t in texts[a:b]])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), step, f"`{id_col}` long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", samples: int = 48 * BLOCK) -> DataFrame:
    """PCM blocks of each stream: id, block, sample_offset and pcm (signed 8-bit), ``samples`` to a block."""

    def step(batch: pa.RecordBatch):
        ids, streams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices([len(s or b"") for s in streams], STEP_BYTES):
            keep = [i for i in range(a, b) if streams[i] is not None]
            rows = [(ids[i], at // samples, at, y[at : at + samples].tobytes()) for i, y in zip(keep, decode_samples([streams[i] for i in keep]), strict=True) for at in range(0, len(y), samples)] if keep else []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=[id_col, "block", "sample_offset", "pcm"])

    return map_batches(media.select(F.col(id_col).cast("long"), "media"), step, f"`{id_col}` long, block long, sample_offset long, pcm binary")


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read each stream back and digest it: payload and stream sizes and hashes, CRC-32 of the last 16 bytes, feature."""

    def step(batch: pa.RecordBatch):
        streams = batch.column(2).to_pylist()
        for a, b in slices([len(s) for s in streams], STEP_BYTES):
            rows = []
            for s, y in zip(streams[a:b], decode_samples(streams[a:b]), strict=True):
                p = (y.view(np.uint8) ^ np.uint8(128)).tobytes()
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(s), hashlib.sha256(s).hexdigest(), feature(y)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(media.select(F.col(id_col).cast("long"), "n_bytes", "media"), step, f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
