"""FLAC media columns: 8-bit mono streams with Rice-coded residuals of linear predictors.

Frames are coded and decoded side by side: each step handles one sample (or one bit field) of all
frames of a batch. The seek table has a point for each frame, or for each second, fourth and so on where that would
pass the format's limit on its size: frames at points are decoded side by side, those between them after
the one before. Streams without such a table are decoded frame after frame.

Text as sound is nearly noise: its common bytes lie far apart. So bytes become samples by a fixed law (as in telephony's
companding), a permutation of the 256 values that gives the bytes common in Latin text small amplitudes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm._shared import map_batches, materialize, pa_schema, read_table, utf8, with_default_columns

BLOCK, RATE = 576, 8000
#: Fixed predictors by order: the weights of the samples before.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
LPC_ORDER, PRECISION = 4, 12
#: Frames handled at once; frames of a row of PCM; bytes that a seek table stays below.
BATCH, PCM_FRAMES, TABLE_BYTES = 2048, 64, 1 << 24
POINT = [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]
#: Bytes from common to rare; those not named follow in ascending order.
COMMON = b" etaoinsrhldcumfpgwybv,.k-xjqz\n\xc3ETAOINSRHLDCUMFPGWYBVKXJQZ0123456789'\"()"


def _law() -> bytes:
    """The sample byte (value + 128) of each byte: by rank the values 0, -1, 1, -2, 2, ..."""
    order = [*COMMON, *(b for b in range(256) if b not in COMMON)]
    table = bytearray(256)
    for rank, b in enumerate(order):
        table[b] = 128 + (rank // 2 if rank % 2 == 0 else -(rank + 1) // 2)
    return bytes(table)


LAW = _law()
UNLAW = bytes(LAW.index(b) for b in range(256))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, (table << 1) ^ poly, table << 1) & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The checksums of data[start : start + size], all at once."""
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    value, live = np.zeros(len(s), np.uint32), np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    for j, k in enumerate(live):
        value[:k] = table[(value[:k] >> (bits - 8)) ^ data[s[:k] + j]] ^ (value[:k] << 8) & ((1 << bits) - 1)
    out = np.empty_like(value)
    out[order] = value
    return out


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = value >> (width - 1 - b) & 1


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of residuals to zigzag values, best parameters and their bits."""
    zig = (residual << 1) ^ (residual >> 31)
    guess = np.clip(np.floor(np.log2(np.maximum(zig.mean(axis=1), 1))).astype(np.int32), 0, 13)
    cost = [(zig >> k[:, None]).sum(axis=1) + zig.shape[1] * (k + 1) for k in (guess, np.maximum(guess - 1, 0))]
    better = cost[1] < cost[0]
    return zig, np.where(better, np.maximum(guess - 1, 0), guess), np.where(better, cost[1], cost[0])


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised weights (frames x LPC_ORDER) by Levinson-Durbin, and shifts."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, k:] * f[:, : f.shape[1] - k]).sum(axis=1) for k in range(LPC_ORDER + 1)])
    r[0] = r[0] * (1 + 1e-9) + 1e-9
    a, err = np.zeros((LPC_ORDER, len(x))), r[0].copy()
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum((a[j] * r[i - j] for j in range(i)), np.zeros(len(x)))) / err
        a[:i] = a[:i] - k * a[:i][::-1]
        a[i] = k
        err = np.maximum(err * (1 - k * k), 1e-12)
    largest = np.maximum(np.abs(a).max(axis=0), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(largest)).astype(np.int64), 0, 14)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * 2.0**shift), -top - 1, top).astype(np.int32).T, shift.astype(np.int32)


def _residuals(x: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = weights.shape[1]
    predicted = sum((weights[:, j, None] * x[:, order - 1 - j : x.shape[1] - 1 - j] for j in range(order)), np.zeros((len(x), x.shape[1] - order), np.int32))
    return x[:, order:] - (predicted >> shift[:, None])


def encode_frames(x: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Frames of BLOCK samples (int32, 8 bits) with their numbers in the stream."""
    n, none = len(x), np.zeros(len(x), np.int32)
    weights, shift = _lpc(x)
    plans = [(o, 8 + o, np.tile(np.array(FIXED[o], np.int32), (n, 1)), none) for o in range(3)] + [(LPC_ORDER, 32 + LPC_ORDER - 1, weights, shift)]
    kind, cost, coded = np.full(n, 1), np.full(n, 8 * BLOCK), {}
    for order, code, w, s in plans:
        zig, k, bits = _rice(_residuals(x, w, s))
        bits = bits + 8 * order + 10 + (9 + PRECISION * order if code >= 32 else 0)
        coded[code] = (order, zig, k)
        kind, cost = np.where(bits < cost, code, kind), np.minimum(bits, cost)
    constant = (x == x[:, :1]).all(axis=1)
    kind, cost = np.where(constant, 0, kind), np.where(constant, 8, cost)
    wide = np.select([number < 0x80, number < 0x800, number < 0x10000, number < 0x200000], [1, 2, 3, 4], 5)
    size = 4 + wide + 2 + (cost + 7) // 8 + 2
    start = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, np.uint8)
    at = start * 8
    _put(bits, at, np.full(n, 0xFFF82402), 32)  # sync, fixed blocks of 576, 8 kHz, mono, 8 bits
    for w in range(1, 6):
        rows = np.flatnonzero(wide == w)
        v, p = number[rows], at[rows] + 32
        lead = v if w == 1 else (0xFF00 >> w & 0xFF) | v >> (6 * (w - 1))
        _put(bits, p, lead, 8)
        for i in range(1, w):
            _put(bits, p + 8 * i, 0x80 | v >> (6 * (w - 1 - i)) & 0x3F, 8)
    at = at + 8 * (4 + wide + 1)
    _put(bits, at, kind << 1, 8)
    at = at + 8
    low = x & 0xFF
    rows = np.flatnonzero(kind == 0)
    _put(bits, at[rows], low[rows, 0], 8)
    rows = np.flatnonzero(kind == 1)
    _put(bits, at[rows, None] + 8 * np.arange(BLOCK), low[rows], 8)
    for code, (order, zig, k) in coded.items():
        rows = np.flatnonzero(kind == code)
        if not len(rows):
            continue
        p = at[rows]
        _put(bits, p[:, None] + 8 * np.arange(order), low[rows, :order], 8)
        p = p + 8 * order
        if code >= 32:
            _put(bits, p, np.full(len(rows), PRECISION - 1), 4)
            _put(bits, p + 4, shift[rows], 5)
            _put(bits, p[:, None] + 9 + PRECISION * np.arange(order), weights[rows] & ((1 << PRECISION) - 1), PRECISION)
            p = p + 9 + PRECISION * order
        _put(bits, p + 6, k[rows], 4)  # method 0, one partition
        z, kk = zig[rows], k[rows, None]
        length = (z >> kk) + 1 + kk
        p = (p + 10)[:, None] + np.cumsum(length, axis=1) - length
        p = p + (z >> kk)
        bits[p] = 1
        for b in range(int(kk.max())):  # the low bits, last one first
            has = np.broadcast_to(b < kk, z.shape)
            bits[(p + kk - b)[has]] = (z >> b & 1)[has]
    data = np.packbits(bits)
    data[start + 4 + wide] = crc(data, start, 4 + wide, CRC8, 8)
    total = crc(data, start, size - 2, CRC16, 16)
    data[start + size - 2], data[start + size - 1] = total >> 8, total & 0xFF
    whole = data.tobytes()
    return [whole[s : s + z] for s, z in zip(start.tolist(), size.tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of BLOCK bytes, sample = byte - 128) as a FLAC stream."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError(f"a payload is a positive multiple of {BLOCK} bytes")
    x = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128).reshape(-1, BLOCK)
    number = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
    frames = [f for i in range(0, len(x), BATCH) for f in encode_frames(x[i : i + BATCH], number[i : i + BATCH])]
    out, first = [], 0
    for payload, n in zip(payloads, counts.tolist(), strict=True):
        own = frames[first : first + n]
        first += n
        sizes = [len(f) for f in own]
        packed = RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK  # 1 channel, 8 bits
        pcm = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(pcm, usedforsecurity=False).digest()
        step = 1
        while 18 * -(-n // step) >= TABLE_BYTES:
            step *= 2
        seek = np.zeros(-(-n // step), dtype=POINT)
        seek["sample"], seek["offset"], seek["n"] = np.arange(0, n, step) * BLOCK, np.cumsum([0, *sizes[:-1]])[::step], BLOCK
        head = b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + seek.nbytes.to_bytes(3, "big") + seek.tobytes()
        out.append(head + b"".join(own))
    return out


def _metadata(stream: bytes) -> tuple[int, int, bytes, np.ndarray, np.ndarray]:
    """Place of the first frame, samples, MD5, and the seek points' samples and offsets (the start alone without a usable table)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    p, last, total, digest, points = 4, False, 0, b"", np.zeros(1, POINT)
    while not last:
        last, kind, size = stream[p] >> 7, stream[p] & 127, int.from_bytes(stream[p + 1 : p + 4], "big")
        body = stream[p + 4 : p + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            total, digest = packed & (1 << 36) - 1, body[18:34]
            if packed >> 36 & 31 != 7 or packed >> 41 & 7:
                raise ValueError("only mono streams of 8 bits are read")
        elif kind == 3:
            seek = np.frombuffer(body, dtype=POINT)
            seek = seek[seek["sample"] < np.uint64((1 << 64) - 1)]  # places kept free
            if len(seek) and seek["sample"][0] == 0 and (np.diff(seek["sample"].astype(np.int64)) > 0).all():
                points = seek
        p += 4 + size
    return p, total, digest, points["sample"].astype(np.int64), points["offset"].astype(np.int64)


def decode_frames(data: np.ndarray, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The samples of the frames that begin at the given bytes, and where each ends. Both checksums are verified."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    if ((data[start] != 0xFF) | (data[start + 1] & 0xFE != 0xF8) | (data[start + 3] >> 4 != 0)).any():
        raise ValueError("a frame has no sync code, or more than one channel")
    lead = data[start + 4]
    wide = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    p = start + 4 + wide
    code, two = data[start + 2] >> 4, data[p].astype(np.int64) << 8 | data[p + 1]
    size = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7], [192, 576 << np.clip(code.astype(np.int64) - 2, 0, 3), (two >> 8) + 1, two + 1], 256 << np.clip(code.astype(np.int64) - 8, 0, 7))
    p = p + np.select([code == 6, code == 7], [1, 2], 0)
    rate = data[start + 2] & 15
    p = p + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    if (crc(data, start, p - start, CRC8, 8) != data[p]).any():
        raise ValueError("a frame header's checksum is wrong")
    bits = np.unpackbits(data)
    places = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    one = np.minimum.accumulate(places[::-1])[::-1]
    d = np.concatenate([data, np.zeros(5, np.uint8)]).astype(np.uint64)
    word = sum(d[i : len(data) + i] << np.uint64(8 * (4 - i)) for i in range(5))

    def get(at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return (word[at >> 3] >> (40 - (at & 7) - width).astype(np.uint64)).astype(np.int64) & ((1 << np.asarray(width, np.int64)) - 1)

    def signed(v: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return v - ((v >> np.maximum(np.asarray(width) - 1, 0) & 1) << np.asarray(width, np.int64))

    kind = data[p + 1] >> 1
    if (data[p + 1] & 0x81).any() or (((kind > 1) & (kind < 8)) | ((kind > 12) & (kind < 32))).any():
        raise ValueError("a subframe has wasted bits or a reserved kind")
    at = (p.astype(np.int64) + 2) * 8
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0)).astype(np.int64)
    top, n = int(size.max()), len(start)
    x = np.zeros((top, n), np.int64)
    rows = np.flatnonzero(kind == 0)
    x[:, rows] = signed(get(at[rows], 8), 8)
    at[rows] += 8
    for i in range(top if (kind == 1).any() else 0):
        rows = np.flatnonzero((kind == 1) & (i < size))
        x[i, rows] = signed(get(at[rows], 8), 8)
        at[rows] += 8
    weights, shift = np.zeros((32, n), np.int64), np.zeros(n, np.int64)
    for i in range(int(order.max())):
        rows = np.flatnonzero(i < order)
        x[i, rows] = signed(get(at[rows], 8), 8)
        at[rows] += 8
    for o, w in enumerate(FIXED):
        weights[: len(w), kind == 8 + o] = np.array(w, np.int64)[:, None]
    rows = np.flatnonzero(kind >= 32)
    precision = get(at[rows], 4) + 1
    shift[rows] = signed(get(at[rows] + 4, 5), 5)
    at[rows] += 9
    for i in range(int(order[rows].max(initial=0))):
        r, q = rows[i < order[rows]], precision[i < order[rows]]
        weights[i, r] = signed(get(at[r], q), q)
        at[r] += q
    rows = np.flatnonzero(kind >= 8)
    _read_residuals(rows, at, order, size, x, one, get, signed)
    top_order = int(order.max())
    for i in range(1, top if top_order else 0):
        part = [weights[j] * x[i - 1 - j] for j in range(min(i, top_order))]
        x[i] += np.where((i >= order) & (i < size), sum(part) >> shift, 0)
    end = (at + 7) // 8
    if (crc(data, start, end - start, CRC16, 16) != (data[end].astype(np.uint32) << 8 | data[end + 1])).any():
        raise ValueError("a frame's checksum is wrong")
    return [x[: size[i], i] for i in range(n)], end + 2


def _read_residuals(rows, at, order, size, x, one, get, signed) -> None:
    """Rice codes of the frames ``rows`` into x; ``at`` moves on. Partition parameters may be escapes."""
    if not len(rows):
        return
    method, parts = get(at[rows], 2), get(at[rows] + 2, 4)
    if (method > 1).any():
        raise ValueError("a residual has a reserved coding")
    width = 4 + method
    pos, o, n = at[rows] + 6, order[rows], size[rows]
    k, raw, following = np.zeros(len(rows), np.int64), np.full(len(rows), -1), o.copy()
    for i in range(int(o.min()), int(n.max())):
        begin = np.flatnonzero((i == following) & (i < n))
        if len(begin):
            k[begin] = get(pos[begin], width[begin])
            pos[begin] += width[begin]
            escape = begin[k[begin] == (1 << width[begin]) - 1]
            raw[begin] = -1
            raw[escape] = get(pos[escape], 5)
            pos[escape] += 5
            step = n[begin] >> parts[begin]
            following[begin] = (i // step + 1) * step
        live = slice(None) if (o <= i).all() and (i < n).all() and (raw < 0).all() else np.flatnonzero((o <= i) & (i < n) & (raw < 0))
        p, kk = pos[live], k[live]
        stop = one[p].astype(np.int64)
        v = (stop - p) << kk | get(stop + 1, kk)
        x[i, rows[live]] = (v >> 1) ^ -(v & 1)
        pos[live] = stop + 1 + kk
        plain = np.flatnonzero((o <= i) & (i < n) & (raw >= 0)) if (raw >= 0).any() else []
        if len(plain):
            x[i, rows[plain]] = signed(get(pos[plain], raw[plain]), raw[plain])
            pos[plain] += raw[plain]
    at[rows] = pos


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream (int64, -128..127); MD5, frame and header checksums are verified."""
    out: list = [{} for _ in streams]
    queue, meta = [], [_metadata(s) for s in streams]
    for i, (p, total, _, samples, offsets) in enumerate(meta):
        limits, places = [*samples[1:].tolist(), total], (offsets + p).tolist()
        queue += [(i, b, stop, s, e) for b, stop, s, e in zip(places, [*places[1:], len(streams[i])], samples.tolist(), limits, strict=True) if s < e]
    while queue:  # the next frame of each point that has not reached the one after it
        further = []
        for q in range(0, len(queue), BATCH):
            some = queue[q : q + BATCH]
            # the last frame before a point ends there; others are of unknown size: read on if one did not fit
            cuts = [stop if e - s <= BLOCK else min(b + 4 * BLOCK, stop) for _, b, stop, s, e in some]
            while True:
                parts = [streams[i][b:cut] for (i, b, *_), cut in zip(some, cuts, strict=True)]
                sizes = np.array([len(x) for x in parts])
                starts = np.cumsum(sizes) - sizes
                try:
                    frames, ends = decode_frames(np.frombuffer(b"".join(parts), np.uint8), starts)
                except (ValueError, IndexError):
                    if all(cut == stop for (_, _, stop, _, _), cut in zip(some, cuts, strict=True)):
                        raise
                    cuts = [min(b + 16 * (cut - b), stop) for (_, b, stop, _, _), cut in zip(some, cuts, strict=True)]
                    continue
                break
            for (i, b, stop, s, e), x, end, start in zip(some, frames, ends.tolist(), starts.tolist(), strict=True):
                out[i][s] = x
                if s + len(x) < e:
                    further.append((i, b + end - start, stop, s + len(x), e))
        queue = further
    whole = []
    for parts, (_, total, digest, _, _) in zip(out, meta, strict=True):
        x = np.concatenate([parts[s] for s in sorted(parts)])[:total] if parts else np.zeros(0, np.int64)
        if len(x) < total or any(digest) and hashlib.md5(x.astype(np.int8).tobytes(), usedforsecurity=False).digest() != digest:
            raise ValueError("a stream's samples do not match its length and MD5")
        whole.append(x)
    return whole


def to_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, media): the text's UTF-8, padded with bytes 255, by LAW as FLAC.

    A null text is empty; rows with a null doc_id and repeated rows stay; an empty table gives none; other columns are ignored.
    """

    def make():
        def step(c: dict) -> dict:
            texts, media = utf8(c["text"]), []
            for s in range(0, len(texts), 500):
                media += encode([(t + b"\xff" * ((-len(t)) % BLOCK or (0 if t else BLOCK))).translate(LAW) for t in texts[s : s + 500]])
            return {"doc_id": c["doc_id"], "n_bytes": [len(t) for t in texts], "media": media}

        return step

    return map_batches(with_default_columns(docs, doc_id="bigint", text="string"), make, "doc_id bigint, n_bytes bigint, media binary")


def pcm_blocks(media: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, media, keep) -> (doc_id, keep, sample, pcm): the payload that the decoded samples stand for, in blocks of PCM_FRAMES frames.

    ``sample`` is the offset of a block's first sample, so a reader seeks by it. A stream's blocks follow one another.
    """
    kept = ["doc_id", *keep]

    def make():
        def step(c: dict) -> dict:
            at, samples, pcm, media = [], [], [], c["media"].to_pylist()
            for s in range(0, len(media), 500):
                for i, x in enumerate(decode(media[s : s + 500]), s):
                    data = (x + 128).astype(np.uint8).tobytes().translate(UNLAW)
                    for b in range(0, len(data), BLOCK * PCM_FRAMES):
                        at.append(i), samples.append(b), pcm.append(data[b : b + BLOCK * PCM_FRAMES])
            return {n: c[n].take(pa.array(at, pa.int64())) for n in kept} | {"sample": samples, "pcm": pcm}

        return step

    fields = [f"`{n}` {media.schema[n].dataType.simpleString()}" for n in kept]
    return map_batches(media.select(*kept, "media"), make, ", ".join([*fields, "sample bigint", "pcm binary"]))


class Features:
    """Payload digests and peak, mean size, zero crossings and energy of the samples, block by block."""

    def __init__(self) -> None:
        self.sha, self.n, self.tail, self.last = hashlib.sha256(), 0, b"", None
        self.peak = self.size = self.crossings = self.energy = 0

    def add(self, pcm: bytes) -> None:
        self.sha.update(pcm)
        self.n, self.tail = self.n + len(pcm), (self.tail + pcm[-32:])[-32:]
        x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
        size, below = np.abs(x), x < 0
        self.peak, self.size, self.energy = max(self.peak, int(size.max())), self.size + int(size.sum()), self.energy + int((x * x).sum())
        self.crossings += int((below[1:] != below[:-1]).sum()) + (self.last is not None and self.last != bool(below[0]))
        self.last = bool(below[-1])

    def text(self) -> str:
        return f"peak={self.peak};mean={self.size // self.n};crossings={self.crossings};energy={self.energy}"


def digests(docs: DataFrame) -> DataFrame:
    """op8's columns: the texts as FLAC are written to the shared folder and read back, and PCM blocks of what was read are digested.

    One row for each row, repeated ones and those with a null doc_id too; a null text counts as empty; an empty table gives none.
    """
    stored = materialize(to_media(docs), "flac")
    stored = stored.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    target = pa_schema(docs.sparkSession, schema)

    def fold(batches):
        """Blocks of a stream follow one another, the first at sample 0; a batch may end within a stream."""
        held, now = [], None

        def rows() -> pa.RecordBatch:
            out = [(d, n, f.n, f.sha.hexdigest(), zlib.crc32(f.tail), m, h, f.text()) for (d, n, m, h), f in held]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out, strict=True), target, strict=True)], schema=target)

        for batch in batches:
            names = [batch.column(i).to_pylist() for i in range(6)]
            for d, n, m, h, sample, pcm in zip(*names, strict=True):
                if sample == 0:
                    if now:
                        held.append(now)
                    now = ((d, n, m, h), Features())
                now[1].add(pcm)
            if len(held) >= 1000:
                yield rows()
        if now:
            held.append(now)
            yield rows()

    return pcm_blocks(stored, "n_bytes", "media_bytes", "media_sha256").mapInArrow(fold, schema)


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
