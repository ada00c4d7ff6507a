import hashlib
import zlib

import numpy as np
import pytest

from rillwork.llm import flac


def padded(t):
    return t + b"\xff" * ((-len(t)) % 576 or (0 if t else 576))


PAYLOADS = [padded(x) for x in (b"", b"hello world " * 99, bytes(range(256)) * 9, np.random.default_rng(1).integers(0, 256, 3000, dtype=np.uint8).tobytes(), b"\x80" * 576, (128 + 90 * np.sin(np.arange(5760) / 9)).astype(np.uint8).tobytes(), b"ab" * 12000)]


def without_seek_table(stream):
    first, *_ = flac._metadata(stream)
    return stream[:4] + b"\x80" + stream[5:42] + stream[first:]


@pytest.mark.parametrize(("batch", "table"), [(2048, 1 << 24), (3, 1 << 24), (2048, 100), (3, 40)])
def test_round_trip(monkeypatch, batch, table):
    """Also with seek tables whose limit leaves a point for every few frames only."""
    monkeypatch.setattr(flac, "BATCH", batch)
    monkeypatch.setattr(flac, "TABLE_BYTES", table)
    media = flac.encode(PAYLOADS)
    assert all(len(flac._metadata(m)[3]) * 18 < table for m in media)
    assert len(flac._metadata(media[6])[3]) > 1
    for streams in (media, [without_seek_table(m) for m in media]):
        assert [(x + 128).astype(np.uint8).tobytes() for x in flac.decode(streams)] == PAYLOADS


def test_checksums_are_verified():
    stream = bytearray(flac.encode([PAYLOADS[1]])[0])
    stream[-40] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


def test_predictors_are_used():
    first = lambda p: flac._metadata(p)[0]
    kinds = {(m[first(m) + 6] >> 1) for m in flac.encode(PAYLOADS)}
    assert 0 in kinds and 1 in kinds and any(8 <= k <= 12 for k in kinds) and any(k >= 32 for k in kinds)


def test_partitions_and_escapes():
    """A hand-made frame: 16 samples, order 0, two Rice partitions, the second one escaped to raw values."""
    x = [3, -2, 0, 1, 5, -6, 2, 0, 7, -8, 1, 1, -1, 0, 4, -3]
    bits = "1111111111111000" + "01100100" + "00000010" + "00000000"  # 8-bit block size follows
    head = int(bits, 2).to_bytes(5, "big") + bytes([15])
    crc8 = int(flac.crc(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]), flac.CRC8, 8)[0])
    body = "00010000" + "00" + "0001" + "0001"
    for v in x[:8]:
        z = v * 2 if v >= 0 else -v * 2 - 1
        body += "0" * (z >> 1) + "1" + str(z & 1)
    body += "1111" + "00100" + "".join(f"{v & 15:04b}" for v in x[8:])
    body += "0" * (-len(body) % 8)
    frame = head + bytes([crc8]) + int(body, 2).to_bytes(len(body) // 8, "big")
    frame += int(flac.crc(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), flac.CRC16, 16)[0]).to_bytes(2, "big")
    got, end = flac.decode_frames(np.frombuffer(frame, np.uint8), np.array([0]))
    assert got[0].tolist() == x and end[0] == len(frame)


def test_documents(spark):
    rows = [(1, "x"), (2, None), (3, ""), (None, "x"), (1, "x"), (4, "é" * 90000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, media int")
    media = flac.to_media(docs)
    got = sorted((r.doc_id or -1, r.n_bytes) for r in media.collect())
    assert got == sorted((i or -1, len((t or "").encode())) for i, t in rows)
    assert len({bytes(r.media) for r in media.where("n_bytes = 1").collect()}) == 1
    blocks = flac.pcm_blocks(media.where("doc_id = 4")).orderBy("sample").collect()
    assert [r.sample for r in blocks] == [576 * flac.PCM_FRAMES * i for i in range(len(blocks))] and len(blocks) > 3
    assert hashlib.md5(b"".join(bytes(r.pcm) for r in blocks)).digest() == hashlib.md5(padded(("é" * 90000).encode())).digest()
    assert flac.to_media(docs.limit(0)).count() == 0


def test_digests_are_those_of_the_payload(spark):
    texts = ["x", None, "", "é" * 90000, "the rill runs " * 500]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts])] + [(None, "x")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in flac.digests(docs).collect()}
    assert len(got) == 11
    for i, t in enumerate([*texts, *texts]):
        p, r = padded((t or "").encode()), got[i]
        x = np.frombuffer(p, np.uint8).astype(int) - 128
        crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest())
        assert r.tail_crc32 == zlib.crc32(p[-32:]) and (r.media_bytes, r.media_sha256) == (got[i % 5].media_bytes, got[i % 5].media_sha256)
        assert r.feature == f"peak={np.abs(x).max()};mean={np.abs(x).sum() // len(x)};crossings={crossings};energy={(x * x).sum()}"
    assert flac.digests(docs.limit(0)).count() == 0
