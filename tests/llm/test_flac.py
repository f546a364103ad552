"""Round trips, streams of other encoders, damage, and seeking."""

import hashlib
import zlib

import numpy as np
import pytest

from inkwell.llm import flac

from .conftest import documents, odd_rows, prose


def check_row(r, text):
    raw = (text or "").encode()
    full = raw + bytes((64 - len(raw) % 64) % 64 or (0 if raw else 64))
    assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    media = flac.encode([full])[0]
    assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, folder, clash):
    rows = odd_rows()
    got = flac.op4_flac_media(spark, folder(clash, documents=documents(rows))).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    texts = {r[0]: r[1] for r in rows if r[0] not in (None, 15)}
    for r in got:
        if r["doc_id"] in texts:
            check_row(r, texts[r["doc_id"]])
    feature = {r["doc_id"]: r["feature"] for r in got}
    assert feature[1] == feature[2] and feature[6] == feature[7] == feature[14] != feature[8]


def test_empty_table(spark, folder):
    assert flac.op4_flac_media(spark, folder(documents=documents([]))).count() == 0


def test_round_trips():
    r = np.random.default_rng(0)
    payloads = [bytes(64), b"\xff" * 1000, bytes(range(256)) * 5, r.integers(0, 256, 5_000).astype(np.uint8).tobytes(), prose(1, 3_000).encode(), b"\x80", b"\x00\xff" * 700, "é漢😀".encode() * 300]
    payloads += [r.integers(100, 100 + k, 64 * k).astype(np.uint8).tobytes() for k in range(1, 20)]
    for p, x in zip(payloads, flac.decode(flac.encode(payloads)), strict=True):
        assert (x[0] + 128).astype(np.uint8).tobytes() == p


def test_many_frames_have_long_numbers():
    p = prose(2, 30_000).encode() * 2
    stream = flac.encode([p])[0]
    assert len(p) // flac.BLOCK > 128 and len(stream) < len(p)
    for sample in (0, 511, 512, 70_000, len(p) - 1):
        first, x = flac.seek_pcm(stream, sample)
        assert first == sample // flac.BLOCK * flac.BLOCK
        assert (x[0] + 128).astype(np.uint8).tobytes() == p[first : first + flac.BLOCK]


def test_blocks(spark):
    p = prose(3, 900).encode()
    df = spark.createDataFrame([(7, flac.encode([p])[0])], "doc_id long, media binary")
    rows = sorted(map(tuple, flac.pcm_blocks(spark, df).collect()))
    assert [r[1] for r in rows] == list(range(0, len(p), flac.BLOCK)) and sum(r[2] for r in rows) == len(p)
    assert b"".join((np.frombuffer(r[3], "<i4") + 128).astype(np.uint8).tobytes() for r in rows) == p


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, v, n):
        self.bits += format(v & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, v, k):
        u = 2 * v if v >= 0 else -2 * v - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits, 2).to_bytes(len(self.bits) // 8, "big")


def crc_slow(raw, poly, width):
    c = 0
    for b in raw:
        c ^= b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (width - 1) else c << 1) & ((1 << width) - 1)
    return c


def lpc_subframe(w, x, depth, coef, shift, precision, partitions, width=4, escape=False, waste=0):
    n, order = len(x), len(coef)
    w.put(0, 1), w.put(31 + order, 6), w.put(int(waste > 0), 1)
    if waste:
        w.bits += "0" * (waste - 1) + "1"
    x, depth = x >> waste, depth - waste
    for v in x[:order]:
        w.put(int(v), depth)
    w.put(precision - 1, 4), w.put(shift, 5)
    for c in coef:
        w.put(c, precision)
    res = [int(x[i]) - (sum(c * int(x[i - 1 - j]) for j, c in enumerate(coef)) >> shift) for i in range(order, n)]
    w.put(width - 4, 2), w.put(partitions, 4)
    at = 0
    for part in range(1 << partitions):
        count = n // (1 << partitions) - (order if part == 0 else 0)
        own = res[at : at + count]
        if escape and part == 0:
            w.put((1 << width) - 1, width), w.put(20, 5)
            for v in own:
                w.put(v, 20)
        else:
            w.put(5 + part, width)
            for v in own:
                w.rice(v, 5 + part)
        at += count


def foreign(channels, assignment, depth=16, block=192, **kw):
    """A stream without seek table: (channels, samples) in frames of 192, all subframes LPC."""
    n = channels.shape[1]
    out = b""
    for f in range(n // block):
        x = channels[:, f * block : (f + 1) * block].astype(np.int64)
        if assignment == 8:
            sub = [x[0], x[0] - x[1]]
        elif assignment == 9:
            sub = [x[0] - x[1], x[1]]
        elif assignment == 10:
            sub = [(x[0] + x[1]) >> 1, x[0] - x[1]]
        else:
            sub = list(x)
        w = Writer()
        w.put(0xFFF8, 16), w.put(1, 4), w.put(9, 4), w.put(assignment, 4), w.put({8: 1, 16: 4}[depth], 3), w.put(0, 1), w.put(f, 8)
        w.put(crc_slow(w.bytes(), 0x07, 8), 8)
        for k, s in enumerate(sub):
            lpc_subframe(w, s, depth + ((assignment, k) in ((8, 1), (9, 0), (10, 1))), **kw)
        raw = w.bytes()
        out += raw + crc_slow(raw, 0x8005, 16).to_bytes(2, "big")
    pcm = channels.T.astype("<i2" if depth == 16 else "i1").tobytes()
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (len(channels) - 1) << 41 | (depth - 1) << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + info + out


WAVE = np.stack([(8000 * np.sin(np.arange(576) / 9)).astype(np.int64), (5000 * np.cos(np.arange(576) / 13)).astype(np.int64)])


@pytest.mark.parametrize("assignment", [1, 8, 9, 10])
@pytest.mark.parametrize("kw", [{"partitions": 0}, {"partitions": 3, "escape": True}, {"partitions": 1, "width": 5}])
def test_linear_predictors(assignment, kw):
    stream = foreign(WAVE, assignment, coef=[56, -27], shift=5, precision=8, **kw)
    assert (flac.decode([stream])[0] == WAVE).all()


def test_wasted_bits_and_mono():
    x = (WAVE[:1] >> 3) << 3
    stream = foreign(x, 0, coef=[30, 2, -3, 1], shift=5, precision=7, partitions=2, waste=3)
    assert (flac.decode([stream])[0] == x).all()


@pytest.mark.parametrize("back", [1, 2, 40, 200])
def test_damage_is_found(back):
    for stream in (flac.encode([prose(4, 200).encode()])[0], foreign(WAVE, 10, coef=[56, -27], shift=5, precision=8, partitions=1)):
        bad = bytearray(stream)
        bad[-back] ^= 16
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    with pytest.raises(ValueError):
        flac.decode([b"RIFF" + bytes(60)])


def test_checksums():
    raw = np.frombuffer(prose(5, 50).encode(), np.uint8)
    a, b = np.array([0, 3, 50]), np.array([20, 4, 200])
    for bits, poly in ((8, 0x07), (16, 0x8005)):
        assert flac.crc(raw, a, b, bits).tolist() == [crc_slow(raw[x:y].tobytes(), poly, bits) for x, y in zip(a, b, strict=True)]


def test_the_writer_predicts_linearly():
    """A tone in noise is shorter with a linear predictor; frames of any length, shorter than its order too."""
    wave = (60 * np.sin(np.arange(40 * flac.BLOCK) / 3) + 20 * np.sin(np.arange(40 * flac.BLOCK) / 1.7)).astype(np.int64)
    p = (wave + 128).astype(np.uint8).tobytes()
    stream = flac.encode([p])[0]
    info = flac.Stream(stream)
    kinds = {stream[info.first + place + 6 : info.first + place + 9] for _, place, _ in info.seek[:3]}
    heads = [stream[info.first + place + 6] for _, place, _ in info.seek[:100]]
    assert kinds and heads.count(2 * (31 + flac.LPC)) > 20 and len(stream) < 0.75 * len(p)
    for n in range(1, 12):
        for k in (p[:n], p[: flac.BLOCK + n]):
            assert (flac.decode(flac.encode([k]))[0][0] + 128).astype(np.uint8).tobytes() == k


@pytest.mark.filterwarnings("error")
def test_long_texts_go_through_in_parts(monkeypatch):
    """The same streams and features however many samples go at once; a long text's work is in parts."""
    texts = [prose(6, 9_000), "z" * 5_000, prose(7, 30), ""]
    payloads = [flac.payload(t) for t in texts]
    whole = flac.encode(payloads)
    fold = lambda: [(f.n, f.sha.hexdigest(), f.tail, f.feature()) for f in folded(whole)]

    def folded(streams):
        out = [flac.Fold() for _ in streams]
        for d, _, x in flac.pcm(streams):
            out[d].add(x[0])
        return out

    want = fold()
    assert [w[1] for w in want] == [hashlib.sha256(p).hexdigest() for p in payloads] and [w[2] for w in want] == [p[-64:] for p in payloads]
    monkeypatch.setattr(flac, "AT_ONCE", 1024)
    assert flac.encode(payloads) == whole and fold() == want
    assert max(x.shape[1] for _, _, x in flac.pcm(whole)) <= 1024
    assert [f for d, f, _ in flac.pcm(whole) if d == 0] == list(range(0, len(payloads[0]), 1024))
