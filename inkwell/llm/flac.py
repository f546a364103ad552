"""Media columns: FLAC streams written and read in numpy, all frames of a batch in step.

The reader takes mono to eight channels (left-side, right-side and mid-side stereo too), constant, verbatim, fixed and
LPC subframes, Rice partitions of both widths with escapes, and wasted bits; it verifies the CRC-8 of each header, the
CRC-16 of each frame and the stream's MD5. Frames whose places the seek table gives are decoded side by side, one
sample a step; streams without a full table are read frame by frame. The writer makes 8-bit mono frames of BLOCK
samples, each constant, verbatim, fixed-predicted (order 0 to 2) or predicted linearly from the LPC samples before
(autocorrelation, Levinson-Durbin), whichever is shortest at its best Rice parameter, and a seek point a frame, so any
PCM block is reached by its sample offset without reading what is before it.

Media column: bytes b become samples b - 128. The query writes the streams, reads them back and folds its features over
the PCM that the seek points lead to. Rows go through in groups of about GROUP bytes, frames AT_ONCE samples at a time
(all streams together), so what a text costs beyond its own bytes and stream's does not grow with it; a damaged stream
raises ValueError.

Defined cases: null and empty texts are 64 zero bytes; equal texts give equal streams and features; repeated rows
give equal rows; texts are stored whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.shared import ship, table, written

BLOCK, RATE, GROUP, AT_ONCE = 512, 8000, 1 << 21, 1 << 20
LPC, PRECISION, LINEAR = 4, 12, 3  # LINEAR: the way after the fixed predictors


def crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crc(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, bits: int) -> np.ndarray:
    """Of each buf[start:stop]. Both sums start at 0, so leading zeros are neutral and rows can end together."""
    t, n = (CRC8 if bits == 8 else CRC16), stop - start
    out = np.zeros(len(start), np.int64)
    order = np.argsort(-n, kind="stable")
    n, stop, rows = n[order], stop[order], np.zeros(len(start), np.int64)
    many = np.searchsorted(-n, -np.arange(int(n.max(initial=0)), 0, -1), "right")
    for back, k in zip(range(int(n.max(initial=0)), 0, -1), many, strict=True):
        byte = buf[stop[:k] - back]
        c = rows[:k]
        rows[:k] = (t[c ^ byte] if bits == 8 else (c << 8 & 0xFFFF) ^ t[c >> 8 ^ byte])
    out[order] = rows
    return out


def put_bits(values: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of fields (values of at most 16 bits, right-aligned in widths of any size) to bytes; each row's length,
    with two bytes of 0 at its end. Fields never share bits, so their words are sums."""
    ends = np.cumsum(widths, 1)
    size = (ends[:, -1] + 7) // 8 + 2
    base = np.cumsum(size) - size
    last = (ends + 8 * base[:, None] - 1).ravel()
    use = widths.ravel() > 0
    last, v = last[use], values.ravel()[use].astype(np.int64) << (31 - (last[use] & 31))
    words = int(size.sum()) // 4 + 2
    at = last >> 5
    sums = np.bincount(at + 1, (v & 0xFFFFFFFF).astype(float), words + 1) + np.bincount(at, (v >> 32).astype(float), words + 1)
    return sums[1:].astype(">u4").view(np.uint8)[: int(size.sum())], size


def number_fields(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the extended UTF-8 of headers: 6 fields of 8 bits, unused ones 0 wide."""
    extra = sum((n >= lim).astype(np.int64) for lim in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26))
    values, widths = np.zeros((len(n), 6), np.int64), np.zeros((len(n), 6), np.int64)
    for k in range(6):
        on = k <= extra
        part = n >> 6 * np.maximum(extra - k, 0)
        lead = np.where(extra == 0, 0, (0xFF00 >> extra + 1) & 0xFF)
        values[:, k] = np.where(on, part | lead if k == 0 else part & 63 | 128, 0)
        widths[:, k] = 8 * on
    return values, widths


def linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients in PRECISION bits (m, LPC), shifts and residuals (m, n - LPC) of each row; sums are of whole numbers,
    so that a frame's predictor is the same whatever is encoded beside it."""
    m, n = x.shape
    r = np.stack([(x[:, k:] * x[:, : n - k]).sum(1) for k in range(LPC + 1)], 1).astype(float)
    a, err = np.zeros((m, LPC)), np.maximum(r[:, 0], 1.0)
    for i in range(LPC):
        acc = r[:, i + 1].copy()
        for j in range(i):
            acc -= a[:, j] * r[:, i - j]
        k = np.where(err > 0, acc / np.where(err > 0, err, 1), 0)
        old = a.copy()
        for j in range(i):
            a[:, j] = old[:, j] - k * old[:, i - 1 - j]
        a[:, i] = k
        err = err * (1 - k * k)
    top = np.maximum(abs(a).max(1), 1e-9)
    shift = np.clip(PRECISION - 1 - np.frexp(top)[1], 0, 15)
    most = (1 << (PRECISION - 1)) - 1
    coef = np.clip(np.rint(a * np.exp2(shift)[:, None]), -most, most).astype(np.int64)
    guess = sum(coef[:, j : j + 1] * x[:, LPC - 1 - j : n - 1 - j] for j in range(LPC)) >> shift[:, None]
    return coef, shift, x[:, LPC:] - guess


def frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encodes frames of one size: samples (m, n) of 8 bits. All bytes, in order, and each frame's length."""
    m, n = x.shape
    head_v, head_w = np.empty((m, 4), np.int64), np.full((m, 4), 8)
    head_v[:] = (0xFF, 0xF8, 0x90 if n == BLOCK else 0x70, 0x02)
    num_v, num_w = number_fields(number)
    tail = np.tile([(n - 1) >> 8, (n - 1) & 255], (m, 1))
    tail_w = np.full((m, 2), 0 if n == BLOCK else 8)
    head, size = put_bits(np.hstack([head_v, num_v, tail]), np.hstack([head_w, num_w, tail_w]))
    stop = np.cumsum(size) - 2
    sums = crc(head, stop + 2 - size, stop, 8)
    best, kind, param = np.full(m, 8 * n), np.full(m, -1), np.zeros(m, np.int64)
    tries = [(order, order, np.diff(x, order, 1)) for order in range(min(3, n))]
    if n > LPC:
        coef, shift, r = linear(x)
        tries.append((LINEAR, LPC, r))
    residual = {}
    for way, order, r in tries:
        u = np.where(r < 0, -2 * r - 1, 2 * r)
        total = u.sum(1)
        k = np.clip(np.floor(np.log2(np.maximum(total / u.shape[1], 1))), 0, 14).astype(np.int64)
        bits = (u >> k[:, None]).sum(1) + u.shape[1] * (1 + k) + 8 * order + 10 + (9 + LPC * PRECISION if way == LINEAR else 0)
        better = bits < best
        best, kind, param = np.where(better, bits, best), np.where(better, way, kind), np.where(better, k, param)
        residual[way] = u
    kind[(x == x[:, :1]).all(1)] = -2
    out_v, out_w = np.zeros((m, 17 + n + LPC), np.int64), np.zeros((m, 17 + n + LPC), np.int64)
    out_v[:, :4], out_w[:, :4], out_v[:, 4:10], out_w[:, 4:10], out_v[:, 10:12], out_w[:, 10:12] = head_v, 8, num_v, num_w, tail, tail_w
    out_v[:, 12], out_w[:, 12] = sums, 8
    out_v[:, 13] = np.select([kind == -2, kind == -1, kind == LINEAR], [0, 2, 2 * (31 + LPC)], 16 + 2 * kind)
    out_w[:, 13] = 8
    flat = kind == -2
    out_v[flat, 14], out_w[flat, 14] = x[flat, 0] & 255, 8
    raw = kind == -1
    out_v[raw, 14 : 14 + n], out_w[raw, 14 : 14 + n] = x[raw] & 255, 8
    for way, order, _ in tries:
        own = np.flatnonzero(kind == way)
        if len(own):
            at = 14 + order
            out_v[own, 14:at], out_w[own, 14:at] = x[own, :order] & 255, 8
            if way == LINEAR:
                out_v[own, at], out_w[own, at] = PRECISION - 1 << 5 | shift[own], 9
                out_v[own, at + 1 : at + 1 + LPC], out_w[own, at + 1 : at + 1 + LPC] = coef[own] & (1 << PRECISION) - 1, PRECISION
                at += 1 + LPC
            out_v[own, at], out_w[own, at] = param[own], 10
            k, u = param[own][:, None], residual[way][own]
            at, to = at + 1, at + 1 + n - order
            out_v[own, at:to], out_w[own, at:to] = 1 << k | u & (1 << k) - 1, (u >> k) + 1 + k
    data, size = put_bits(out_v, out_w)
    stop = np.cumsum(size)
    sums = crc(data, stop - size, stop - 2, 16)
    data[stop - 2], data[stop - 1] = sums >> 8, sums & 255
    return data, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each non-empty payload."""
    pieces: list[list] = [[None] * -(-len(p) // BLOCK) for p in payloads]
    groups: dict[int, list[tuple[int, int]]] = {}
    for d, p in enumerate(payloads):
        for f in range(len(pieces[d])):
            groups.setdefault(min(BLOCK, len(p) - f * BLOCK), []).append((d, f))
    for n, every in groups.items():
        many = max(1, AT_ONCE // n)
        for places in (every[k : k + many] for k in range(0, len(every), many)):
            x = np.frombuffer(b"".join(payloads[d][f * BLOCK : f * BLOCK + n] for d, f in places), np.uint8).reshape(-1, n).astype(np.int64) - 128
            data, size = frames(x, np.array([f for _, f in places]))
            data, upto = data.tobytes(), np.cumsum(size).tolist()
            for (d, f), a, b in zip(places, [0, *upto], upto, strict=False):
                pieces[d][f] = data[a:b]
    out = []
    for p, fs in zip(payloads, pieces, strict=True):
        sizes = [len(f) for f in fs]
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        seek = np.zeros((len(fs), 18), np.uint8)
        seek[:, :8] = (np.arange(len(fs)) * BLOCK).astype(">u8").view(np.uint8).reshape(-1, 8)
        seek[:, 8:16] = (np.cumsum(sizes) - sizes).astype(">u8").view(np.uint8).reshape(-1, 8)
        seek[:, 16:] = np.minimum(BLOCK, len(p) - np.arange(len(fs)) * BLOCK).astype(">u2").view(np.uint8).reshape(-1, 2)
        points = seek.tobytes()
        blocks, at = [], 0
        while at < len(points) or not blocks:  # a metadata block holds under 2**24 bytes
            blocks.append(points[at : at + 18 * 900_000])
            at += 18 * 900_000
        meta = b"".join(bytes([3 | 128 * (k == len(blocks) - 1)]) + len(b).to_bytes(3, "big") + b for k, b in enumerate(blocks))
        out.append(b"fLaC\x00\x00\x00\x22" + info + meta + b"".join(fs))
    return out


class Bits:
    """Reads fields at many places of a buffer at once."""

    def __init__(self, raw: bytes):
        self.size = len(raw)
        self.buf = np.frombuffer(raw + bytes(16), np.uint8)
        b = self.buf.astype(np.int64)
        self.wide = b[:-4] << 32 | b[1:-3] << 24 | b[2:-2] << 16 | b[3:-1] << 8 | b[4:]

    def get(self, pos: np.ndarray, n) -> np.ndarray:
        """n (at most 32) bits at each pos."""
        if (pos > 8 * self.size).any():
            raise ValueError("FLAC: the stream ends within a frame")
        return self.wide[pos >> 3] >> (40 - (pos & 7) - n) & ((1 << n) - 1)

    def signed(self, pos: np.ndarray, n) -> np.ndarray:
        v = self.get(pos, n)
        return v - ((v >> np.maximum(n - 1, 0) & 1) << n)

    def zeros(self, pos: np.ndarray) -> np.ndarray:
        """How many 0 bits come before the next 1."""
        out = np.zeros(len(pos), np.int64)
        live = np.arange(len(pos))
        while len(live):
            v = self.get(pos[live] + out[live], 32)
            out[live] += 32 - np.frexp(v.astype(float))[1]
            live = live[v == 0]
        return out


def residuals(bits: Bits, pos: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(m, n - order) residuals and the positions after them."""
    head = bits.get(pos, 6)
    out, after = np.zeros((len(pos), n - order), np.int64), pos + 6
    for h in np.unique(head):
        rows, width, parts = np.flatnonzero(head == h), 4 + (h >> 4), 1 << (h & 15)
        if h >> 4 > 1 or n % parts:
            raise ValueError("FLAC: bad residual coding")
        p, at = after[rows], 0
        for part in range(parts):
            k = bits.get(p, width)
            p = p + width
            count = n // parts - (order if part == 0 else 0)
            raw = np.flatnonzero(k == (1 << width) - 1)
            if len(raw):
                w = bits.get(p[raw], 5)
                for i in range(count):
                    out[rows[raw], at + i] = np.where(w > 0, bits.signed(p[raw] + 5 + i * w, w), 0)
                p[raw] += 5 + count * w
            rice = np.flatnonzero(k != (1 << width) - 1)
            if len(rice):
                kk, q = k[rice], p[rice]
                u = np.empty((count, len(rice)), np.int64)
                for i in range(count):
                    z = bits.zeros(q)
                    q = q + z + 1
                    u[i] = z << kk | bits.get(q, kk)
                    q = q + kk
                out[rows[rice], at : at + count] = (u >> 1 ^ -(u & 1)).T
                p[rice] = q
            at += count
        after[rows] = p
    return out, after


LEADING = 16 - np.frexp(np.arange(1 << 16).astype(float))[1].astype(np.int64)  # zeros before the first 1 of 16 bits


def residuals_together(bits: Bits, pos: np.ndarray, n: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(m, n) residuals, each row's from its order on, and the positions after them. Rows whose residuals are one Rice
    partition, as the writer's are, are decoded side by side whatever their order; others by kind."""
    out, after = np.zeros((len(pos), n), np.int64), pos.copy()
    plain = (bits.get(pos, 6) == 0) & (bits.get(pos + 6, 4) != 15)
    for o in np.unique(order[~plain]):
        rows = np.flatnonzero(~plain & (order == o))
        out[rows, o:], after[rows] = residuals(bits, pos[rows], n, int(o))
    rows = np.flatnonzero(plain)
    rows = rows[np.argsort(order[rows], kind="stable")]
    if not len(rows):
        return out, after
    k, q, first = bits.get(pos[rows] + 6, 4), pos[rows] + 10, order[rows]
    low, most, u = (1 << k) - 1, first[-1], np.zeros((n, len(rows)), np.int64)
    wide, mask = bits.wide, (1 << 40) - 1
    try:
        for i in range(int(first[0]), n):
            m = len(rows) if i >= most else int(np.searchsorted(first, i, "right"))
            kk, at = k[:m], q[:m]
            v = wide[at >> 3] << (at & 7) & mask
            z = LEADING[v >> 24]
            need = z + 1 + kk
            u[i, :m] = z << kk | v >> 40 - need & low[:m]
            if (far := np.flatnonzero((z == 16) | (need > 33))).size:  # longer than what one look shows
                zz = bits.zeros(at[far])
                u[i, far] = zz << kk[far] | bits.get(at[far] + zz + 1, kk[far])
                need[far] = zz + 1 + kk[far]
            at += need
    except IndexError:
        raise ValueError("FLAC: the stream ends within a frame") from None
    out[rows] = (u >> 1 ^ -(u & 1)).T
    after[rows] = q
    return out, after


def subframes(bits: Bits, pos: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(m, n) samples of one channel and the positions after it."""
    head = bits.get(pos, 8)
    if (head >> 7).any():
        raise ValueError("FLAC: bad subframe")
    pos, waste = pos + 8, np.zeros(len(pos), np.int64)
    some = np.flatnonzero(head & 1)
    if len(some):
        waste[some] = bits.zeros(pos[some]) + 1
        pos[some] += waste[some]
    out, order = np.zeros((len(pos), n), np.int64), np.full(len(pos), -1)
    kinds, predicted = (head >> 1) << 8 | waste, []
    for kind in np.unique(kinds):
        rows, t, d = np.flatnonzero(kinds == kind), int(kind >> 8), depth - int(kind & 255)
        p = pos[rows]
        if t == 0:
            out[rows], p = np.repeat(bits.signed(p, d)[:, None], n, 1), p + d
        elif t == 1:
            out[rows], p = bits.signed(p[:, None] + d * np.arange(n), d), p + d * n
        elif 8 <= t <= 12 or t >= 32:
            order[rows] = o = t - 8 if t < 32 else t - 31
            out[rows[:, None], np.arange(o)], p = bits.signed(p[:, None] + d * np.arange(o), d), p + d * o
            precision = shift = coef = None
            if t >= 32:
                precision, shift, p = bits.get(p, 4) + 1, bits.signed(p + 4, 5), p + 9
                coef = np.stack([bits.signed(p + i * precision, precision) for i in range(o)])
                p = p + o * precision
            predicted.append((rows, o, precision, shift, coef, d))
        else:
            raise ValueError("FLAC: reserved subframe type")
        pos[rows] = p
    own = np.flatnonzero(order >= 0)
    if len(own):
        if n < order.max():
            raise ValueError("FLAC: a block is shorter than its predictor")
        r, pos[own] = residuals_together(bits, pos[own], n, order[own])
        place = np.zeros(len(pos), np.int64)
        place[own] = np.arange(len(own))
    for rows, o, precision, shift, coef, d in predicted:
        x = r[place[rows], o:]
        if coef is None:
            for j in range(o, 0, -1):
                x = np.cumsum(x, 1) + np.diff(out[rows, :o], j - 1, 1)[:, -1:]
            out[rows, o:] = x
        else:
            kind = np.int32 if d + int(precision.max()) + o.bit_length() < 31 and (abs(x) < 1 << 30).all() else np.int64
            y, x, coef, shift = np.zeros((n, len(rows)), kind), x.T.astype(kind), coef.astype(kind), shift.astype(kind)
            y[:o] = out[rows, :o].T
            for i in range(o, n):
                guess = coef[0] * y[i - 1]
                for j in range(1, o):
                    guess += coef[j] * y[i - 1 - j]
                y[i] = x[i - o] + (guess >> shift)
            out[rows] = y.T
    return out << waste[:, None], pos


class Stream:
    """Metadata of one stream: depth, channels, samples, MD5, seek points (sample, place, samples)."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"fLaC":
            raise ValueError("FLAC: no marker")
        at, last, self.seek = 4, False, []
        while not last:
            kind, size = raw[at], int.from_bytes(raw[at + 1 : at + 4], "big")
            body, last = raw[at + 4 : at + 4 + size], bool(kind & 128)
            if kind & 127 == 0:
                x = int.from_bytes(body[10:18], "big")
                self.channels, self.depth, self.samples, self.md5 = (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1, body[18:34]
                self.block = int.from_bytes(body[2:4], "big")
            elif kind & 127 == 3:
                s = np.frombuffer(body, np.uint8).reshape(-1, 18)
                first, place = (np.ascontiguousarray(s[:, k : k + 8]).view(">i8").ravel() for k in (0, 8))
                self.seek += [x for x in zip(first.tolist(), place.tolist(), np.ascontiguousarray(s[:, 16:]).view(">u2").ravel().tolist(), strict=True) if x[0] >= 0]
            at += 4 + size
        self.first = at
        known = sorted(self.seek)
        self.whole = bool(known) and self.samples > 0 and sum(x[2] for x in known) == self.samples and all(a[0] + a[2] == b[0] for a, b in zip(known, known[1:], strict=False))
        self.seek = known


SIZES = {1: 192, **{k: 576 << k - 2 for k in range(2, 6)}, **{k: 256 << k - 8 for k in range(8, 16)}}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def read_frames(bits: Bits, start: np.ndarray, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Frames at the bytes start, each (channels, samples), and where each ends. Checks both sums."""
    b = bits.buf
    if ((b[start] != 0xFF) | (b[start + 1] & 0xFE != 0xF8)).any():
        raise ValueError("FLAC: no frame where one should be")
    code, rate, chan, dep = b[start + 2] >> 4, b[start + 2] & 15, b[start + 3] >> 4, b[start + 3] >> 1 & 7
    lead = b[start + 4].astype(np.int64)
    at = start + 4 + np.where(lead < 128, 1, 8 - np.frexp((lead ^ 255).astype(float))[1])
    n = np.array([SIZES.get(int(c), 0) for c in code])
    n = np.where(code == 6, b[at].astype(np.int64) + 1, np.where(code == 7, (b[at].astype(np.int64) << 8 | b[at + 1]) + 1, n))
    at = at + np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    if (crc(b, start, at, 8) != b[at]).any():
        raise ValueError("FLAC: a header's checksum differs")
    out: list = [None] * len(start)
    stop = np.zeros(len(start), np.int64)
    kinds = n << 8 | chan.astype(np.int64) << 4 | dep
    for kind in np.unique(kinds):
        rows, size, c, own = np.flatnonzero(kinds == kind), int(kind >> 8), int(kind >> 4 & 15), DEPTHS.get(int(kind & 7), depth)
        if not size or c > 10:
            raise ValueError("FLAC: reserved header code")
        pos, got = 8 * (at[rows] + 1), []
        for k in range(c + 1 if c < 8 else 2):
            x, pos = subframes(bits, pos, size, own + ((c, k) in ((8, 1), (9, 0), (10, 1))))
            got.append(x)
        if c == 8:
            got[1] = got[0] - got[1]
        elif c == 9:
            got[0] = got[0] + got[1]
        elif c == 10:
            mid = got[0] << 1 | got[1] & 1
            got = [mid + got[1] >> 1, mid - got[1] >> 1]
        stop[rows] = (pos + 7) // 8 + 2
        for r, x in zip(rows, np.stack(got, 1), strict=True):
            out[r] = x
    if (stop > bits.size).any():
        raise ValueError("FLAC: the stream ends within a frame")
    if (crc(b, start, stop - 2, 16) != (b[stop - 2].astype(np.int64) << 8 | b[stop - 1])).any():
        raise ValueError("FLAC: a frame's checksum differs")
    return out, stop


def pcm(streams: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(stream, first sample, (channels, samples)): stretches of each stream, in order. Streams with full seek tables are
    read together, AT_ONCE samples at a time; the MD5 of each is verified at its end."""
    infos = [Stream(s) for s in streams]
    sums = [hashlib.md5() for _ in streams]

    def told(d: int, first: int, x: np.ndarray) -> tuple[int, int, np.ndarray]:
        sums[d].update(np.ascontiguousarray(x.T).astype("<i4").view(np.uint8).reshape(-1, 4)[:, : (infos[d].depth + 7) // 8].tobytes())
        return d, first, x

    base = np.cumsum([0] + [len(s) for s in streams]).tolist()
    raw = streams[0] if len(streams) == 1 else b"".join(streams)
    for depth in sorted({i.depth for i in infos if i.whole}):
        own = [(d, base[d] + i.first + place, first, n) for d, i in enumerate(infos) if i.whole and i.depth == depth for first, place, n in i.seek]
        upto = np.cumsum([n for *_, n in own])
        a = 0
        while a < len(own):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + AT_ONCE, "right")))
            part = own[a:z]
            stop = base[part[-1][0] + 1] if z == len(own) or own[z][0] != part[-1][0] else own[z][1]
            got, _ = read_frames(Bits(raw[part[0][1] : stop]), np.array([p for _, p, *_ in part]) - part[0][1], depth)
            cuts = [0, *(k for k in range(1, len(part)) if part[k][0] != part[k - 1][0]), len(part)]
            for k, m in zip(cuts, cuts[1:], strict=False):
                yield told(part[k][0], part[k][2], np.hstack(got[k:m]))
            a = z
    for d, i in enumerate(infos):
        if not i.whole:
            bits, at, first = Bits(streams[d]), i.first, 0
            while at < len(streams[d]):
                (x,), (at,) = read_frames(bits, np.array([at]), i.depth)
                yield told(d, first, x)
                first += x.shape[1]
    for i, own in zip(infos, sums, strict=True):
        if any(i.md5) and own.digest() != i.md5:
            raise ValueError("FLAC: the samples' MD5 differs")


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """(channels, samples) of each stream."""
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for d, _, x in pcm(streams):
        out[d].append(x)
    return [np.hstack(xs) if xs else np.zeros((Stream(s).channels, 0), np.int64) for s, xs in zip(streams, out, strict=True)]


def seek_pcm(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The PCM block that holds a sample, and its first sample's number, reading that frame alone."""
    info = Stream(stream)
    first, place, _ = max(x for x in info.seek if x[0] <= sample)
    (x,), _ = read_frames(Bits(stream), np.array([info.first + place]), info.depth)
    return first, x


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(64 - len(raw) if not raw else -len(raw) % 64)


def grouped(rows: Iterator[tuple], size) -> Iterator[list[tuple]]:
    out, n = [], 0
    for row in rows:
        out.append(row)
        n += size(row)
        if n >= GROUP:
            yield out
            out, n = [], 0
    if out:
        yield out


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True)
        for group in grouped(((k, len((t or "").encode()), payload(t)) for k, t in rows), lambda r: len(r[2])):
            media = encode([p for _, _, p in group])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in group], b.column(0).type), pa.array([n for _, n, _ in group], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


class Fold:
    """What the query tells of a payload, from its samples as they come."""

    def __init__(self):
        self.sha, self.tail, self.n, self.sum, self.energy, self.turns, self.peak, self.last = hashlib.sha256(), b"", 0, 0, 0, 0, 0, None

    def add(self, x: np.ndarray) -> None:
        raw = (x + 128).astype(np.uint8).tobytes()
        self.sha.update(raw)
        self.tail = (self.tail + raw[-64:])[-64:]
        below = x < 0
        self.turns += int((below[1:] != below[:-1]).sum()) + (self.last is not None and self.last != bool(below[0]))
        self.n, self.sum, self.energy, self.peak, self.last = self.n + x.size, self.sum + int(x.sum()), self.energy + int((x * x).sum()), max(self.peak, int(abs(x).max())), bool(below[-1])

    def feature(self) -> str:
        """Samples, mean, energy, sign changes and peak, all from whole numbers."""
        return f"{self.n}:{self.sum / self.n:.4f}:{self.energy / self.n:.4f}:{self.turns}:{self.peak}"


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.as_py() for x in b.column(2)), strict=True)
        for group in grouped(rows, lambda r: len(r[2])):
            folds = [Fold() for _ in group]
            for d, _, x in pcm([m for _, _, m in group]):
                folds[d].add(x[0])
            out = [(k, n, f.n, f.sha.hexdigest(), zlib.crc32(f.tail), len(media), hashlib.sha256(media).hexdigest(), f.feature()) for (k, n, media), f in zip(group, folds, strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in READ.split(", ")), r, strict=True)) for r in out], pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in READ.split(", ")]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k, media in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True):
            for _, start, x in pcm([media]):
                x = x.T
                first = list(range(0, len(x), BLOCK))
                blocks = [np.ascontiguousarray(x[a : a + BLOCK]).astype("<i4").tobytes() for a in first]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(first), b.column(0).type), pa.array([start + a for a in first], pa.int64()), pa.array([min(BLOCK, len(x) - a) for a in first], pa.int64()), pa.array(blocks, pa.binary())], ["doc_id", "first_sample", "n_samples", "pcm"])


def stored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a FLAC stream."""
    ship(spark)
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def pcm_blocks(spark: SparkSession, media: DataFrame) -> DataFrame:
    """(doc_id, first_sample, n_samples, pcm): interleaved 32-bit samples of FLAC streams (doc_id, media), in blocks."""
    ship(spark)
    return media.select("doc_id", "media").mapInArrow(_blocks, "doc_id long, first_sample long, n_samples long, pcm binary")


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = written(spark, stored(spark, table(spark, sf_dir, "documents")), "media", "zstd")
    return media.mapInArrow(_read, READ)
