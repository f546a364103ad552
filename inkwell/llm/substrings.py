"""Suffix-array removal of repeated 100-byte strings: bucket-pointer refinement over buckets dealt by q-grams.

A suffix array of the whole corpus to depth LENGTH, built where its buckets meet. Every LENGTH-byte window goes to the
bucket of one of its own q-grams (a function of the window's bytes, so equal windows meet): of its places of 8 bytes the
leftmost one of least hash, modulo HALF, is where the gram starts. So a gram has GRAM bytes, over half a window, and
texts that share short phrases only do not meet, while windows change their gram hardly more often than their place of
least hash. Consecutive windows with that gram in common are one run: its bytes, its start, its number of windows. Then

1. grams that more than one run of the corpus names are kept (counted with map-side sums), other runs have no repeat;
2. runs of equal bytes (by two 64-bit fingerprints, see hashing) are one class: all but its first are repeats as a
   whole, by an aggregate and a join back;
3. first runs whose gram is shared by other classes (or comes twice within) meet: tasks get them sorted by gram and go
   from gram to gram, SORTED bytes at a time. There windows are sorted by bucket-pointer refinement: initial 4-gram
   buckets, then sorting within buckets on the bucket pointers of later offsets (4, 8, 16, 32, then 36 after 64), each
   round reusing the pointers the last has updated, and leaving alone what stands alone. Windows of a bucket at depth
   LENGTH are equal; all but the earliest are repeats.

A gram of more than SPLIT classes is a bucket that is refined once more before it is dealt: its runs are taken for texts
themselves and go through 1 to 3 again, with the gram of least hash under another hash (buckets within the bucket), down
to LEVELS, where buckets may have LAST times as many. What even then stands in a larger one is dealt by the fingerprints
of its windows, which are aggregated map-side and joined back: exact too, only with more rows.

Order is (doc_id, start). Copies of a whole text are left out of 3 by joining a table of ids: all of their windows
start earlier in the first copy.

Defined cases: null and empty texts remove nothing; texts under LENGTH bytes stay whole; a null doc_id comes after
all others; rows that repeat a doc_id are the same document (strings at one start do not remove each other); texts
are read whole, in overlapping pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.hashing import U, fingerprints, mixed
from inkwell.llm.shared import forget, release, ship, table, written

LENGTH, HALF = 100, 47  # of the places of 8 bytes in a window
GRAM = LENGTH - HALF + 1
PIECE, CHUNK, SORTED = 1 << 18, 1 << 18, 1 << 18
MOST, PLACES = 1024, 1 << 22  # windows of a run; places of a chunk, at most
SPLIT, LEVELS, LAST = 256, 3, 16
NO_ID = 2**63 - 1


def slid(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each width neighbours, by doubling."""
    m, n = x, 1
    while 2 * n <= width:
        m, n = op(m[:-n], m[n:]), 2 * n
    return op(m[: len(x) - width + 1], m[width - n : len(x) - width + 1 + width - n]) if n < width else m


def words(b: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one number."""
    return np.ndarray((len(b) - 7,), "<u8", b, strides=(1,)).copy()


def seeds(w: np.ndarray, level: int = 0) -> np.ndarray:
    """A hash of the 8 bytes at each place, in the low bits the place: the least of them is the leftmost of equals."""
    h = (w ^ U(level * 0x2545F4914F6CDD1D + 0xA0761D6478BD642F & 2**64 - 1)) * U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return (h & ~U(PLACES - 1)) | np.arange(len(w), dtype=U)


def gram_hashes(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), U)
    for k in (*range(0, GRAM - 8, 8), GRAM - 8):
        h = mixed((h ^ w[at + k]) * U(0x9E3779B97F4A7C15))
    return h


def runs(pieces: list[tuple[int, bytes]], level: int = 0, named: bool = True) -> tuple[np.ndarray, ...]:
    """Of pieces (offset in text, at least LENGTH bytes): piece, gram hash, start, windows, whether the gram comes twice
    within and, if named, the bytes' fingerprints."""
    b = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
    size = np.array([len(p) for _, p in pieces])
    ends = np.cumsum(size)
    w = words(b)
    gram = (slid(seeds(w, level), LENGTH - 7, np.minimum) & U(PLACES - 1)).astype(np.int64)  # by window, the seed's place
    gram[gram - np.arange(len(gram)) >= HALF] -= HALF  # the gram's place
    fresh = np.ones(len(gram), bool)
    fresh[1:] = gram[1:] != gram[:-1]
    fresh[ends[:-1]] = True
    start = np.flatnonzero(fresh)
    piece = np.searchsorted(ends, start, "right")
    valid = start + LENGTH <= ends[piece]
    start, piece = start[valid], piece[valid]
    key = gram_hashes(w, gram[start])
    opens = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])]))
    met = np.diff(np.append(opens, len(start)))  # places of the gram: windows with one place differ
    start, piece, key = start[opens], piece[opens], key[opens]
    n = np.minimum(np.append(start[1:], len(b)), ends[piece] - LENGTH + 1) - start
    many = -(-n // MOST)
    part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    own = np.repeat(np.arange(len(start)), many)
    a = start[own] + part * MOST
    k = np.minimum(MOST, n[own] - part * MOST)
    offset = np.array([o for o, _ in pieces]) - (ends - size)
    return piece[own], key[own], a + offset[piece[own]], k, met[own] > 1, *(fingerprints(b, a, a + k + LENGTH - 1) if named else ())


def cut_up(rows: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Chunks of (row, offset, bytes): long texts in pieces that overlap by less than a window."""
    out, n = [], 0
    for k, raw in rows:
        for at in range(0, len(raw) - LENGTH + 1, PIECE):
            out.append((k, at, raw[at : at + PIECE + LENGTH - 1]))
            n += len(out[-1][2])
            if n >= CHUNK:
                yield out
                out, n = [], 0
    if out:
        yield out


def _runs(level: int, who: list[str], named: bool):
    """Runs of rows (*who, key, text); key is the gram of the bucket above. Starts are those of the whole document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = {c: b.column(c).to_numpy() for c in who}
            for chunk in cut_up((k, x.as_py() or b"") for k, x in enumerate(b.column("text"))):
                piece, gram, a, n, twice, *same = runs([(o, p) for _, o, p in chunk], level, named)
                row = np.array([k for k, _, _ in chunk])[piece]
                if level:
                    gram, a = mixed(gram ^ mixed(b.column("key").to_numpy()[row].view(U))), a + ids["base"][row]
                at = a << 12 | n << 1 | twice  # n is at most MOST
                own = {c: ids[c][row] for c in who} if named else {}
                cols = {"gram": gram.view(np.int64), **{f"same{k}": x.view(np.int64) for k, x in enumerate(same)}, **own, "at": at}
                yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in cols.items()})

    return run


def longs(*names: str) -> str:
    return ", ".join(f"{c} long" for c in names)


def refined(b: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Bucket pointers at depth LENGTH of the given starts (each with LENGTH bytes behind it): equal for equal bytes.
    Places are sorted as one number with their bucket and a later one, if all three fit into 64 bits."""
    n = len(b) - 3
    bits = n.bit_length()
    index = np.arange(n, dtype=U)
    key = np.sort(np.ndarray((n,), "<u4", b, strides=(1,)).astype(U) << U(32) | index)
    order, gram = (key & U(0xFFFFFFFF)).astype(np.int64), key >> U(32)
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    size = np.diff(np.append(first, n))
    bucket = np.empty(n, np.int64)
    bucket[order] = np.repeat(first, size)
    live = np.sort(order[np.repeat(size > 1, size)])
    wanted = np.zeros(n, bool)
    wanted[windows] = True
    for depth in (4, 8, 16, 32, LENGTH - 64):
        live = live[live + depth < n] if depth != LENGTH - 64 else live[wanted[live]]
        if not len(live):
            break
        old, later = bucket[live], bucket[live + depth]
        if 3 * bits < 64:
            key = np.sort(old << 2 * bits | later << bits | live)
            low = (1 << bits) - 1
            live, old, later = key & low, key >> 2 * bits & low, key >> bits & low
        else:
            order = np.lexsort((later, old))
            live, old, later = live[order], old[order], later[order]
        opens = np.concatenate([[True], old[1:] != old[:-1]])
        fresh = opens | np.concatenate([[True], later[1:] != later[:-1]])
        at = np.arange(len(live))
        base = np.maximum.accumulate(np.where(opens, at, 0))
        head = np.maximum.accumulate(np.where(fresh, at, 0))
        bucket[live] = old + head - base  # a bucket's pointer is where it starts in its parent
        ends = np.append(np.flatnonzero(fresh), len(live))
        live = np.sort(live[np.repeat(np.diff(ends) > 1, np.diff(ends))])
    return bucket[windows]


def repeats(strings: list[bytes], nid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to): stretches of windows that are equal to an earlier one, as text offsets. The strings of one
    nid may overlap only if several texts have it."""
    line = np.lexsort((start, nid))
    strings, d0, p0 = [strings[k] for k in line], nid[line], start[line]
    size = np.array([len(s) for s in strings])
    n, base = size - LENGTH + 1, np.cumsum(size) - size
    own = np.repeat(np.arange(len(strings)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    bucket = refined(np.frombuffer(b"".join(strings), np.uint8), base[own] + k)
    many = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
    d, p, o = d0[own[many]], (p0[own] + k)[many], bucket[many]
    if ((d0[1:] == d0[:-1]) & (p0[1:] < p0[:-1] + n[:-1])).any():
        order = np.lexsort((p, d, o))
    else:  # windows stand in their order
        order = (np.sort(o << 32 | np.arange(len(o))) & 0xFFFFFFFF).astype(np.int64)
    o, d, p = o[order], d[order], p[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], o[1:] != o[:-1]])[: len(o)], np.arange(len(o)), 0))
    again = np.zeros(len(own), bool)
    again[many[order]] = (d != d[head]) | (p != p[head])
    edge = np.diff(np.concatenate([[False], again, [False]]).astype(np.int8))
    breaks = np.zeros(len(own) + 1, bool)
    breaks[np.cumsum(n)[:-1]] = True  # stretches end with their string
    joined = breaks & np.concatenate([[False], again]) & np.concatenate([again, [False]])
    left, right = np.flatnonzero((edge == 1) | joined), np.flatnonzero((edge == -1) | joined)
    s = own[left]
    return line[s], p0[s] + k[left], p0[s] + k[right - 1] + LENGTH


def by_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, again in batches that hold all of each gram's rows: grams up to SORTED bytes, or one."""
    held, size, last = [], 0, None
    for b in batches:
        gram, ends = b.column("gram").to_numpy(), np.cumsum(pa.compute.binary_length(b.column("bytes")).to_numpy())
        a = 0
        for cut in [*(np.flatnonzero(gram[1:] != gram[:-1]) + 1), len(gram)] if len(gram) else []:
            if size >= SORTED and gram[a] != last:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(b.slice(a, cut - a))
            size, last = size + int(ends[cut - 1] - (ends[a - 1] if a else 0)), gram[a]
            a = cut
    if held:
        yield pa.concat_batches(held)


def _sort(doc: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_gram(batches):
            s, lo, hi = repeats(t.column("bytes").to_pylist(), t.column("nid").to_numpy(), t.column("a").to_numpy())
            cols = {**{c: t.column(c).to_numpy()[s] for c in doc}, "lo": lo, "hi": hi}
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in cols.items()})

    return run


def _bytes(doc: list[str]):
    """The wanted runs' bytes: rows (*who, text, want: list of (deep, gram, a, n))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = {c: b.column(c).to_pylist() for c in doc}
            base = b.column("base").to_pylist() if "base" in b.schema.names else [0] * b.num_rows
            for k, (text, want) in enumerate(zip(b.column("text"), b.column("want").to_pylist(), strict=True)):
                raw, cols = text.as_py() or b"", {"deep": pa.array([w["deep"] for w in want], pa.bool_()), "gram": pa.array([w["gram"] for w in want], pa.int64())}
                cols |= {c: pa.array([x[k]] * len(want), pa.int64()) for c, x in ids.items()} | {"a": pa.array([w["a"] for w in want], pa.int64())}
                cols["bytes"] = pa.array([raw[w["a"] - base[k] : w["a"] - base[k] + w["n"] + LENGTH - 1] for w in want], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _windows(doc: list[str]):
    """Each window of rows (*doc, a, bytes) under two fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, raw in enumerate(b.column("bytes").to_pylist()):
                at = np.arange(len(raw) - LENGTH + 1)
                w0, w1 = fingerprints(np.frombuffer(raw, np.uint8), at, at + LENGTH)
                cols = {"w0": w0.view(np.int64), "w1": w1.view(np.int64), **{c: np.full(len(at), b.column(c)[k].as_py()) for c in doc}, "a": b.column("a")[k].as_py() + at}
                yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in cols.items()})

    return run


def copied(spark: SparkSession, rows: DataFrame, doc: list[str]) -> DataFrame:
    """(*doc, size) of texts that an earlier document has as a whole."""
    text_of = rows.select(*doc, F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size")).where(F.col("size") >= LENGTH)
    first = written(spark, text_of.groupBy("sha").agg(F.min("nid").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "firsts")
    return written(spark, text_of.join(first, "sha").where("nid > first").select(*doc, "size"), "copies")  # alone, so that a text of many copies can be split


def spans(spark: SparkSession, rows: DataFrame, who: list[str], split: int = SPLIT, level: int = 0) -> DataFrame:
    """(*doc, lo, hi): stretches of bytes to remove, overlaps and all. rows: (*who, key, text as bytes); doc is who
    without base, where a row's bytes start in its document."""
    doc = [c for c in who if c != "base"]
    grams = rows.mapInArrow(_runs(level, who, False), longs("gram", "at")).groupBy("gram").agg(F.count("*").alias("runs"), F.max(F.col("at").bitwiseAND(1)).alias("twice"))
    named = written(spark, grams.where("runs > 1 or twice = 1").select("gram"), "grams")
    release(spark)
    found = rows.mapInArrow(_runs(level, who, True), longs("gram", "same0", "same1", *who, "at"))
    met = written(spark, found.join(named, "gram", "left_semi"), "runs")
    forget(spark, named)
    release(spark)
    copies = copied(spark, rows, doc) if level == 0 else None
    if copies is not None:
        some = written(spark, met.join(copies.select(*doc), doc, "left_anti"), "runs")
        forget(spark, met)
        met = some
        release(spark)
    a, n, same = F.shiftright("at", 12), F.shiftright("at", 1).bitwiseAND(2047), ["gram", "same0", "same1", "n"]
    first = F.struct("nid", a.alias("a"), *[c for c in who if c != "nid"])
    kinds = met.withColumn("n", n).groupBy(*same).agg(F.min(first).alias("first"), F.count("*").alias("size"), F.max(F.col("at").bitwiseAND(1)).alias("twice"))
    kinds = written(spark, kinds, "classes")
    whole = met.withColumns({"a": a, "n": n}).join(kinds.where("size > 1").select(*same, "first"), same).where("nid <> first.nid or a <> first.a")
    out = written(spark, whole.select(*doc, F.col("a").alias("lo"), (F.col("a") + F.col("n") + LENGTH - 1).alias("hi")), "spans")
    if copies is not None:
        out = out.union(copies.select(*doc, F.lit(0).cast("long"), F.col("size").cast("long")))
    forget(spark, met)
    release(spark)
    rivals = kinds.groupBy("gram").agg(F.count("*").alias("classes"), F.max("twice").alias("twice")).where("classes > 1 or twice = 1")
    want = kinds.select("gram", "n", "first").join(rivals, "gram").select((F.col("classes") > (split if level < LEVELS else LAST * split)).alias("deep"), "gram", "n", "first.*")
    want = written(spark, want.groupBy(*who).agg(F.collect_list(F.struct("deep", "gram", "a", "n")).alias("want")), "wanted")  # of one text
    forget(spark, kinds)
    deeper = not want.where(F.exists("want", lambda w: w["deep"])).isEmpty()
    strings = rows.join(want, who).mapInArrow(_bytes(doc), "deep boolean, " + longs("gram", *doc, "a") + ", bytes binary")
    if deeper:
        strings = written(spark, strings, "strings")
    out = out.union(written(spark, strings.where("not deep").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort(doc), longs(*doc, "lo", "hi")), "spans"))
    release(spark)
    if not deeper:
        return out
    if level < LEVELS:
        below = written(spark, strings.where("deep").select(*doc, F.col("a").alias("base"), F.col("gram").alias("key"), F.col("bytes").alias("text")), "buckets")
        return out.union(spans(spark, below, [*doc, "base"], split, level + 1))
    windows = written(spark, strings.where("deep").mapInArrow(_windows(doc), longs("w0", "w1", *doc, "a")), "windows")
    first = windows.groupBy("w0", "w1").agg(F.min(F.struct("nid", "a")).alias("first"), F.count("*").alias("n")).where("n > 1").select("w0", "w1", "first")
    first = written(spark, first, "firsts")  # so that the join stands alone, and a window of very many rows can be split
    again = windows.join(first, ["w0", "w1"]).where("nid <> first.nid or a <> first.a")
    return out.union(again.select(*doc, "a", F.col("a") + LENGTH))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            raw, gone = (text.as_py() or "").encode(), merged(spans)
            ends = [0, *(x for s in gone for x in s), len(raw)]
            kept = hashlib.sha256(b"".join(raw[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
            out.append((len(raw), sum(y - x for x, y in gone), len(gone), kept.hexdigest(), [{"lo": x, "hi": y} for x, y in gone]))
        cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))))]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def deduplicated(spark: SparkSession, docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row of docs (doc_id, text)."""
    ship(spark)
    total, ids = docs.agg(F.count("*"), F.countDistinct(F.coalesce("doc_id", F.lit(NO_ID)))).first()
    doc = ["nid"] if total == ids else ["nid", "tid"]  # tid tells apart texts under one id
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("nid"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    gone = spans(spark, rows.select(*doc, F.lit(0).cast("long").alias("key"), F.col("text").cast("binary").alias("text")), doc, split)
    gone = gone.groupBy(*doc).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return rows.join(gone, doc, "left").select(F.nullif("nid", F.lit(NO_ID)).alias("doc_id"), "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
