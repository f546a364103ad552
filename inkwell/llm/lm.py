"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Words are 64-bit fingerprints of their bytes; the word table keeps a second one beside each, which a lookup must meet
too, so that what is counted by word (c, N, V and the base score) rests on 128 bits. A history is a fingerprint of its
words, and an n-gram a 64-bit key whose top comes from the history (from the n-gram, if the history's last word is more
frequent than a quarter of a shard's share, so that no shard holds one hot word's continuations alone).

For a model of some order the n-grams of that order are counted in the texts, dealt by key. Each shard writes its own
and hands on, for the next lower order, how many different n-grams end in each shorter one, and so down to words: one
shuffle an order. What is shuffled is combined per task and packed (sorted, differences, byte planes, zstd). Each
shard's task writes one file of sorted arrays to the shared folder under a temporary name and renames it, so a task run
again after a lost executor leaves the same files. Scoring maps the files (MAPS at a time) and looks up each block's
distinct n-grams in sorted order; no task holds more than a shard.

p_k(w|h) = max(c(hw) - D(c), 0) / c(h) + g(h) p_{k-1}(w|shorter h); p_1 is the like of it over continuation counts of
words, interpolated with 1 / (V + 1), where the one more is for unknown words. c is the count in the texts at the
highest order, below it the number of different words before. Discounts come from counts of counts, order by order. p
sums to 1 for any h.

Defined cases: null and empty texts are one end token; a null doc_id counts as '' for the split; without training
rows N and V are 0, every probability is 1 and base terms are log10(0.1 / 0.1); repeated rows count and score each;
texts are read whole, in blocks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.hashing import U, fingerprints, mixed
from inkwell.llm.shared import forget, release, scratch_path, ship, table, written

ORDER, FOLDS, BLOCK = 2, 10, 1 << 21
MAPS, HELD = 1024, 1 << 20  # files mapped at a time; n-grams combined at a time
END, BEGIN = U(1), U(2)  # ids of words are larger
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
NONE = np.zeros(0, U)


def word_ids(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, second fingerprints and starts of the words in raw."""
    b = LOWER[np.frombuffer(raw, np.uint8)]
    gap = SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    ids, sure = fingerprints(b, start, stop)
    return np.maximum(ids, U(3)), sure, start


def blocks(texts: list[str | None], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Blocks of (word, second fingerprint, histories of 1 to order - 1 words, index of text); every text ends with END.
    A long text comes in several blocks."""

    def block(parts: list[tuple[int, bytes, bool]], last: np.ndarray):
        raw = b"\n".join(p for _, p, _ in parts)
        offset = np.cumsum([0] + [len(p) + 1 for _, p, _ in parts])
        ids, sure, start = word_ids(raw)
        part = np.searchsorted(offset, start, "right") - 1
        n = np.bincount(part, minlength=len(parts))
        ends = np.array([e for _, _, e in parts])
        size = n + ends
        out, check = np.full(size.sum(), END, U), np.full(size.sum(), END, U)
        upto = np.cumsum(size)
        at = np.ones(len(out), bool)
        at[upto[ends] - 1] = False
        out[at], check[at] = ids, sure
        run = np.concatenate([last, out])  # with the words before the block
        past, h, told = np.zeros(len(out), bool), None, []
        for k in range(1, order):
            word = run[order - 1 - k : len(run) - k]
            past |= word == END  # the text before
            word = np.where(past, BEGIN, word)
            h = word if h is None else mixed(h * U(0xD1342543DE82EF95) ^ mixed(word))
            told.append(h)
        return (out, check, told, np.repeat(np.array([k for k, _, _ in parts]), size)), run[len(run) - order + 1 :]

    parts, n, last = [], 0, np.full(order - 1, END, U)
    for k, text in enumerate(texts):
        raw, at = (text or "").encode(), 0
        while True:
            cut = len(raw)
            if cut - at > BLOCK:  # before a gap, so that no word is cut unless it alone is longer
                cut = at + BLOCK
                while cut < len(raw) and not SPACE[raw[cut]]:
                    cut += 1
            parts.append((k, raw[at:cut], cut >= len(raw)))
            n += cut - at
            at = cut
            if n >= BLOCK:
                out, last = block(parts, last)
                yield out
                parts, n = [], 0
            if at >= len(raw):
                break
    if parts:
        yield block(parts, last)[0]


def tokens(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (word, the word before, index of text)."""
    for w, _, h, k in blocks(texts, 2):
        yield w, h[0], k


def planes(x: np.ndarray, width: int = 8) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length in byte planes under zstd: the first, sorted, as differences; of others those that repeat
    large values as places in their sorted distinct values."""
    out = [len(columns[0]).to_bytes(8, "little"), planes(np.diff(columns[0], prepend=U(0)))]
    for c in columns[1:]:
        own, at = np.unique(c, return_inverse=True) if c.dtype == U else ((), None)
        if at is not None and 4 * len(own) < 3 * len(c):
            out += [len(own).to_bytes(8, "little"), planes(np.diff(own, prepend=U(0))), planes(at, 4)]
        else:
            out += [bytes(8), planes(c)]
    return zstandard.compress(b"".join(out), 1)


def unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    raw, upto = zstandard.decompress(blob), 8

    def column(size: int, width: int = 8) -> np.ndarray:
        nonlocal upto
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, width * size, upto).reshape(width, -1).T
        upto += width * size
        return wide.view("<u8").ravel()

    size = int.from_bytes(raw[:8], "little")
    out = [np.cumsum(column(size), dtype=U)]
    for _ in range(1, n):
        many = int.from_bytes(raw[upto : upto + 8], "little")
        upto += 8
        out.append(np.cumsum(column(many), dtype=U)[column(size, 4).astype(np.int64)] if many else column(size))
    return out


def same_as_before(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows repeat the row before."""
    out = np.ones(len(columns[0]), bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


def summed(keys: list[np.ndarray], *values: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of keys, in order, each value summed."""
    order = np.argsort(keys[0], kind="stable")
    cols = [k[order] for k in keys]
    if len(keys) > 1:
        first = same_as_before(cols[0])
        if (first & ~same_as_before(*cols)).any():  # rows of one first key that differ: they need the full order
            order = np.lexsort(keys[::-1])
            cols = [k[order] for k in keys]
    at = np.flatnonzero(~same_as_before(*cols))
    return [*(c[at] for c in cols), *(np.add.reduceat(v[order], at) if len(at) else v for v in values)]


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """By the top 24 bits, in the order of the keys."""
    return ((key >> U(40)) * U(shards) >> U(24)).astype(np.int64)


def by_shard(shard: np.ndarray, shards: int, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Columns in the order of shards, the first in its order within each."""
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    return [(int(s), packed(*(c[cuts[s] : cuts[s + 1]] for c in columns))) for s in np.flatnonzero(np.diff(cuts))]


def places(spark: SparkSession, shards: int) -> list[int]:
    """For each shard a number whose hash deals it to the partition of the shard's number, of as many partitions as there
    are shards: so that a task gets one shard, where hashes of the numbers themselves would bring some together."""
    out: dict[int, int] = {}
    start, step = 0, 16 * shards + 64
    while len(out) < shards:
        ids = spark.range(start, start + step, 1, 1).select(F.col("id").cast("int").alias("id"))
        for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(shards)).alias("p")).agg(F.min("id").alias("id")).collect():
            out.setdefault(r["p"], r["id"])
        start += step
    return [out[k] for k in range(shards)]


def _batch(at: list[int], rows: list[tuple[int, bytes]], kind: int = 0) -> pa.RecordBatch:
    cols = [pa.array([at[s] for s, _ in rows], pa.int32()), pa.array([s for s, _ in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([b for _, b in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["place", "shard", "kind", "blob"])


PACKS = "place int, shard int, kind int, blob binary"


def by_shard_task(packs: DataFrame, at: list[int]) -> DataFrame:
    return packs.repartition(len(at), "place").groupBy("place", "shard")


class Store:
    """Files of named arrays in one folder: memory-mapped where it is local, else read into memory; MAPS at a time."""

    def __init__(self, uri: str):
        self.uri, self.local = uri, urlparse(uri).path if urlparse(uri).scheme in ("", "file") else None
        self.seen: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()

    def put(self, name: str, **arrays: np.ndarray) -> None:
        """A line that tells type, place and length of each array, then the arrays."""
        told, at = {}, 0
        for k, x in arrays.items():
            told[k] = [x.dtype.str, at, len(x)]
            at += -(-x.nbytes // 16) * 16
        line = json.dumps(told).encode()
        line += b" " * (-(len(line) + 1) % 16) + b"\n"

        def fill(f):
            f.write(line)
            for x in arrays.values():
                f.write(np.ascontiguousarray(x).tobytes() + bytes(-x.nbytes % 16))

        if self.local:
            os.makedirs(self.local, exist_ok=True)
            temporary = f"{self.local}/.{name}-{uuid.uuid4().hex}"
            with open(temporary, "wb") as f:
                fill(f)
            os.replace(temporary, f"{self.local}/{name}.arrays")
        else:
            from pyarrow.fs import FileSystem

            fs, path = FileSystem.from_uri(self.uri)
            fs.create_dir(path)
            tag = uuid.uuid4().hex
            with fs.open_output_stream(f"{path}/.{name}-{tag}") as f:
                fill(f)
            fs.move(f"{path}/.{name}-{tag}", f"{path}/{name}.arrays")

    def get(self, name: str) -> dict[str, np.ndarray]:
        """No arrays if there is no such file (a shard that got no rows)."""
        if name in self.seen:
            self.seen.move_to_end(name)
        else:
            self.seen[name] = self._read(name)
            while len(self.seen) > MAPS:
                self.seen.popitem(last=False)
        return self.seen[name]

    def _read(self, name: str) -> dict[str, np.ndarray]:
        if self.local:
            path = f"{self.local}/{name}.arrays"
            if not os.path.exists(path):
                return {}
            raw = np.memmap(path, np.uint8, "r")
        else:
            from pyarrow.fs import FileSystem, FileType

            fs, root = FileSystem.from_uri(self.uri)
            if fs.get_file_info(f"{root}/{name}.arrays").type == FileType.NotFound:
                return {}
            with fs.open_input_stream(f"{root}/{name}.arrays") as f:
                raw = np.frombuffer(f.read(), np.uint8)
        size = 64
        while (line := bytes(raw[:size])).find(b"\n") < 0:
            size *= 2
        start = line.find(b"\n") + 1
        return {k: raw[start + at : start + at + np.dtype(t).itemsize * n].view(t) for k, (t, at, n) in json.loads(line[:start]).items()}

    def find(self, kind: str, shards: int, keys: np.ndarray, names: list[str], sure: np.ndarray | None = None) -> list[np.ndarray]:
        """The values by names of each of the sorted keys, 0 where there is none; sure: what must stand beside the key."""
        out = [np.zeros(len(keys), np.int64) for _ in names]
        cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            own, held = keys[cuts[s] : cuts[s + 1]], self.get(f"{kind}-{s}")
            if len(known := held.get(f"{names[0]}_key", NONE)):
                at = np.searchsorted(known, own)
                live = np.flatnonzero(at < len(known))
                live = live[known[at[live]] == own[live]]
                if sure is not None:
                    want, beside = sure[cuts[s] : cuts[s + 1]], held[f"{names[0]}_sure"]
                    while len(miss := live[beside[at[live]] != want[live]]):  # two words of one id: the next row may be it
                        at[miss] += 1
                        ok = at < len(known)
                        live = live[ok[live]]
                        live = live[known[at[live]] == own[live]]
                for o, name in zip(out, names, strict=True):
                    o[cuts[s] + live] = held[name][at[live]]
        return out


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8 if not len(x) or x.max() < 256 else np.uint32 if x.max() < 1 << 32 else np.int64)


def _count_words(at: list[int]):
    shards = len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(NONE, NONE, np.zeros(0, np.int64))]

        def all_held():
            *keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            return summed(keys, n)

        def packs(rows):
            return _batch(at, by_shard(shard_of(rows[0], shards), shards, *rows))

        for b in batches:
            for w, sure, _, _ in blocks(b.column(0).to_pylist()):
                held.append(summed([w, sure], np.ones(len(w), np.int64)))
                if sum(len(x[0]) for x in held) > 2 * HELD:
                    held = [all_held()]
                    if len(held[0][0]) > HELD:
                        yield packs(held.pop())
                        held = [(NONE, NONE, np.zeros(0, np.int64))]
        yield packs(all_held())

    return run


def merged(tbl: pa.Table, n: int) -> list[np.ndarray]:
    parts = [unpacked(b.as_py(), n) for b in tbl.column("blob")]
    return [np.concatenate([p[k] for p in parts]) if parts else NONE for k in range(n)]


def _keep_words(uri: str):
    def run(key, tbl):
        words, sure, n = summed(*(lambda c: ([c[0], c[1]], c[2].astype(np.int64)))(merged(tbl, 3)))
        Store(uri).put(f"word-{key[1].as_py()}", n_key=words, n_sure=sure, n=n)
        return pa.table({"tokens": pa.array([int(n.sum())], pa.int64()), "words": pa.array([len(words)], pa.int64())})

    return run


def gram_keys(h: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Sorted, a history's n-grams lie together, unless it is hot: then they lie anywhere."""
    m = mixed(h * U(0x9E3779B97F4A7C15) ^ mixed(w))
    return np.where(hot, m, (h >> U(40)) << U(40) | m >> U(24))


_stores: dict[str, Store] = {}


def store_of(uri: str) -> Store:
    if uri not in _stores:
        _stores.clear()
        _stores[uri] = Store(uri)
    return _stores[uri]


def hot_words(store: Store, shards: int, words: np.ndarray, limit: float) -> np.ndarray:
    """Whether each word is more frequent than limit (BEGIN, like END, opens every text)."""
    ids, back = np.unique(np.where(words == BEGIN, END, words), return_inverse=True)
    return (store.find("word", shards, ids, ["n"])[0] > limit)[back]


def combined(key: np.ndarray, columns: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(~same_as_before(key))
    return [key[at], *(c[order][at] for c in columns), np.add.reduceat(n[order], at) if len(at) else n]


def dealt(places: list[int], key: np.ndarray, columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
    """Rows for their shards, without the key, which follows from the rest, in the order of the longest history."""
    shards = len(places)
    shard = shard_of(key, shards)
    order = np.lexsort((columns[-1], columns[0], shard))
    return _batch(places, by_shard(shard[order], shards, *(c[order] for c in columns), n[order]))


def _count_grams(uri: str, places: list[int], limit: float, order: int):
    """N-grams of the texts as (histories, longest first, word, count)."""
    shards = len(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, none = store_of(uri), [*[NONE] * (order + 1), np.zeros(0, np.int64)]
        held = [none]

        def all_held():
            key, *columns, n = (np.concatenate(x) for x in zip(*held, strict=True))
            return combined(key, columns, n)

        for b in batches:
            for w, _, h, _ in blocks(b.column(0).to_pylist(), order):
                key = gram_keys(h[-1], w, hot_words(store, shards, h[0], limit))
                held.append(combined(key, [*h[::-1], w], np.ones(len(w), np.int64)))
                if sum(len(x[0]) for x in held) > 2 * HELD:
                    held = [all_held()]
                    if len(held[0][0]) > HELD:
                        key, *columns, n = held.pop()
                        yield dealt(places, key, columns, n)
                        held = [none]
        key, *columns, n = all_held()
        yield dealt(places, key, columns, n)

    return run


def stats_of(n: np.ndarray) -> list[np.ndarray]:
    return [n, *((n == k).astype(np.int64) for k in (1, 2)), (n >= 3).astype(np.int64)]


STATS = ["total", "one", "two", "more"]


def _keep_grams(uri: str, places: list[int], limit: float, order: int):
    """Writes the shard's n-grams and its own histories; hands on what the next lower order counts (kind 0) and the parts
    of hot histories (kind 1)."""
    shards = len(places)

    def run(key, tbl):
        s, store = key[1].as_py(), store_of(uri)
        *columns, n = merged(tbl.filter(pa.compute.equal(tbl.column("kind"), 0)), order + 1)
        h, w = columns[:-1], columns[-1]
        hot = hot_words(store, shards, h[-1], limit)
        keys, *columns, hot, n = combined(gram_keys(h[0], w, hot), [*columns, hot], n.astype(np.int64))
        h, w = columns[:-1], columns[-1]
        own = summed([h[0][~hot]], *(x[~hot] for x in stats_of(n)))
        many = n >= 255
        store.put(f"gram{order}-{s}", n_key=keys, n=np.minimum(n, 255).astype(np.uint8), many_key=keys[many], many=n[many], total_key=own[0], **{k: small(x) for k, x in zip(STATS, own[1:], strict=True)})
        seen = [int((n == k).sum()) for k in range(1, 5)]
        rows = []
        if order > 2:  # the word after each shorter history
            lower = combined(gram_keys(h[1], w, hot), columns[1:], np.ones(len(w), np.int64))
            rows.append(dealt(places, lower[0], lower[1:-1], lower[-1]))
        else:
            follow = summed([w], np.ones(len(w), np.int64))
            rows.append(_batch(places, by_shard(shard_of(follow[0], shards), shards, *follow)))
        part = summed([h[0][hot]], *(x[hot] for x in stats_of(n)))
        rows.append(_batch(places, by_shard(shard_of(part[0], shards), shards, *part), 1))
        out = pa.Table.from_batches(rows)
        for k, x in enumerate(seen):  # a shard's counts of counts, once
            out = out.append_column(f"n{k + 1}", pa.array([x if r == 0 else 0 for r in range(len(out))], pa.int64()))
        return out

    return run


def _keep_hot(uri: str, order: int):
    """Sums the parts of hot histories of some order."""

    def run(key, tbl):
        own = summed(*(lambda c: ([c[0]], *(x.astype(np.int64) for x in c[1:])))(merged(tbl, 5)))
        store_of(uri).put(f"hot{order}-{key[1].as_py()}", total_key=own[0], **dict(zip(STATS, own[1:], strict=True)))
        return pa.table({"n": pa.array([len(own[0])], pa.int64())})

    return run


def _keep_follows(uri: str):
    def run(key, tbl):
        words, n = summed(*(lambda c: ([c[0]], c[1].astype(np.int64)))(merged(tbl, 2)))
        store_of(uri).put(f"follow-{key[1].as_py()}", n_key=words, n=n)
        return pa.table({f"f{k}": pa.array([int(x)], pa.int64()) for k, x in enumerate([n.sum(), *((n == k).sum() for k in range(1, 5)), (n >= 3).sum()])})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Chen and Goodman's D for counts 0, 1, 2, 3 and more; where counts of counts are too thin, within (0, count)."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(float(np.clip(x, 0.05 * (k + 1), 0.95 * (k + 1))) for k, x in enumerate(d))])


class Model:
    def __init__(self, uri: str, shards: int, n_tokens: int, n_words: int, limit: float, seen: dict[int, list[int]], follow: list[int]):
        """seen: counts of counts by order; follow: of words."""
        self.uri, self.shards, self.n, self.v, self.limit, self.order = uri, shards, n_tokens, n_words, limit, max(seen)
        self.d, self.d1 = {k: discounts(*x) for k, x in seen.items()}, discounts(*follow[1:5])
        self.follows = follow[0]
        self.spare1 = (self.d1[1] * follow[1] + self.d1[2] * follow[2] + self.d1[3] * follow[5]) / max(1, follow[0])

    def lower(self, c: np.ndarray) -> np.ndarray:
        """p1 of words with c continuations."""
        if not self.follows:
            return np.ones(len(c))
        return (c - self.d1[np.minimum(c, 3)]) / self.follows + self.spare1 / (self.v + 1)

    def block(self, w: np.ndarray, h: np.ndarray | list[np.ndarray], sure: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of each word, base log10, model log10), given histories of 1 to order - 1 words."""
        store, s = store_of(self.uri), self.shards
        h = [h] if isinstance(h, np.ndarray) else h
        words, back = np.unique(w, return_inverse=True)
        beside = np.zeros(len(words), U)
        if sure is not None:
            beside[back] = sure
        if sure is None or (beside[back] == sure).all():
            count = store.find("word", s, words, ["n"], None if sure is None else beside)[0][back]
        else:  # two words of one id in this block
            line = np.argsort(w, kind="stable")
            count = np.empty(len(w), np.int64)
            count[line] = store.find("word", s, w[line], ["n"], sure[line])[0]
        p = self.lower(store.find("follow", s, words, ["n"])[0])[back]
        base = np.log10((count + 0.1) / (self.n + 0.1 * (self.v + 1)))
        before, bback = np.unique(h[0], return_inverse=True)
        hot_before = hot_words(store, s, before, self.limit)
        hot = hot_before[bback]
        for k in range(2, self.order + 1):
            past, at, hback = (before, None, bback) if k == 2 else np.unique(h[k - 2], return_index=True, return_inverse=True)
            own, d = hot_before if k == 2 else hot[at], self.d[k]
            # histories lie in the shard of their n-grams: the top 24 bits of a key are the history's
            stats = np.array(store.find(f"gram{k}", s, past, STATS), float)
            if own.any():
                stats[:, own] = np.array(store.find(f"hot{k}", s, past[own], STATS))
            total = stats[0]
            spare = np.where(total > 0, d[1:] @ stats[1:] / np.maximum(total, 1), 1.0)[hback]
            total = total[hback]
            keys, kback = np.unique(gram_keys(h[k - 2], w, hot), return_inverse=True)
            c = store.find(f"gram{k}", s, keys, ["n"])[0]
            big = c == 255
            if big.any():
                c[big] = store.find(f"gram{k}", s, keys[big], ["many"])[0]
            c = c[kback]
            p = np.where(total > 0, (c - d[np.minimum(c, 3)]) / np.maximum(total, 1), 0.0) + spare * p
        return count, base, np.log10(p)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def trained(spark: SparkSession, train: DataFrame, order: int = ORDER) -> Model:
    """The model of all texts of train."""
    if order < 2:
        raise ValueError("an interpolated model has order 2 at least")
    ship(spark)
    uri = scratch_path(spark, "lm")
    shards = max(4, 2 * train.rdd.getNumPartitions())
    texts, at = train.select("text"), places(spark, shards)
    rows = by_shard_task(texts.mapInArrow(_count_words(at), PACKS), at).applyInArrow(_keep_words(uri), "tokens long, words long")
    n, v = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    limit, seen, used = n / (4 * shards), {}, []
    packs = texts.mapInArrow(_count_grams(uri, at, limit, order), PACKS)
    for k in range(order, 1, -1):
        packs = written(spark, by_shard_task(packs, at).applyInArrow(_keep_grams(uri, at, limit, k), PACKS + ", n1 long, n2 long, n3 long, n4 long"), "lm-counts")
        used.append(packs)
        release(spark)  # the shuffle of the order above
        seen[k] = [x or 0 for x in packs.agg(*[F.sum(f"n{i}") for i in range(1, 5)]).first()]
        by_shard_task(packs.where("kind = 1"), at).applyInArrow(_keep_hot(uri, k), "n long").agg(F.sum("n")).first()
        packs = packs.where("kind = 0").select("place", "shard", "kind", "blob")
    found = by_shard_task(packs, at).applyInArrow(_keep_follows(uri), ", ".join(f"f{k} long" for k in range(6)))
    follow = [x or 0 for x in found.agg(*[F.sum(f"f{k}") for k in range(6)]).first()]
    forget(spark, *used)
    return Model(uri, shards, n, v, limit, seen, follow)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            size = b.num_rows
            out = np.zeros((4, size))
            for w, sure, h, k in blocks(b.column(2).to_pylist(), m.order):
                if len(w):
                    count, base, score = m.block(w, h, sure)
                    for row, x in zip(out, (None, (count > 0).astype(float), base, score), strict=True):
                        row += np.bincount(k, x, size)
            cols = [b.column(0), b.column(1), pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(np.full(size, m.n)), pa.array(out[2]), pa.array(out[3])]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORES.split(", ")])

    return run


def scored(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs: (doc_id, held_out, text)."""
    return docs.mapInArrow(_score(spark.sparkContext.broadcast(model)), SCORES)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return scored(spark, docs, trained(spark, docs.where(~F.col("held_out"))))
