"""Byte-level BPE encoding and decoding in numpy: length-bucketed padded matrices, one merge a row and round.

Texts are cut at single spaces between two non-space characters (no match of the public pattern crosses such a cut:
every alternative takes at most one leading space, and a lone space before a non-space always opens the next match).
A cut piece seen before comes from a bounded cache; new pieces of a batch are split by the pattern, and their distinct
matches are merged together: matches of like length form a padded matrix of ids, every row merges its leftmost
minimum-rank pair in each round, pair ranks come from an open-addressing hash table, finished rows leave the matrix
and live ones are compacted. A match over LONG bytes is a matrix of one row, whose rounds merge all places of the least
rank at once where these would be the next rounds' merges anyhow (no pair that comes up on the way has a lower rank),
so an endless word takes about as many rounds as it has ranks, not as it has bytes.

Defined cases: null and empty texts give no ids (SHA-256 of nothing); texts of any length are encoded whole; repeated
rows give equal rows; an empty table gives no rows; other columns are ignored. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.shared import ship, table

LONG = 256
CACHE = 200_000
SPACE = regex.compile(r"\s")


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pool = np.frombuffer(b"".join(self.tokens), np.uint8)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._hash(np.array([k for k, _ in pairs], np.uint64), np.array([r for _, r in pairs], np.int64))
        self.new, self.old = {}, {}

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Linear probing over a power of two of slots, a quarter full at most."""
        self.bits = int(np.ceil(np.log2(len(keys) * 4)))
        self.slot_key = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.slot_rank = np.full(1 << self.bits, np.iinfo(np.int64).max)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.slot_key[at[todo]] == np.uint64(2**64 - 1)
            self.slot_key[at[todo[free]]] = keys[todo[free]]  # of those that meet in a slot the last stays
            won = self.slot_key[at[todo]] == keys[todo]
            self.slot_rank[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's union, the largest integer where it has none (ids below 0 are padding)."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(keys)
        found = self.slot_key[at]
        out = self.slot_rank[at]
        miss = np.flatnonzero(found != keys)
        out[miss] = np.iinfo(np.int64).max
        miss = miss[found[miss] != np.uint64(2**64 - 1)]
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[miss]]
            hit = found == keys[miss]
            out[miss[hit]] = self.slot_rank[at[miss[hit]]]
            miss = miss[~hit & (found != np.uint64(2**64 - 1))]
        return out

    def merge_matrix(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words that have like lengths."""
        n = np.array([len(w) for w in words])
        ids = np.full((len(words), n.max()), -1, np.int64)
        ids[np.arange(n.max()) < n[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        out: list = [None] * len(words)
        rows, none = np.arange(len(words)), np.iinfo(np.int64).max
        rank = np.full(ids.shape, none)
        inside = np.arange(ids.shape[1] - 1) < (n - 1)[:, None]
        rank[:, :-1][inside] = self.pair_rank(ids[:, :-1][inside], ids[:, 1:][inside])
        while len(rows):
            j = rank.argmin(1)  # the leftmost of equal ranks
            best = rank[np.arange(len(rows)), j]
            done = best == none
            if done.any():
                for r in np.flatnonzero(done):
                    out[rows[r]] = ids[r, : n[r]].astype("<u4")
                live = ~done
                rows, ids, rank, n, j, best = rows[live], ids[live], rank[live], n[live], j[live], best[live]
                if not len(rows):
                    break
            width, k = n.max(), np.arange(len(rows))
            cols = np.arange(width - 1)
            cols = cols + (cols > j[:, None])  # column j + 1 goes
            ids, rank = np.take_along_axis(ids, cols, 1), np.take_along_axis(rank, cols, 1)
            n = n - 1
            ids[k, j] = best
            rank[k, np.minimum(n, width - 2)] = none
            rank[k, n - 1] = none
            right = j < n - 1
            rank[k[right], j[right]] = self.pair_rank(best[right], ids[k[right], j[right] + 1])
            left = j > 0
            rank[k[left], j[left] - 1] = self.pair_rank(ids[k[left], j[left] - 1], best[left])
        return out

    def merge_row(self, word: bytes) -> np.ndarray:
        """Ids of one long word: all places of the least rank in a round, from the left where they overlap; the leftmost
        alone, if merging it would bring up a pair of lower rank."""
        ids, none = self.byte_id[np.frombuffer(word, np.uint8)], np.iinfo(np.int64).max
        rank = np.append(self.pair_rank(ids[:-1], ids[1:]), none)
        while (best := rank.min()) != none:
            at = np.flatnonzero(rank == best)
            k = np.arange(len(at))
            opens = np.maximum.accumulate(np.where(np.concatenate([[True], at[1:] != at[:-1] + 1]), k, 0))
            at = at[(k - opens) % 2 == 0]
            after = at[at + 2 < len(ids)] + 2
            if (self.pair_rank(np.full(len(after), best), ids[after]) < best).any():
                at = at[:1]
            new = self._merged(ids, rank, at, best)
            if len(at) > 1 and new[2] < best:
                new = self._merged(ids, rank, at[:1], best)
            ids, rank, _ = new
        return ids.astype("<u4")

    def _merged(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and ranks after merging the pairs at these places, and the least of the ranks that are new."""
        none, keep = np.iinfo(np.int64).max, np.ones(len(ids), bool)
        keep[at + 1] = False
        ids, rank = ids[keep], rank[keep]
        at = at - np.arange(len(at))
        ids[at] = best
        near = np.concatenate([at - 1, at])
        near = near[near >= 0]
        rank[near] = none
        near = near[near < len(ids) - 1]
        rank[near] = fresh = self.pair_rank(ids[near], ids[near + 1])
        return ids, rank, int(fresh.min(initial=none))

    def merge(self, words: list[bytes]) -> dict[bytes, bytes]:
        """word -> little-endian ids, for distinct non-empty words."""
        out = {w: self.merge_row(w).tobytes() for w in words if len(w) > LONG}
        rest = sorted((w for w in words if len(w) <= LONG), key=len)
        lengths = np.array([len(w) for w in rest])
        k = 0
        while k < len(rest):
            most = max(4, lengths[k] * 5 // 4)
            upto = min(int(np.searchsorted(lengths, most, "right")), k + max(64, 200_000 // most))
            out.update(zip(rest[k:upto], (x.tobytes() for x in self.merge_matrix(rest[k:upto])), strict=True))
            k = upto
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        split = {p: [m.encode() for m in self.pattern.findall(p)] for p in pieces}
        ids = self.merge(list({m for ms in split.values() for m in ms}))
        return {p: b"".join(map(ids.__getitem__, ms)) for p, ms in split.items()}

    def pieces(self, text: str) -> list[str]:
        """text, cut at its lone spaces; a piece that follows one starts with it."""
        parts = text.split(" ")
        if len(parts) == 1:
            return parts if text else []
        out, whole = [parts[0]], True
        for p in parts[1:]:
            ok = p != "" and not p[0].isspace()
            if ok and whole and out[-1] != "" and not out[-1][-1].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        want = set().union(*cut) if cut else set()
        here, missing = {}, set()
        for p in want:
            if (x := self.new.get(p)) is None and (x := self.old.get(p)) is not None:
                self.new[p] = x
            if x is None:
                missing.add(p)
            else:
                here[p] = x
        learnt = self._learn(missing)
        here |= learnt
        self.new.update((p, x) for p, x in learnt.items() if len(p) <= 32)
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        return [b"".join(map(here.__getitem__, c)) for c in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered in blocks."""
        out = []
        for k in range(0, len(ids), 1 << 18):
            x = ids[k : k + (1 << 18)].astype(np.int64)
            n = self.lengths[x]
            ends = np.cumsum(n)
            out.append(self.pool[np.repeat(self.starts[x] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


_loaded: dict[str, Bpe] = {}


def loaded(name: str) -> Bpe:
    """One encoder a worker process; name is a file of the public tokenizers."""
    if name not in _loaded:
        _loaded[name] = Bpe(public_tokenizers.path(name))
    return _loaded[name]


BATCH_CHARS = 1 << 20


def blocks(texts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Groups of (key, text) of about BATCH_CHARS characters."""
    out, n = [], 0
    for row in texts:
        out.append(row)
        n += len(row[1])
        if n >= BATCH_CHARS:
            yield out
            out, n = [], 0
    if out:
        yield out


def encoder(name: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(name)
        for b in batches:
            rows = zip(b.column(0).to_pylist(), (x or "" for x in b.column(1).to_pylist()), strict=True)
            for group in blocks(rows):
                keys, coded = [k for k, _ in group], bpe.encode_batch([t for _, t in group])
                n = pa.array([len(x) // 4 for x in coded], pa.int64())
                if digest:
                    decoded = bpe.decode(np.frombuffer(b"".join(coded), "<u4")) if any(coded) else b""
                    at, sha = 0, []
                    for x in coded:
                        size = int(bpe.lengths[np.frombuffer(x, "<u4")].sum())
                        sha.append(hashlib.sha256(decoded[at : at + size]).hexdigest())
                        at += size
                    cols = [pa.array(keys, b.column(0).type), n, pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array(sha)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), n, pa.array(coded, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


VOCABULARY = "byte_bpe_50k.tiktoken"


def _decoder(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(name)
        for b in batches:
            for k in range(b.num_rows):  # a row at a time: its text is all that is held
                raw = b.column(1)[k].as_py()
                text = None if raw is None else bpe.decode(np.frombuffer(raw, "<u4"))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([text], pa.binary())], ["doc_id", "bytes"])

    return run


def decoded(spark: SparkSession, coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids): the text's bytes; null ids have none."""
    ship(spark)
    return coded.select("doc_id", "ids").mapInArrow(_decoder(vocabulary), "doc_id long, bytes binary")


def encoded(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    ship(spark)
    return docs.select("doc_id", "text").mapInArrow(encoder(vocabulary, False), "doc_id long, n_tokens long, ids binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(encoder(VOCABULARY, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline's last stage: every row's count and the digests of ids and decoded text; encoded() has the ids."""
    ship(spark)
    return docs.select("doc_id", "text").mapInArrow(encoder(VOCABULARY, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
