"""Scores against a model counted with dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkwell.llm import lm

from .conftest import documents, odd_rows, prose

END, BEGIN = object(), object()


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def discount(counts):
    n = [sum(1 for c in counts if c == k) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    d = [min(max(x, 0.05 * (k + 1)), 0.95 * (k + 1)) for k, x in enumerate(d)]
    return lambda c: 0 if c == 0 else d[min(c, 3) - 1]


class Brute:
    def __init__(self, texts):
        tokens = [words(t) for t in texts]
        self.uni = Counter(w for t in tokens for w in t)
        self.bi = Counter(p for t in tokens for p in zip([BEGIN, *t], t, strict=False))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.after = defaultdict(list)
        for (h, _), c in self.bi.items():
            self.after[h].append(c)
        self.follow = Counter(w for _, w in self.bi)
        self.d2, self.d1 = discount(list(self.bi.values())), discount(list(self.follow.values()))
        self.spare = sum(map(self.d1, self.follow.values()))
        self.past = {h: (sum(counts), sum(map(self.d2, counts))) for h, counts in self.after.items()}

    def p(self, h, w):
        types = len(self.bi)
        p1 = (self.follow[w] - self.d1(self.follow[w])) / types + self.spare / types / (self.v + 1) if types else 1.0
        total, spare = self.past.get(h, (0, 0))
        if not total:
            return p1
        c = self.bi[h, w]
        return (c - self.d2(c)) / total + spare / total * p1

    def row(self, text):
        t = words(text)
        base = sum(math.log10((self.uni[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t)
        return len(t), sum(self.uni[w] > 0 for w in t), self.n, base, sum(math.log10(self.p(h, w)) for h, w in zip([BEGIN, *t], t, strict=False))


def held_out(doc_id):
    return zlib.crc32((str(doc_id) if doc_id is not None else "").encode()) % 10 == 0


def check(spark, d, rows):
    model = Brute([r[1] for r in rows if not held_out(r[0])])
    got = sorted(map(tuple, lm.op7_lm_scores(spark, d).collect()), key=lambda r: (repr(r[0]), r[2], r[6]))
    want = sorted(((r[0], held_out(r[0]), *model.row(r[1])) for r in rows), key=lambda r: (repr(r[0]), r[2], r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9, abs=1e-9)
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], rel=1e-8, abs=1e-8)


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, folder, clash):
    rows = odd_rows() + [(30 + k, prose(k, 300, 150)) for k in range(40)] + [(80, "the " * 900), (81, "the cat the dog " * 300)]
    check(spark, folder(clash, documents=documents(rows)), rows)


def test_real_rows(spark, sf_dir):
    check(spark, sf_dir, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_no_training_rows(spark, folder):
    only = next(k for k in range(1000) if held_out(k))
    rows = [(only, "some words here"), (only, None)]
    got = lm.op7_lm_scores(spark, folder(documents=documents(rows))).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), r["score"]) for r in got) == [(1, 0, 0, 0.0, 0.0), (4, 0, 0, 0.0, 0.0)]


def test_empty_table(spark, folder):
    assert lm.op7_lm_scores(spark, folder(documents=documents([]))).count() == 0


def test_probabilities_sum_to_one(spark):
    texts = [prose(k, 200, 60) for k in range(12)] + ["the " * 500]
    m = lm.trained(spark, spark.createDataFrame([(t,) for t in texts], "text string"))
    vocabulary = np.unique(np.concatenate([w for w, _, _ in lm.tokens(texts)]))
    for h in [lm.BEGIN, *vocabulary[:9], lm.U(12345)]:
        w = np.concatenate([vocabulary, [lm.U(999_999)]])  # one word stands for all unknown ones
        _, _, p = m.block(w, np.full(len(w), h))
        assert (10**p).sum() == pytest.approx(1, abs=1e-9)


def test_long_texts_come_in_blocks(monkeypatch):
    text = prose(4, 3_000, 500)
    whole = [np.concatenate(x) for x in zip(*lm.tokens(["a", text, None, text]), strict=True)]
    monkeypatch.setattr(lm, "BLOCK", 100)
    parts = [np.concatenate(x) for x in zip(*lm.tokens(["a", text, None, text]), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and (whole[0] == lm.END).sum() == 4


class BruteN:
    """Any order, on tuples."""

    def __init__(self, texts, order):
        self.order, tokens = order, [words(t) for t in texts]
        self.grams = {order: Counter(g for t in tokens for g in self.runs(t))}
        for k in range(order - 1, 0, -1):
            self.grams[k] = Counter(g[1:] for g in self.grams[k + 1])
        self.v = len({w for t in tokens for w in t})
        self.d = {k: discount(list(c.values())) for k, c in self.grams.items()}
        self.after = {k: defaultdict(list) for k in range(2, order + 1)}
        for k, after in self.after.items():
            for g, c in self.grams[k].items():
                after[g[:-1]].append(c)

    def runs(self, t):
        full = [BEGIN] * (self.order - 1) + t
        return zip(*[full[k : k + len(t)] for k in range(self.order)], strict=True)

    def p(self, gram):
        total, d1 = sum(self.grams[1].values()), self.d[1]
        c = self.grams[1][gram[-1:]]
        p = (c - d1(c)) / total + sum(map(d1, self.grams[1].values())) / total / (self.v + 1)
        for k in range(2, self.order + 1):
            g, d = gram[-k:], self.d[k]
            counts = self.after[k][g[:-1]]
            if counts:
                c = self.grams[k][g]
                p = (c - d(c)) / sum(counts) + sum(map(d, counts)) / sum(counts) * p
        return p

    def score(self, text):
        return sum(math.log10(self.p(g)) for g in self.runs(words(text)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_higher_orders(spark, order):
    rows = odd_rows()[:8] + [(30 + k, prose(k, 300, 60)) for k in range(40)] + [(80, "the " * 900), (81, "the cat the dog " * 300), (82, "a b the"), (83, "a b the cat")]
    model = BruteN([r[1] for r in rows if not held_out(r[0])], order)
    docs = spark.createDataFrame([(r[0], held_out(r[0]), r[1]) for r in rows], "doc_id long, held_out boolean, text string").repartition(3)
    trained = lm.trained(spark, docs.where("not held_out"), order)
    got = {r["doc_id"]: r["score"] for r in lm.scored(spark, docs, trained).collect()}
    assert got == {r[0]: pytest.approx(model.score(r[1]), rel=1e-8, abs=1e-8) for r in rows}
    if order == 2:
        other = Brute([r[1] for r in rows if not held_out(r[0])])
        assert model.score(rows[9][1]) == pytest.approx(other.row(rows[9][1])[4])


def test_order_three_sums_to_one(spark):
    texts = [prose(k, 200, 60) for k in range(12)] + ["the " * 500]
    m = lm.trained(spark, spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    found = [(w, h) for w, _, h, _ in lm.blocks(texts, 3)]
    vocabulary = np.unique(np.concatenate([w for w, _ in found]))
    w = np.concatenate([vocabulary, [lm.U(999_999)]])
    for at in (0, 5, 900):
        _, _, p = m.block(w, [np.full(len(w), h[at]) for h in found[0][1]])
        assert (10**p).sum() == pytest.approx(1, abs=1e-9)


def test_words_built_against_hashes(spark, folder):
    """A Thue-Morse word and its complement agree under polynomial hashes modulo 2**64."""
    tm = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    other = tm.translate(str.maketrans("ab", "ba"))
    rows = [(k, f"{tm} x {tm}") for k in range(1, 5)] + [(k, f"{other} y") for k in range(5, 7)]
    check(spark, folder(documents=documents(rows)), rows)


def test_two_words_of_one_id(tmp_path):
    """The second fingerprint tells them apart, in counting and in lookups."""
    ids, sure = np.array([7, 9, 9, 9, 12], lm.U), np.array([1, 5, 3, 5, 8], lm.U)
    keys, beside, n = lm.summed([ids, sure], np.ones(5, np.int64))
    assert list(zip(keys.tolist(), beside.tolist(), n.tolist(), strict=True)) == [(7, 1, 1), (9, 3, 1), (9, 5, 2), (12, 8, 1)]
    store = lm.Store(str(tmp_path))
    store.put("word-0", n_key=keys, n_sure=beside, n=n)
    ask = np.array([5, 7, 9, 9, 9, 12, 13], lm.U), np.array([0, 1, 3, 4, 5, 9, 0], lm.U)
    assert store.find("word", 1, ask[0], ["n"], ask[1])[0].tolist() == [0, 1, 1, 0, 2, 0, 0]


def test_many_shards_with_few_maps(tmp_path, monkeypatch):
    """10,000 shards: lookups keep MAPS files mapped, wherever keys lie."""
    monkeypatch.setattr(lm, "MAPS", 16)
    shards, store = 10_000, lm.Store(str(tmp_path))
    keys = np.sort(np.random.default_rng(0).integers(3, 2**64, 30_000, dtype=np.uint64))
    cuts = np.searchsorted(lm.shard_of(keys, shards), np.arange(shards + 1))
    for s in range(shards):
        if cuts[s] < cuts[s + 1]:
            store.put(f"word-{s}", n_key=keys[cuts[s] : cuts[s + 1]], n=np.arange(cuts[s], cuts[s + 1]))
    ask = np.sort(np.concatenate([keys[::3], keys[::3] + lm.U(1)]))
    got = store.find("word", shards, ask, ["n"])[0]
    at = np.searchsorted(keys, ask)
    assert (got == np.where(keys[np.minimum(at, len(keys) - 1)] == ask, at, 0)).all() and len(store.seen) <= 16


def test_stores_that_are_not_local(tmp_path, monkeypatch):
    """Through pyarrow's file systems, into memory, with no file of its own."""
    a, b = lm.Store(str(tmp_path)), lm.Store(str(tmp_path))
    b.local, b.uri = None, f"file://{tmp_path}"
    b.put("word-0", n_key=np.array([5, 9], lm.U), n=np.array([2, 3]))
    for s in (a, b):
        assert s.find("word", 1, np.array([5, 6, 9], lm.U), ["n"])[0].tolist() == [2, 0, 3] and s.get("word-1") == {}
    assert isinstance(a.get("word-0")["n"], np.memmap) and len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_packs(n):
    r = np.random.default_rng(n)
    rare, common = (np.sort(r.integers(0, 2**64, n, dtype=np.uint64)), r.choice(r.integers(0, 2**64, 40, dtype=np.uint64), n))
    count = r.integers(1, 2**33, n)
    for got, want in zip(lm.unpacked(lm.packed(rare, common, rare[::-1].copy(), count), 4), (rare, common, rare[::-1], count), strict=True):
        assert (got == want.astype(np.uint64)).all() and len(got) == n
