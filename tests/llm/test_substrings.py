"""Removed bytes against a table of all 100-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from inkwell.llm import substrings

from .conftest import documents, odd_rows, prose

L = substrings.LENGTH


def expected(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by the definition; null ids come last."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first = {}
    for k in order:
        d, raw = (rows[k][0] is None, rows[k][0] or 0), (rows[k][1] or "").encode()
        for a in range(len(raw) - L + 1):
            s = raw[a : a + L]
            first[s] = min(first.get(s, (d, a)), (d, a))
    out = []
    for d_, text, *_ in rows:
        d, raw = (d_ is None, d_ or 0), (text or "").encode()
        gone = np.zeros(len(raw) + 1, np.int64)
        for a in range(len(raw) - L + 1):
            if first[raw[a : a + L]] < (d, a):
                gone[a] += 1
                gone[a + L] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((d_, len(raw), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, folder, clash):
    rows = odd_rows()
    assert got(substrings.op3_suffix_dedup(spark, folder(clash, documents=documents(rows)))) == expected(rows)


def passages():
    """Shared passages in unlike surroundings, overlapping repeats, periods, near misses, a copy, multi-byte text."""
    r = random.Random(3)
    shared = [prose(k, 40, 300) for k in range(4)]
    rows = []
    for k in range(40):
        parts = [prose(1000 + k, 30, 300), r.choice(shared), prose(2000 + k, 25, 300), r.choice(shared)[r.randrange(60) :]]
        rows.append((k * 3, " ".join(parts)))
    rows += [(200, "ab" * 300), (201, "z" + "ab" * 300), (202, "abc" * 200), (203, shared[0][:99]), (204, shared[0][:100]), (205, "é" * 120), (206, "xé" + "é" * 120), (207, rows[0][1]), (208, shared[1] + shared[1])]
    r.shuffle(rows)
    return rows


def test_passages(spark, folder):
    rows = passages()
    assert got(substrings.op3_suffix_dedup(spark, folder(documents=documents(rows)))) == expected(rows)


@pytest.mark.parametrize("hot,last", [(1, 1), (3, 16)])
def test_hot_grams(spark, folder, hot, last, monkeypatch):
    """Buckets over the limit are refined before they are dealt, at last by window."""
    monkeypatch.setattr(substrings, "LAST", last)
    rows = passages()
    d = folder(documents=documents(rows))
    assert got(substrings.deduplicated(spark, spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), hot)) == expected(rows)


def test_real_rows(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(substrings.op3_suffix_dedup(spark, sf_dir)) == expected(rows)


def test_empty_table(spark, folder):
    assert substrings.op3_suffix_dedup(spark, folder(documents=documents([]))).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 300)
    monkeypatch.setattr(substrings, "CHUNK", 700)
    raw = prose(9, 500).encode()
    chunks = list(substrings.cut_up(iter([(0, raw), (1, b"short"), (2, raw[:150])])))
    starts = sorted((k, o + i) for c in chunks for k, o, p in c for i in range(len(p) - L + 1))
    assert starts == [(0, i) for i in range(len(raw) - L + 1)] + [(2, i) for i in range(51)]


def test_refined_buckets():
    r = np.random.default_rng(0)
    b = r.integers(97, 99, 3_000).astype(np.uint8)
    b[1000:1400] = b[100:500]
    windows = np.arange(len(b) - L + 1)
    bucket = substrings.refined(b, windows)
    groups = {}
    for a, x in zip(windows, bucket, strict=True):
        groups.setdefault(b[a : a + L].tobytes(), set()).add(int(x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_long_buckets_are_refined_alike():
    """Buffers whose places do not fit into one number take the slower sort, with equal results."""
    r = np.random.default_rng(1)
    b = r.integers(97, 100, 5_000).astype(np.uint8)
    b[3000:3600] = b[100:700]
    windows = np.arange(len(b) - L + 1)
    wide = np.concatenate([b, r.integers(0, 256, 1 << 21).astype(np.uint8)])
    groups = lambda x: len(set(x.tolist()))
    a, c = substrings.refined(b, windows), substrings.refined(wide, windows)
    assert groups(a) == groups(c) == len(set(zip(a.tolist(), c.tolist(), strict=True)))


def test_texts_built_against_hashes(spark, folder):
    """A Thue-Morse word and its complement agree under polynomial hashes modulo 2**64."""
    tm = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    other = tm.translate(str.maketrans("ab", "ba"))
    pre, post = prose(1, 60), prose(2, 60)
    rows = [(1, pre + tm + post), (2, pre + other + post), (3, tm + other), (4, "x" + other)]
    assert got(substrings.op3_suffix_dedup(spark, folder(documents=documents(rows)))) == expected(rows)


def test_one_gram_in_very_many_texts(spark, folder):
    """One passage with other numbers in 900 texts: over SPLIT classes of its grams."""
    r = random.Random(5)
    rows = [(k, f"{prose(k, 12, 200)} Terms of order {r.randrange(10**6):06d} apply to all the goods in the list below and to their carriage, see overleaf for the whole text of {r.randrange(400)} pages. {prose(k + 5_000, 12, 200)}") for k in range(900)]
    assert got(substrings.op3_suffix_dedup(spark, folder(documents=documents(rows)))) == expected(rows)


def keyed(texts, level):
    """The gram of each window, by its text and place; runs with equal windows must be marked."""
    out = {}
    for chunk in substrings.cut_up(iter(enumerate(texts))):
        for piece, gram, a, n, twice in zip(*substrings.runs([(o, p) for _, o, p in chunk], level, False), strict=True):
            k = chunk[piece][0]
            assert twice or len({texts[k][i : i + L] for i in range(a, a + n)}) == n
            for i in range(a, a + n):
                assert (k, i) not in out
                out[k, i] = int(gram)
    return out


@pytest.mark.parametrize("level", [0, 2])
@pytest.mark.parametrize("size", [700, 1 << 18])
def test_equal_windows_meet(level, size, monkeypatch):
    """Equal windows name the same gram, also in other chunks."""
    monkeypatch.setattr(substrings, "PIECE", size // 2)
    monkeypatch.setattr(substrings, "CHUNK", size)
    r = random.Random(4)
    some = lambda n, letters: "".join(r.choice(letters) for _ in range(n)).encode()
    base = some(600, "ab")
    texts = [some(900, "ab") + base + some(300, "abc"), b"x" * 1500, b"ab" * 700 + base, some(100, "abc"), some(60, "abcd") * 20, some(93, "pq") * 12 + base, base[100:400], b"short", some(7, "abc") * 99]
    met = keyed(texts, level)
    assert set(met) == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - L + 1)}
    grams = {}
    for (k, i), gram in met.items():
        assert grams.setdefault(texts[k][i : i + L], gram) == gram


def test_shared_phrases_do_not_meet():
    """Texts that share phrases of 40 bytes, but no window, are not dealt to be sorted."""
    r = random.Random(6)
    phrases = ["".join(r.choice("abcdefghijklmnop ") for _ in range(40)) for _ in range(300)]
    texts = ["".join(r.choice(phrases) for _ in range(40)).encode() for _ in range(100)]
    windows = [t[k : k + L] for t in texts for k in range(len(t) - L + 1)]
    assert len(windows) - len(set(windows)) < len(windows) / 100
    _, gram, *_ = substrings.runs([(0, t) for t in texts], 0, False)
    _, size = np.unique(gram, return_counts=True)
    assert size[size > 1].sum() < 0.3 * len(gram)
