"""Fingerprints and components against all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkwell.llm import simhash
from inkwell.llm.shared import components

from .conftest import documents, odd_rows, prose


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """prints: list of (key, fingerprint); the index of each one's component by links of 2 bits at most."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


def expected(rows):
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    of = classes(prints)
    least = {}
    for (k, _), c in zip(prints, of, strict=True):
        if k is not None:
            least[c] = min(k, least.get(c, k))
    return sorted(((k, f"{fp:016x}", least.get(c)) for (k, fp), c in zip(prints, of, strict=True)), key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, folder, clash):
    rows = odd_rows()
    got = simhash.op1_simhash_near_dedup(spark, folder(clash, documents=documents(rows))).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == expected(rows)


def test_real_rows(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = simhash.op1_simhash_near_dedup(spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == expected(rows)


def test_empty_table(spark, folder):
    assert simhash.op1_simhash_near_dedup(spark, folder(documents=documents([]))).count() == 0


@pytest.mark.parametrize("hot", [2, 5, 10_000])
def test_links_hot_and_cold(spark, hot):
    """Crowded blocks take the other way to the same links."""
    rng = np.random.default_rng(0)
    seeds = rng.integers(0, 2**63, 12)
    fps = {0, 2**64 - 1}
    for s in seeds:
        for _ in range(12):
            x = int(s)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(spark, simhash.links(spark, df, hot)).collect()}
    of = classes(list(zip(signed, fps, strict=True)))
    groups, mine = {}, {}
    for x, c in zip(signed, of, strict=True):
        groups.setdefault(c, set()).add(x)
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_path_and_a_star(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1100).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    got = components(spark, path.union(star)).collect()
    assert len({r["root"] for r in got if r["node"] < 1000}) == 1 and len({r["root"] for r in got if r["node"] >= 1000}) == 1
    assert len(got) == 201 + 100


def test_stage_keeps_one_of_each(spark, folder):
    rows = odd_rows()
    d = folder(True, documents=documents(rows))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = simhash.stage_simhash(spark, docs, d)
    assert out.columns == docs.columns
    kept = out.collect()
    assert len(kept) == len(set(classes([(r[0], fingerprint(r[1])) for r in rows])))
    ids = [r for r in rows if r[0] is not None and r[0] < 14]
    d = folder(documents=documents(ids))
    kept = sorted(r["doc_id"] for r in simhash.stage_simhash(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect())
    assert kept == sorted({e[2] for e in expected(ids)})


def test_prose_is_left_alone(spark, folder):
    rows = [(k, prose(k + 100, 150, 2_000)) for k in range(40)]
    got = simhash.op1_simhash_near_dedup(spark, folder(documents=documents(rows))).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)


def test_links_do_not_depend_on_hot(spark):
    """Dense clusters of fingerprints: pairs alone, stars alone and both give the same pairs within two links' reach,
    the same components, and no link of over 2 bits but within a star of one centre."""
    r = np.random.default_rng(9)
    base = r.integers(-(2**62), 2**62, 12)
    flip = lambda x, n: int(np.bitwise_xor.reduce([np.int64(x), *(np.int64(1) << np.int64(b) for b in r.choice(62, n, replace=False))]))
    prints = sorted({flip(b, int(n)) for b in base for n in r.integers(0, 3, 70)} | {int(x) for x in r.integers(-(2**62), 2**62, 200)})
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    near = {(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}

    def closed(pairs):
        top = {x: x for x in prints}

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in pairs:
            top[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in prints}

    for hot in (0, 32, 10**9):
        got = {tuple(sorted(p)) for p in map(tuple, simhash.links(spark, df, hot).select("a", "b").collect())}
        assert got <= near and closed(got) == closed(near)
        if hot == 10**9:
            assert got == near
