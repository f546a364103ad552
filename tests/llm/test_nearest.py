"""Searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import ann

VECTORS = ["vec_id", "embedding", "label"]


def brute(ids, x, queries, k=20):
    """Every row whose id is a query's against every row but itself, by id; ids may repeat."""
    out = {}
    for i in (i for i in range(len(ids)) if ids[i] in set(queries)):
        score = (x * x[i]).sum(1)
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-score[j], ids[j]))[:k]
        out.setdefault(ids[i], []).extend((ids[j], score[j]) for j in order)
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_on_real_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    queries = [i for i in ids if i % 20 == 0]
    want, got = brute(ids, x, queries), found(ann.op9_nearest(spark, sf_dir))
    assert set(got) == set(queries) and all([r for r, *_ in v] == list(range(1, 21)) for v in got.values())
    hits = 0
    for q, v in got.items():
        assert [(a, -s) for _, a, s in v] == sorted(((a, -s) for _, a, s in v), key=lambda z: (z[1], z[0]))
        for _, a, s in v:
            assert s == pytest.approx((x[ids.index(a)] * x[ids.index(q)]).sum(), abs=1e-12)
        hits += len({a for _, a, _ in v} & {a for a, _ in want[q]})
    assert hits / (20 * len(queries)) >= 0.9


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("n", [3, 30])
def test_small_and_odd(spark, folder, clash, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 4)).astype(np.float32)
    x[n // 2 :] = x[0]  # ties
    rows = [{"vec_id": k * 10, "embedding": v.tolist(), "label": 0} for k, v in enumerate(x)]
    bad = [None, [], [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan")] * 4, [float("inf"), 1.0, 1.0, 1.0], [1.0, 2.0]]
    odd = [{"vec_id": 1000 + 20 * k, "embedding": v, "label": None} for k, v in enumerate(bad)] + [{"vec_id": None, "embedding": [1.0] * 4}] + rows[:1]
    got = found(ann.op9_nearest(spark, folder(clash, embeddings=(VECTORS, rows + odd))))
    ids = [r["vec_id"] for r in rows] + [0]  # the first row once more
    want = brute(ids, np.concatenate([x, x[:1]]).astype(float), [i for i in ids if i % 20 == 0])
    in_order = lambda v: sorted((round(-s, 9), a) for a, s in v)
    assert {q: in_order((a, s) for _, a, s in v) for q, v in got.items()} == {q: in_order(v) for q, v in want.items()}
    assert all([r for r, *_ in v] == sorted(list(range(1, min(20, n) + 1)) * (2 if q == 0 else 1)) for q, v in got.items())


def test_empty_tables(spark, folder):
    assert ann.op9_nearest(spark, folder(embeddings=(VECTORS, []))).count() == 0
    assert ann.op9_nearest(spark, folder(embeddings=(VECTORS, [{"vec_id": 20, "embedding": [0.0]}]))).count() == 0
    assert ann.op9_nearest(spark, folder(embeddings=(VECTORS, [{"vec_id": 20, "embedding": [1.0]}]))).count() == 0


def test_one_part_holds_most_rows(spark, folder, monkeypatch):
    """A part over BLOCK rows is cut, and its queries' blocks are merged."""
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 8)), np.tile(rng.normal(size=8), (240, 1))]).astype(np.float32)
    rows = [{"vec_id": k, "embedding": v.tolist()} for k, v in enumerate(x)]
    got = found(ann.op9_nearest(spark, folder(embeddings=(VECTORS, rows))))
    ids = list(range(300))
    want = brute(ids, x.astype(float), [i for i in ids if i % 20 == 0])
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(want)
    hits = sum(len({a for _, a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_partition_is_balanced_and_follows_neighbours():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(100, 16)) * 0.3 for c in centres])
    near = ann.nearest(x, 10)
    part = ann.balanced(x, near, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.03 * 100)
    assert (part[near] == part[:, None]).mean() > 0.6


def test_other_queries_and_k(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 6)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = found(ann.neighbours(spark, df, F.col("vec_id") < 5, k=3))
    want = brute(list(range(50)), x.astype(float), range(5), 3)
    assert {q: [a for _, a, _ in v] for q, v in got.items()} == {q: [a for a, _ in v] for q, v in want.items()}


def test_repeated_ids_are_rows_of_their_own(spark):
    """One id with a third of all rows, some of them alike, is searched and found row by row."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    x[40:50] = x[40]
    ids = list(range(1, 41)) + [100] * 20
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got, want = found(ann.neighbours(spark, df, F.col("vec_id") == 100)), brute(ids, x.astype(float), [100])
    assert sorted((round(s, 9), a) for _, a, s in got[100]) == sorted((round(s, 9), a) for a, s in want[100]) and len(got[100]) == 20 * 20


def test_recall_of_rows_outside_the_sample(spark, monkeypatch):
    """Clustered vectors, most of them not in the sample: recall against all rows, and the share of rows searched."""
    monkeypatch.setattr(ann, "SAMPLE", 1024)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + rng.normal(size=(150, 16)) * 0.25 for c in centres])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(6_000)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    seen = {}
    real = ann.searched
    monkeypatch.setattr(ann, "searched", lambda index, queries, router, k, probes: seen.update(parts=router.parts, probes=probes) or real(index, queries, router, k, probes))
    got = found(ann.neighbours(spark, df, F.col("vec_id") % 20 == 0))
    want = brute(list(range(6_000)), x.astype(float), range(0, 6_000, 20))
    hits = sum(len({a for _, a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9 and seen["probes"] / seen["parts"] <= 0.3
