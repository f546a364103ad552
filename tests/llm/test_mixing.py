"""Mixing against its SQL, and what any mix has to keep to."""

import re
from collections import defaultdict

import duckdb
import pytest

from inkwell.llm import mixing

from .conftest import agree, documents, odd_rows, prose


def many_rows():
    rows = [(k, prose(k, 1 + k * 7 % 90), "hot" if k % 3 else f"s{k % 11}") for k in range(600)]
    return rows + [(1_000 + k, None if k % 2 else "", "void") for k in range(6)] + [(2_000, prose(1, 5_000), None)]


def targets(sizes):
    """Water filling by repeated capping."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        rest, w = total - sum(out.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w > 2 * sizes[s] + 1e-9}
        if not over:
            out |= {s: rest * weight[s] / w for s in open_}
            break
        out |= {s: 2 * sizes[s] for s in over}
        open_ -= over
    return out


@pytest.mark.parametrize("rows", [odd_rows, many_rows])
@pytest.mark.parametrize("clash", [False, True])
def test_mix(spark, folder, rows, clash):
    rows = rows()
    d = folder(clash, documents=documents(rows))
    df = mixing.op10_mix_sources(spark, d).toPandas()
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{d}/documents.parquet'")
    agree(mixing.op10_mix_sources(spark, d), c.sql(mixing.ORACLE))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, source_of = defaultdict(int), defaultdict(set)
    for k, text, source in rows:
        sizes[source] += size(text)
        source_of[k].add(source)
    aim = targets(sizes)
    assert len(df) == len(rows) and (df.taken <= 2 * df["size"]).all()
    assert sorted(df["size"]) == sorted(size(r[1]) for r in rows)
    for source in sizes:
        own = df[[source_of[None if k != k else k] == {source} for k in df.doc_id]]
        for x in own.target:
            assert x == pytest.approx(aim[source], abs=1e-3)
    assert df.taken.sum() == pytest.approx(sum(aim.values()), abs=3 * mixing.BLOCK * len(sizes))
    by = df.groupby(["source_size", "target"]).taken.sum()
    for (s, t), taken in by.items():
        same_kind = sum(1 for x in sizes if sizes[x] == s and abs(aim[x] - t) < 1e-3)
        assert abs(taken - same_kind * t) <= 2 * mixing.BLOCK * same_kind


def test_reruns_agree(spark, folder):
    d = folder(documents=documents(many_rows()))
    a, b = (sorted(map(tuple, mixing.op10_mix_sources(spark, d).collect())) for _ in range(2))
    assert a == b


def test_empty_table(spark, folder):
    assert mixing.op10_mix_sources(spark, folder(documents=documents([]))).count() == 0


@pytest.mark.parametrize("rows", [odd_rows, many_rows])
def test_stage(spark, folder, rows):
    d = folder(True, documents=documents(rows()))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = mixing.stage_mix(spark, docs, d)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in rows()}
