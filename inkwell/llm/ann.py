"""Approximate nearest neighbours (largest inner product) by learned partitions.

On a bounded sample (SAMPLE rows, or VERTICES for each part, by hash; MOST_PARTS parts at most): the inner-product neighbour graph, split into parts of equal size by
capacity-bound moves that keep neighbours together; then a softmax classifier learns, from the vector alone, over
which parts a vector's neighbours lie. Every row is indexed under its likeliest part. A query goes to its PROBES
likeliest parts, as many as give RECALL for HELD of the sample that the classifier did not learn from (against brute
force over all of the sample). Parts are as many as a quarter of the rows' square root. They are cut into
blocks of BLOCK rows, and the queries of a part too, so a part that holds most of the rows is many groups. Blocks
return their best k by exact double-precision scores; those are merged. A query that found fewer than k (small
tables) is searched again over all parts.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, have no id, or another length
than most, take no part; rows that repeat an id, or a whole row, are rows of their own: each is a candidate of the others
and, if its id is a query's, a query, so that its query_id and ranks come once a row; equal scores go by id; a table
without valid rows gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.shared import ship, table, written

SAMPLE, BLOCK, NEIGHBOURS, RECALL = 8192, 4096, 20, 0.95
MOST_PARTS, VERTICES, HELD = 1024, 32, 0.25
STEPS, MARGIN = 400, 1e-9


def parts_for(rows: int) -> int:
    return int(min(MOST_PARTS, max(8, round(rows**0.5 / 4))))


def sample_for(rows: int) -> int:
    return max(SAMPLE, VERTICES * parts_for(rows))


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest others, by blocks."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, 1)[:, :k]
    return out


def balanced(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 30) -> np.ndarray:
    """A part for each vertex: halved along main directions first, then moved to where most neighbours are, in order
    of gain, while the part has room (3 % above the mean)."""
    n = len(x)
    part, todo = np.zeros(n, np.int64), [(np.arange(n), 0, parts)]
    while todo:
        rows, first, many = todo.pop()
        part[rows] = first
        if many > 1 and len(rows) > 1:
            y = x[rows] - x[rows].mean(0)
            axis = np.linalg.svd(y.T @ y)[0][:, 0]
            order, left = rows[np.argsort(y @ axis, kind="stable")], many // 2
            cut = len(rows) * left // many
            todo += [(order[:cut], first, left), (order[cut:], first + left, many - left)]
    ends = np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    starts = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()])
    room = int(np.ceil(1.03 * n / parts))
    for _ in range(rounds):
        votes = np.bincount(starts * parts + part[ends], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < room:
                size[part[v]] -= 1
                size[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


def learned(x: np.ndarray, aim: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression to the shares aim, by Adam on all rows."""
    rng = np.random.default_rng(0)
    w = [rng.normal(0, 0.01, (x.shape[1], aim.shape[1])), np.zeros(aim.shape[1])]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for t in range(1, steps + 1):
        z = x @ w[0] + w[1]
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - aim) / len(x)
        for k, g in enumerate((x.T @ d + 1e-5 * w[0], d.sum(0))):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            w[k] = w[k] - 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-10)
    return w[0], w[1]


class Router:
    def __init__(self, x: np.ndarray, rows: int, k: int = NEIGHBOURS, recall: float = RECALL):
        self.dim, self.parts = x.shape[1], parts_for(rows) if len(x) > 4 * NEIGHBOURS else 1
        self.scale = float(np.sqrt((x * x).sum(1).mean())) or 1.0
        if self.parts == 1:
            self.w, self.b, self.probes, self.measured = np.zeros((self.dim, 1)), np.zeros(1), 1, 1.0
            return
        near = nearest(x, min(k, len(x) - 1))
        part = balanced(x, near, self.parts)
        aim = np.zeros((len(x), self.parts))
        np.add.at(aim, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
        asks = np.random.default_rng(1).random(len(x)) < HELD
        asks[np.argmin(asks)] = False  # at least one row to learn from
        self.w, self.b = learned(x[~asks] / self.scale, aim[~asks])
        asks = asks if asks.any() else ~asks
        order = np.argsort(-self.logits(x), 1, kind="stable")
        own, rank = order[:, 0], np.argsort(order[asks], 1)
        depth = np.sort(rank[np.arange(len(rank))[:, None], own[near[asks]]].ravel())  # parts to search until each neighbour is met
        self.probes = int(depth[int(np.ceil(recall * len(depth))) - 1]) + 1
        self.measured = float((depth < self.probes).mean())

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x / self.scale @ self.w + self.b

    def route(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), 1, kind="stable")


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.withColumn("rid", F.monotonically_increasing_id())  # a row's number; it holds once it is written


def _route(router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = router.value
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, r.dim)
                parts = r.route(x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * r.parts), pa.array(parts.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([row.tobytes() for row in x], pa.binary()), b.column(2), flat], ["vec_id", "v", "rid", "parts"])

    return run


def _best(k: int, dim: int):
    def run(key, left, right):
        n = len(left), len(right)
        q, x = (np.frombuffer(b"".join(t.column(c).to_pylist()), float).reshape(-1, dim) for t, c in ((left, "qv"), (right, "v")))
        ids, rid, own = (t.column(c).to_numpy() for t, c in ((right, "vec_id"), (right, "rid"), (left, "q_rid")))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, n[0] if n[1] else 0, 512):
            near = q[a : a + 512] @ x.T
            near[own[a : a + 512, None] == rid] = -np.inf
            floor = np.partition(near, n[1] - k, 1)[:, n[1] - k] if n[1] > k else np.full(len(near), -np.inf)
            slack = MARGIN * (1 + np.abs(floor, where=np.isfinite(floor), out=np.zeros(len(near))))
            for i, row in enumerate(near):
                at = np.flatnonzero((row >= floor[i] - slack[i]) & (row > -np.inf))
                exact = (x[at] * q[a + i]).sum(1)  # the same for equal vectors, wherever they stand
                at, exact = (y[np.lexsort((ids[at], -exact))[:k]] for y in (at, exact))
                out.append((np.full(len(at), own[a + i]), ids[at], exact))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, float if c == 2 else np.int64) for c in range(3)]
        return pa.table({"q_rid": pa.array(cols[0]), "vec_id": pa.array(cols[1]), "score": pa.array(cols[2])})

    return run


def fitted(rows: DataFrame) -> Router | None:
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return None
    sample = rows.where(F.size("v") == sizes["dim"]).orderBy(F.xxhash64("vec_id", "rid"), "rid").limit(sample_for(sizes["count"])).select("v").toPandas()
    return Router(np.stack(sample["v"].to_numpy()).astype(float), sizes["count"])


def searched(index: DataFrame, queries: DataFrame, router: Router, k: int, probes: int) -> DataFrame:
    """(q_rid, rank, vec_id, score): each query row's best k among its first probes parts."""
    own = index.select(F.element_at("parts", 1).alias("part"), "vec_id", "rid", "v")
    asked = queries.select(F.explode(F.slice("parts", 1, probes)).alias("part"), F.col("rid").alias("q_rid"), F.col("v").alias("qv"))
    blocks = lambda df, name: F.broadcast(df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name)))  # noqa: E731  a row a part
    n_rows, n_asked = blocks(own, "rows"), blocks(asked, "asked")
    cut = lambda name, c: F.pmod(F.xxhash64(c), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    right = own.join(n_rows, "part").join(n_asked, "part").select("part", cut("rows", "rid").alias("r"), every("asked").alias("q"), "vec_id", "rid", "v")
    left = asked.join(n_rows, "part").join(n_asked, "part").select("part", every("rows").alias("r"), cut("asked", "q_rid").alias("q"), "q_rid", "qv")
    found = left.groupBy("part", "r", "q").cogroup(right.groupBy("part", "r", "q")).applyInArrow(_best(k, router.dim), "q_rid long, vec_id long, score double")
    best = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def neighbours(spark: SparkSession, vectors: DataFrame, is_query, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of vectors (vec_id, embedding) for which is_query holds."""
    ship(spark)
    rows = written(spark, usable(vectors), "vectors")
    router = fitted(rows)
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(router)
    index = written(spark, rows.where(F.size("v") == router.dim).mapInArrow(_route(shared), "vec_id long, v binary, rid long, parts array<int>"), "index")
    queries = index.where(is_query)
    out = written(spark, searched(index, queries, router, k, router.probes), "found")
    if router.probes < router.parts:
        enough = out.groupBy("q_rid").count().where(F.col("count") >= k).select(F.col("q_rid").alias("rid"))
        short = written(spark, queries.join(enough, "rid", "left_anti").select(*index.columns), "short")
        if not short.isEmpty():
            again = searched(index, short, router, k, router.parts)
            out = out.join(short.select(F.col("rid").alias("q_rid")), "q_rid", "left_anti").unionByName(again)
    out = out.join(queries.select(F.col("rid").alias("q_rid"), F.col("vec_id").alias("query_id")), "q_rid")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
