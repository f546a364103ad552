"""What the training-data operators share: tables, the shared scratch folder, connected components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.udf import ship
from inkwell.plans.scratch import root

__all__ = ["components", "dealt_by_bytes", "delete", "forget", "release", "scratch_path", "ship", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/inkwell-{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and a lost executor costs no recomputation."""
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkwell_path = path
    return out


TASK_BYTES, MOST_TASKS = 1 << 21, 20_000


def dealt_by_bytes(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """df, dealt by keys to as many tasks as its texts' bytes need (MOST_TASKS, of more bytes each, for more than 40 GB):
    for work that takes long for few bytes, which AQE would put into few tasks."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return df.repartition(max(1, min(MOST_TASKS, -(-size // TASK_BYTES))), *keys)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps, which it does as their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    for df in frames:
        delete(spark, df._inkwell_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b), root being some node of its component.

    Randomised contraction: in each round every node moves to the neighbour (or itself) of least seeded hash,
    edges are renamed and deduplicated, and the live graph shrinks by a constant factor in expectation whatever
    its shape (paths, stars, cliques). Each round's mapping is a written table; they are composed from the last
    to the first. No node's neighbour list is ever gathered: the least neighbour is a map-side combined minimum.
    """
    live = written(spark, edges.where("a <> b").select("a", "b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        k = len(maps)
        if k >= max_rounds:
            raise RuntimeError(f"components did not contract in {max_rounds} rounds")
        both = live.union(live.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(k)).alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(k)).alias("h"), F.col("a").alias("v"))
        step = written(spark, least.select(F.col("a").alias("node"), F.least("m", own)["v"].alias("root")), "contract")
        to = lambda c: step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to"))
        after = live.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        after = written(spark, after.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        forget(spark, live)
        maps, live = [*maps, step], after
    forget(spark, live)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = maps[-1]
    for step in reversed(maps[:-1]):
        nxt = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        joined = written(spark, step.join(nxt, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        forget(spark, out, step)
        out = joined
    return out
