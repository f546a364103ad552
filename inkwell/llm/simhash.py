"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, verified links, components.

A fingerprint's 64 bits are cut into 4 blocks of 16. Two fingerprints that differ in at most 2 bits agree in at
least 2 whole blocks, so they share one of the 6 keys made of two blocks; distinct fingerprints are joined on these
32-bit keys and pairs are verified by their Hamming distance. A key that more than HOT fingerprints share is not
paired off: each of its fingerprints gives itself and its 64 one-bit neighbours as keys, and fingerprints within 2
bits meet in a common one. Such a meeting place holds 65 distinct fingerprints at most, all within 2 bits of each
other, so it is linked as a star and needs no pairs. Both ways find every link; only which one is used depends on
the key's size. Texts never leave the pass that fingerprints them, and copies collapse to one fingerprint there.

Defined cases: null and empty texts have fingerprint 0 and link like others; texts of fewer than 3 words are one
shingle; repeated rows belong to one component; a null doc_id takes part but is no component_id unless no other is
there (then null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest

from inkwell.llm.shared import components, ship, table, written

WORDS, SEED, HOT = 3, 42, 32
NO_ID = 2**63 - 1


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """64 bits, as a signed integer. Words end at ASCII white space; hashes are counted in blocks."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    if len(words) < n:
        shingles, count = iter([b" ".join(words)]), 1
    else:
        shingles, count = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)), len(words) - n + 1
    hashes, ones = map(xxh64_intdigest, shingles, repeat(SEED)), np.zeros(64, np.int64)
    for k in range(0, count, 1 << 14):
        h = np.fromiter(hashes, "<u8", min(1 << 14, count - k))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fp], ["nid", "fp"])


@F.pandas_udf(LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return text.map(fingerprint)


def block_keys(fp: Column) -> Column:
    """The 6 keys of two 16-bit blocks, with their table's number above."""
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(*[F.lit(k << 32) + block[i] * 65536 + block[j] for k, (i, j) in enumerate(pairs)])


def links(spark: SparkSession, fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints fp which differ in 2 bits at most."""
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1")
    met = written(spark, keyed.join(shared, "key"), "blocks")
    cold = met.where(F.col("count") <= hot)
    a, b = cold.select("key", F.col("fp").alias("a")), cold.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    near = met.where(F.col("count") > hot).select("fp").distinct().select("fp", F.explode(flips).alias("flip"))
    stars = near.groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return pairs.union(stars.select("a", F.explode("all").alias("b")).where("a <> b"))


def roots(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """(fp, root, least): each distinct fingerprint's component and that component's smallest nid."""
    first = written(spark, prints.groupBy("fp").agg(F.min("nid").alias("nid")), "prints")
    joined = components(spark, links(spark, first.select("fp")))
    own = first.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "nid", F.coalesce("root", "fp").alias("root"))
    return own.join(own.groupBy("root").agg(F.min("nid").alias("least")), "root").select("fp", "root", "least")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    ship(spark)
    prints = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("nid"), "text").mapInArrow(_fingerprints, "nid long, fp long")
    prints = written(spark, prints, "fingerprints")
    out = prints.join(roots(spark, prints), "fp")
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(real("nid").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), real("least").alias("component_id"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row of smallest doc_id stays (one of them, if rows repeat)."""
    ship(spark)
    nid = F.coalesce("doc_id", F.lit(NO_ID))
    prints = written(spark, docs.select(nid.alias("nid"), "text").mapInArrow(_fingerprints, "nid long, fp long"), "fingerprints")
    keep = written(spark, roots(spark, prints).where("fp is not null"), "roots")
    stays = prints.join(keep, "fp").where("nid = least").select(F.col("nid").alias("_ink_nid"), F.col("root").alias("_ink_root"), F.col("fp").alias("_ink_fp"))
    total, ids = prints.agg(F.count("*"), F.countDistinct("nid")).first()
    if total == ids:  # ids name rows
        return docs.join(stays.select("_ink_nid"), nid == F.col("_ink_nid"), "left_semi").select(*docs.columns)
    rows = docs.withColumn("_ink_own", fingerprint_udf("text"))
    out = rows.join(stays.distinct(), (nid == F.col("_ink_nid")) & (F.col("_ink_own") == F.col("_ink_fp")))
    return out.dropDuplicates(["_ink_root"]).select(*docs.columns)
