"""Document sets as frames of docnum, and as bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("docnum").union(b.select("docnum")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("docnum").intersect(b.select("docnum"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("docnum").subtract(b.select("docnum"))


def complement(a: DataFrame, docs: DataFrame) -> DataFrame:
    """All documents but a's, those without terms too."""
    return docs.select("docnum").join(a, "docnum", "left_anti")


def contains(rows: DataFrame, a: DataFrame) -> DataFrame:
    return rows.join(a.select("docnum"), "docnum", "left_semi")


def members(a: DataFrame, docs: DataFrame) -> DataFrame:
    """(docnum, member) of all documents, in order."""
    return docs.select("docnum").join(a.select("docnum", F.lit(True).alias("m")).distinct(), "docnum", "left").select("docnum", F.coalesce("m", F.lit(False)).alias("member")).orderBy("docnum")


def bitmap(a: DataFrame) -> DataFrame:
    """(bucket, bits): packed sets, one row for 32,768 numbers. Numbers go in plus one, as buckets count from 1."""
    n = F.col("docnum") + 1
    return a.groupBy(F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))


def bitmap_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("bucket"), "bucket", "left_semi").union(b.join(a.select("bucket"), "bucket", "left_semi")).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"))


def cardinality(bits: DataFrame) -> DataFrame:
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("n"))
