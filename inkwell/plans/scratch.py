"""A folder that all executors share, and what is kept in it."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where driver and executors are one process may it be unset: then a temporary folder
    takes its place and goes with the process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="inkwell-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def folder(spark: SparkSession, name: str) -> str:
    """A new one."""
    return f"{root(spark)}/inkwell-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new folder and read again: lineage ends here."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def size(df: DataFrame) -> int:
    """Bytes of the files that df reads."""
    conf, jpath = df.sparkSession.sparkContext._jsc.hadoopConfiguration(), df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sum(jpath(name).getFileSystem(conf).getFileStatus(jpath(name)).getLen() for name in df.inputFiles())


def signature(df: DataFrame, *more: object) -> str:
    """Of the files that df reads, their sizes and times, and of more: the same while nothing has changed."""
    spark, h = df.sparkSession, hashlib.md5(repr(more).encode())
    conf, jpath = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in sorted(df.inputFiles()):
        status = jpath(name).getFileSystem(conf).getFileStatus(jpath(name))
        h.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return h.hexdigest()
