"""Index maintenance from a stream of documents, and streamed lock logs."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.functions.text import tokenize
from inkwell.functions.udf import ship
from inkwell.operators import index, locks


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_postings(docs: DataFrame) -> DataFrame:
    """Running (term, docnum, dtf) of a stream of (docnum, text), for update or complete mode."""
    return docs.select("docnum", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("term", "docnum").agg(F.count("*").alias("dtf"))


def maintain(docs: DataFrame, path: str, checkpoint: str):
    """Adds each batch's postings, and its documents' numbers, under path, in folders named by the batch, so a batch
    that runs again replaces its own rows only. No state is kept."""

    def add(batch: DataFrame, number: int) -> None:
        batch.select("docnum").write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        index.postings_of(batch).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(term, docnum, dtf) of all batches; counts of a document that came in several are added up."""
    rows = spark.read.parquet(f"{path}/postings").select("term", "docnum", "dtf")
    return index.added(rows) if index.repeats(spark.read.parquet(f"{path}/docs").select("docnum", "batch").distinct()) else rows


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    lock = pickle.loads(state.get[0]) if state.exists else locks.Lock()
    log = pd.concat(list(parts)).sort_values("seq")
    out = [locks.row_after(lock, r, locks.step(lock, r.op, r.owner, r.mode, r.duration, int(r.timeout), bool(r.force))) for r in log.itertuples()]
    state.update((pickle.dumps(lock),))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in locks.OUT.split(", ")])


def stream_replay(log: DataFrame) -> DataFrame:
    """operators.locks.replay over a stream: a lock's queue is state by lockable. Within a batch requests go by seq;
    batches must come in order."""
    ship(log.sparkSession)
    return log.groupBy("lockable").applyInPandasWithState(_advance, locks.OUT, "lock binary", "append", GroupStateTimeout.NoTimeout)
