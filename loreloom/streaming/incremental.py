"""Incremental merges: every micro-batch folds new extractions into keyed tables, once each."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.functions import text as t
from loreloom.session import shared_dir

STATE = "k string, first_ord bigint, name string, len int, desc_ord bigint, description string, n bigint"


def partial(rows: DataFrame, name: str, description: str, ord: str) -> DataFrame:
    """Rows as a state: one row per key, with first name and longest description."""
    r = rows.select(t.norm_ws(F.col(name)).alias("k"), F.col(ord).cast("bigint").alias("o"), F.col(name).alias("v"), F.col(description).alias("d")).filter("k <> ''")
    best = F.max(F.struct(F.length(F.coalesce("d", F.lit(""))).alias("l"), (-F.col("o")).alias("o"), F.col("d").alias("d")))
    return r.groupBy("k").agg(F.min(F.struct("o", "v")).alias("f"), best.alias("b"), F.count("*").alias("n")).select("k", F.col("f.o").alias("first_ord"), F.col("f.v").alias("name"), F.col("b.l").alias("len"), (-F.col("b.o")).alias("desc_ord"), F.col("b.d").alias("description"), "n")


def combine(states: DataFrame) -> DataFrame:
    """States under one another as one state. Associative and commutative, so batches may come in any order."""
    best = F.max(F.struct("len", (-F.col("desc_ord")).alias("o"), "description"))
    return states.groupBy("k").agg(F.min(F.struct("first_ord", "name")).alias("f"), best.alias("b"), F.sum("n").alias("n")).select("k", "f.first_ord", "f.name", F.col("b.len").alias("len"), (-F.col("b.o")).alias("desc_ord"), F.col("b.description").alias("description"), "n")


def run(spark: SparkSession, source: DataFrame, state_dir: str, checkpoint_dir: str, name: str, description: str, ord: str, pause: float = 0.0) -> int:
    """Process what is new in a streaming source and stop; the number of micro-batches that had rows.

    Each micro-batch writes its own state folder, overwritten if it is replayed, so a failure repeats nothing twice: what was written before it stays, and the next run starts with the batch that failed.
    With nothing new no batch runs and the state stays as it is. pause: seconds to wait after a batch, for sources behind a rate limit; how much a batch takes is the source's maxFilesPerTrigger.
    A new checkpoint_dir and state_dir start afresh.
    """
    done = 0

    def fold(batch: DataFrame, batch_id: int) -> None:
        nonlocal done
        partial(batch, name, description, ord).write.mode("overwrite").parquet(f"{state_dir}/batch={batch_id}")
        done += 1
        if pause:
            time.sleep(pause)

    w = source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    w.awaitTermination()
    return done


def append(source: DataFrame, path: str, checkpoint_dir: str) -> None:
    """Each result of a streaming source is written as soon as it comes; a folder a micro-batch, replaced if the batch is replayed."""
    w = source.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch={i}")).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    w.awaitTermination()


def current(spark: SparkSession, state_dir: str) -> DataFrame:
    return combine(spark.read.schema(STATE).parquet(f"{state_dir}/batch=*"))


def streamed(spark: SparkSession, path: str, name: str, description: str, ord: str) -> DataFrame:
    """The state after a stream over the files of a table, stopped and started again on nothing new, without rows that were delivered again."""
    rows = spark.read.parquet(path)
    work = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a delivery of a key already seen adds nothing, whatever batch it comes in
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(re.sub(r"([^/])$", r"[\1]", path)).filter(F.col(ord).isNotNull()).dropDuplicates([ord])
    for _ in range(2):
        run(spark, source, f"{work}/state", f"{work}/checkpoint", name, description, ord)
    return current(spark, f"{work}/state")


def merged_in_batches(rows: DataFrame, batches: int, name: str, description: str, ord: str) -> DataFrame:
    """The state after folding rows in the given number of batches, as a stream would."""
    out = None
    for k in range(batches):
        s = partial(rows.filter(F.pmod(F.xxhash64(ord), F.lit(batches)) == k), name, description, ord)
        out = s if out is None else out.unionByName(s)
    return combine(out)
