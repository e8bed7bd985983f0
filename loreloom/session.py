"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loreloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in spark.checkpoint.dir. Only where driver and executors are one machine's one process may it be unset: then it is a new folder, removed at the end."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loreloom-", dir=os.environ.get("LORELOOM_TMP"))
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """df as the side of an equi-join that is sorted and merged, never broadcast: for sides that grow with the input, of which Spark only guesses the size.
    Its guess for a checkpoint comes from the compressed files that were first read and does not know what explode makes of a row, so it may be a hundredth."""
    return df.hint("merge")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """df in at least as many partitions as the session has cores, for CPU-bound Python stages over small files; larger inputs keep their splits."""
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """df shuffled by key into as many partitions as the session is set to, which adaptive execution then leaves alone: for CPU-bound stages whose
    input is small in bytes. An aggregate on the same key needs no further shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
