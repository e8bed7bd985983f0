"""Sources and sinks: JSON documents, vector matrices, pages, audit batches, previews."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.sources import schemas


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of chunks."""
    return spark.read.schema(schemas.CHUNK).option("multiLine", True).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUESTION).option("multiLine", True).json(path)


def read_world(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A world document as tables: processed, and one per category with the position of each record."""
    doc = spark.read.schema(schemas.WORLD).option("multiLine", True).json(path)
    out = {"processed": doc.select(F.explode("processed_chunk_ids").alias("chunk_id"))}
    for c in schemas.PROFILES["story"]:
        out[c] = doc.select(F.posexplode(c).alias("ord", "r")).select("ord", "r.*")
    return out


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(row, embedding) of .npy matrices; a matrix is read in slices of rows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096].astype(np.float32)
                    yield pd.DataFrame({"row": np.arange(at, at + len(part)), "embedding": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "row bigint, embedding array<float>")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, raw_text, blocks) of PDF files, if pymupdf is installed; otherwise give extracted pages as a table."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pymupdf; pass pages as a table of page, raw_text and blocks") from e

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for k, page in enumerate(doc, 1):
                        blocks = [b[4] for b in page.get_text("blocks", sort=True)]
                        yield pd.DataFrame({"path": [p], "page": [k], "raw_text": [page.get_text("text", sort=True)], "blocks": [blocks]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "path string, page int, raw_text string, blocks array<string>")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, in place of whatever was there."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with all characters as they are, for exchange."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_batches(df: DataFrame, path: str, id: str = "chunk_id", batch: str = "batch") -> None:
    """Rows under one folder per batch, named by its first and last id. Only the folders of the batches given are replaced, so a batch that is replayed stands there once."""
    names = df.groupBy(batch).agg(F.format_string("batch_%04d_%04d", F.min(id), F.max(id)).alias("batch_id"))
    df.join(names, batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def checkpoint_or(spark: SparkSession, *paths: str, schema: str) -> DataFrame:
    """The first path that can be read, else an empty table: progress, else the final table, else nothing."""
    for p in paths:
        try:
            return spark.read.schema(schema).parquet(p)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def preview(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first n rows in order."""
    return df.orderBy(order).limit(n)
