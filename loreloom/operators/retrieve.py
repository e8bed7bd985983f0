"""Exact nearest neighbours: one query by a distributed top-k, many queries by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.session import cut

QUERY_BLOCK = 1024
ROW_BLOCK = 8192
#: Query blocks held by an executor at once.
QUERY_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(rows: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """rank, key, score of the k rows nearest to the one row of query; score descending, then key descending."""
    q = query.select(F.col(vector).alias("_q")).limit(1)
    scored = rows.crossJoin(F.broadcast(q)).select(F.col(key), dot(F.col(vector), F.col("_q")).alias("score"))
    best = scored.orderBy(F.desc("score"), F.desc(key)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc(key))).cast("int")).select("rank", key, "score")


def _blocks(df: DataFrame, size: int, key: str, vector: str) -> DataFrame:
    """Rows of df packed into blocks of at most size rows, without a shuffle: ids and one flat array of vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                c = b.slice(at, size)
                m = c.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_pydict({"ids": pa.array([c.column(0).to_pylist()], pa.list_(pa.int64())), "m": pa.array([m.tobytes()], pa.binary())})

    return df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint"), F.col(vector)).mapInArrow(pack, "ids array<bigint>, m binary")


def top_k_many(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", most: int = QUERY_BYTES, digits: int | None = None) -> DataFrame:
    """(query_id, rank, key, score) for every query against all rows: blocks of queries meet blocks of rows in one matrix product each, and only the k best of each pair of blocks go on.

    With digits, scores are rounded before they are ranked, so that rows that differ by the order of summation only are ties. The query blocks go to every executor in sets of at most most bytes; a larger query set takes several passes over the rows. Vectors must be of one length; rows with a null key or vector are left out.
    """
    q = cut(_blocks(queries, QUERY_BLOCK, key, vector).withColumnsRenamed({"ids": "q_ids", "m": "q"}))
    sets = max(1, -(-(q.agg(F.sum(F.octet_length("q"))).first()[0] or 0) // most))
    r = _blocks(rows, ROW_BLOCK, key, vector)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                ids, qi = np.array(x["ids"], np.int64), np.array(x["q_ids"], np.int64)
                m, qm = np.frombuffer(x["m"]).reshape(len(ids), -1), np.frombuffer(x["q"]).reshape(len(qi), -1)
                s = qm @ m.T if digits is None else np.round(qm @ m.T, digits)
                order = np.lexsort((np.broadcast_to(-ids, s.shape), -s), axis=1)[:, :k]
                rows_ = np.repeat(np.arange(len(qi)), order.shape[1])
                at = order.reshape(-1)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(qi[rows_]), key: pa.array(ids[at]), "score": pa.array(s[rows_, at])})

    part = None
    for n in range(sets):
        some = q if sets == 1 else q.filter(F.pmod(F.xxhash64("q_ids"), F.lit(sets)) == n)
        one = r.crossJoin(F.broadcast(some)).mapInArrow(score, f"query_id bigint, {key} bigint, score double")
        part = one if part is None else part.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(key))
    return part.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")
