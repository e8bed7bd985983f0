"""Problem 7: records that differ in form only.

Two scans. The first makes, in each partition, Bloom filters of the canonical hashes seen once and of those seen
again, and merges them block by block, ``FAN_IN`` partitions at a time: a bit is in the merged "again" filter when some partition saw it again or two
partitions saw it once. The second scan shuffles only rows whose hash is in "again"; all others are singletons and
leave at once. Both filters have a fixed largest size (``max_bits``); beyond it more rows are shuffled, and the result
stays the same, because repeats are grouped by their exact canonical text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.operators.skew import lookup
from loreloom.session import cut

BLOCK_BITS = 1 << 15
BITS_PER_KEY = 16
MAX_BITS = 1 << 28
#: Filters of this many partitions are merged by one task.
FAN_IN = 64
#: With more rows than this share of the bits of the largest filter, nearly all of its bits are set.
FULL = 4
FILTERS = "block int, part int, once binary, again binary"
FIELDS = ("subject", "relation", "object")


def canonical(c: Column) -> Column:
    """Letters and digits alone, lower case; accents count. Null gives an empty string."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))


def keyed(rel: DataFrame, key: str = "rel_key", book: str = "book_id") -> DataFrame:
    """(row_key, has_key, k): k is the exact canonical text of book and fields; without all three fields, the row's own key.

    Fields that are null are taken from the JSON object in raw_record, whatever the order and letter case of its names;
    broken JSON gives nothing. A null book_id is a book of its own.
    """
    entries = F.map_entries(F.from_json(F.when(F.col("raw_record").rlike(r"\}\s*$"), F.col("raw_record")), "map<string,string>"))
    parsed = rel.select(F.col(key).alias("row_key"), F.col(book).alias("book"), *[F.col(c) for c in FIELDS], F.when(F.col("raw_record").isNotNull(), entries).alias("e"))
    field = lambda c: F.coalesce(F.col(c), F.try_element_at(F.filter("e", lambda x: F.lower(F.trim(x["key"])) == c), F.lit(1))["value"])
    flat = parsed.select("row_key", "book", *[canonical(field(c)).alias(c) for c in FIELDS])
    has = (F.col("subject") != "") & (F.col("relation") != "") & (F.col("object") != "")
    text = F.concat_ws("\u0001", F.coalesce(F.col("book").cast("string"), F.lit("-")), *[F.col(c) for c in FIELDS])
    return flat.select("row_key", has.alias("has_key"), F.when(has, text).otherwise(F.concat(F.lit("\u0002"), F.coalesce(F.col("row_key").cast("string"), F.lit("-")))).alias("k"))


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.astype(np.uint64)
    mask = np.uint64(bits - 1)
    return (u & mask).astype(np.int64), ((u >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & mask).astype(np.int64)


def _get(f: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (f[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1).astype(bool)


def _set(f: np.ndarray, x: np.ndarray) -> None:
    np.bitwise_or.at(f, x >> 3, (1 << (7 - (x & 7))).astype(np.uint8))


def _filters(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The two filters of one partition, packed, block by block; blocks without a bit are left out."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for b in batches:
        h, n = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_counts=True)
        i, j = _bits(h, bits)
        seen = _get(once, i) & _get(once, j) | (n > 1)
        for x in (i, j):
            _set(again, x[seen])
        for x in (i, j):
            _set(once, x)
    size = BLOCK_BITS // 8
    for k in range(0, bits // 8, size):
        if once[k : k + size].any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k // size], pa.int32()), "part": pa.array([part], pa.int32()), "once": pa.array([once[k : k + size].tobytes()], pa.binary()), "again": pa.array([again[k : k + size].tobytes()], pa.binary())})


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    once = np.zeros(BLOCK_BITS // 8, np.uint8)
    again = once.copy()
    for o, a in zip(rows["once"], rows["again"], strict=True):
        o = np.frombuffer(o, np.uint8)
        again |= (once & o) | np.frombuffer(a, np.uint8)
        once |= o
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "part": [rows["part"].iloc[0]], "once": [once.tobytes()], "again": [again.tobytes()]})


def merged(parts: DataFrame, number: int) -> DataFrame:
    """The filters of number partitions as one, in rounds, so that no task holds more than FAN_IN pieces of a block however many partitions there are."""
    while number > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInPandas(_merge, FILTERS)
        number = -(-number // FAN_IN)
    return parts


def repeats_filter(hashes: DataFrame, rows: int, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> tuple[np.ndarray, int]:
    """The merged filter of hashes seen more than once, as packed bits (at most max_bits / 8 bytes), and its number of bits."""
    bits = min(max_bits, max(BLOCK_BITS, 1 << (max(1, rows) * bits_per_key - 1).bit_length()))
    parts = hashes.mapInArrow(lambda b: _filters(b, bits), FILTERS)
    out = np.zeros(bits // 8, np.uint8)
    for r in merged(parts, hashes.rdd.getNumPartitions()).select("block", "again").toLocalIterator():
        out[r["block"] * (BLOCK_BITS // 8) : (r["block"] + 1) * (BLOCK_BITS // 8)] = np.frombuffer(r["again"], np.uint8)
    return out, bits


def mark_repeats(rows: DataFrame, total: int, **sizes: int) -> DataFrame:
    """rows (with a text column k) and maybe: false only where no other row has the same k."""
    h = F.xxhash64("k")
    if total > FULL * sizes.get("max_bits", MAX_BITS):
        # filters of the largest size would be full: all rows are possible repeats, and none has to be looked up
        return rows.withColumn("maybe", F.lit(True))
    packed, bits = repeats_filter(rows.select(h.alias("h")), total, **sizes)
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf(T.BooleanType())
    def maybe(h: pd.Series) -> pd.Series:
        i, j = _bits(h.to_numpy(), bits)
        return pd.Series(_get(shared.value, i) & _get(shared.value, j))

    return rows.withColumn("maybe", maybe(h))


def _groups(rows: DataFrame) -> DataFrame:
    """One row per k: first_key and the number of distinct row keys."""
    return rows.groupBy("k").agg(F.min("row_key").alias("first_key"), F.count("*").alias("copies"))


def collapse(rel: DataFrame, key: str = "rel_key", book: str = "book_id", **sizes: int) -> DataFrame:
    """(first_key, copies): one row per record, with the number of its copies.

    Rows delivered again (same key) count once. Records with a missing or blank field or broken JSON stand for
    themselves. A row with a null key counts as a copy of its group; one without group is a record of its own.
    """
    rows = mark_repeats(keyed(rel, key, book), rel.count(), **sizes)
    single = rows.filter(~F.col("maybe")).select(F.col("row_key").alias("first_key"), F.lit(1).cast("bigint").alias("copies"))
    several = _groups(rows.filter("maybe").select("k", "row_key").distinct()).select("first_key", "copies")
    return single.unionByName(several)


def copies(rel: DataFrame, key: str = "rel_key", book: str = "book_id", **sizes: int) -> DataFrame:
    """(first_key, copy_key): each member of a group of two or more but the one with the smallest key, which is first_key.

    Nulls: a null key is no member; null or blank fields, or broken JSON, make a record no member. An empty table gives no rows.
    """
    total = rel.count()
    rows = mark_repeats(keyed(rel.filter(F.col(key).isNotNull()), key, book), total, **sizes)
    members = cut(rows.filter("has_key AND maybe").select("k", "row_key").distinct())
    groups = _groups(members).filter("copies > 1")
    return lookup(members, groups, "k", "copies", total).filter("row_key > first_key").select("first_key", F.col("row_key").alias("copy_key"))
