"""Numbers and carried values along an order, without one task for each group.

Within groups, rows are worked on in buckets: runs of the order that the caller names, so small that each fits a task. What a bucket starts with is worked out from one row for each bucket.
Without groups, rows are sorted by ranges, and each range starts where the one before ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.session import cut


def placed(df: DataFrame, by: str, order: list[str], name: str, bucket: Column) -> DataFrame:
    """df with name, a bigint: the position of each row, from 0, among the rows of its group in the given order, which must be unique in the group.

    bucket must not fall as the order rises. Rows of a null group are left out.
    """
    d = df.filter(F.col(by).isNotNull()).withColumn("_b", bucket)
    d = d.withColumn("_at", F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order)))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    s = d.groupBy(by, "_b").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return d.join(s.select(by, "_b", "_base"), [by, "_b"]).withColumn(name, F.col("_base") + F.col("_at") - 1).drop("_b", "_at", "_base")


def carried(df: DataFrame, by: str, order: list[str], value: str, default: str, name: str, runs: str, bucket: Column) -> DataFrame:
    """df with name, the last non-null value so far in its group (default before the first), and runs, the number of times that changed since the group's first row.

    bucket must not fall as the order rises, and the order must be unique in the group. Rows of a null group are left out.
    """
    d = df.filter(F.col(by).isNotNull()).withColumn("_b", bucket)
    w = Window.partitionBy(by, "_b").orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    v, o = F.col(value), F.struct(*order)
    d = d.withColumn("_in", F.last(value, ignorenulls=True).over(so_far))
    d = d.withColumn("_step", F.when(v != F.lag("_in").over(w), 1).otherwise(0)).withColumn("_steps", F.sum("_step").over(so_far))
    told = F.when(v.isNotNull(), o)
    s = d.groupBy(by, "_b").agg(F.min_by(v, o).alias("_first"), F.min_by(v, told).alias("_opens"), F.max_by(v, told).alias("_ends"), F.sum("_step").alias("_inner"))
    whole = Window.partitionBy(by).orderBy("_b")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    # the first row of a group changes nothing
    s = s.withColumn("_carry", F.coalesce(F.last("_ends", ignorenulls=True).over(before), F.when(F.row_number().over(whole) == 1, F.col("_first")), F.lit(default)))
    s = s.withColumn("_enters", F.when(F.col("_opens") != F.col("_carry"), 1).otherwise(0))
    s = s.withColumn("_base", F.coalesce(F.sum(F.col("_inner") + F.col("_enters")).over(before), F.lit(0)))
    out = d.join(s.select(by, "_b", "_carry", "_enters", "_base"), [by, "_b"])
    count = F.col("_base") + F.col("_steps") + F.when(F.col("_in").isNotNull(), F.col("_enters")).otherwise(0)
    return out.withColumn(name, F.coalesce("_in", "_carry")).withColumn(runs, count.cast("int")).drop("_b", "_in", "_step", "_steps", "_carry", "_enters", "_base")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name, a bigint: the position of each row, from 0, in the given order, which must be unique. The driver holds one number for each range."""
    parts = cut(cut(df).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    start = dict(zip(sorted(sizes), np.cumsum([0, *[sizes[p] for p in sorted(sizes)]])[:-1].tolist(), strict=True))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            at = b.schema.get_field_index("_p")
            ps = b.column(at).to_numpy()
            out = np.empty(b.num_rows, np.int64)
            for p in np.unique(ps).tolist():  # one, unless ranges were put together
                rows = np.flatnonzero(ps == p)
                out[rows] = start[p] + seen.get(p, 0) + np.arange(len(rows))
                seen[p] = seen.get(p, 0) + len(rows)
            rest = [k for k in range(b.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), pa.array(out)], [*(b.schema.names[k] for k in rest), name])

    return parts.mapInArrow(number, ", ".join([*(f"`{n}` {k}" for n, k in parts.dtypes if n != "_p"), f"`{name}` bigint"]))
