"""Joins from many members to one row per group that stay balanced when one group holds a large share of all members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.session import cut


def lookup(members: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 200, floor: int = 20_000) -> DataFrame:
    """Inner join of members with groups on key, where groups has one row per key and its number of members in size.

    A group with more than max(floor, total / share) members is hot; there can be at most ``share`` of them, so
    they are broadcast, and their members join where they lie. All other groups join by a shuffle.
    Rows whose key is null join nothing. Neither side may share a column name other than the key.
    """
    limit = max(floor, total // share)
    hot = groups.filter(F.col(size) > limit)
    cold = groups.filter(F.col(size) <= limit)
    fast = members.join(F.broadcast(hot), key)
    rest = members.join(F.broadcast(hot.select(key)), key, "left_anti")
    return fast.unionByName(rest.join(cold, key).select(fast.columns))


def halves(rows: DataFrame, by: list[str], id: str, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The two sides of a self-join of rows within the groups of by, both with a column _part to join on as well.

    A group of more than most rows is split into parts by a hash of id: the first side has each row in its own part, the second in every part, so
    that each pair meets once and no task of the join holds more than most rows of one group against the whole group.
    """
    hot = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*by, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    hot = cut(hot)
    few = hot.count()
    if not few:
        one = rows.withColumn("_part", F.lit(0))
        return one, one
    sized = rows.join(F.broadcast(hot) if few <= 10_000 else hot, by, "left").fillna({"_parts": 1})
    own = sized.withColumn("_part", F.pmod(F.xxhash64(id), F.col("_parts")).cast("int")).drop("_parts")
    return own, sized.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")


def meeting(many: DataFrame, few: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of an inner join on key, both with a column _part to join on as well: where many has more than most rows of a key, these are spread over parts, and few has its rows in each part."""
    hot = many.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).join(few.select(key).distinct(), key, "left_semi").select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    hot = cut(hot)
    n = hot.count()
    if not n:
        return many.withColumn("_part", F.lit(0)), few.withColumn("_part", F.lit(0))
    near = F.broadcast(hot) if n <= 10_000 else hot
    rest = [c for c in many.columns if c != key]
    x = many.join(near, key, "left").fillna({"_parts": 1}).withColumn("_part", F.pmod(F.xxhash64(*rest), F.col("_parts")).cast("int")).drop("_parts")
    y = few.join(near, key, "left").fillna({"_parts": 1}).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return x, y
