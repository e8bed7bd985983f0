"""Keyed merges in which the first row wins, the longest text may win, and sources are united in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as t
from loreloom.sources import schemas


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key of rows delivered again: the first delivery. Null keys are left out."""
    rest = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.coalesce(F.col("loaded_at"), F.lit("9999-12-31").cast("timestamp"))).alias("_r")).select(key, "_r.*")


def ordered_merge(df: DataFrame, by: dict[str, Column], ord: str, first: tuple[str, ...] = (), longest: tuple[str, ...] = (), sources: str | None = None, keep_blank: bool = False) -> DataFrame:
    """One row per key: n, first_ord, the first row's columns, the longest text of the longest columns (the first among equals), and the distinct sources in order of appearance.

    by names the key columns. Rows with an empty string in all key columns but the first are dropped unless keep_blank. ord must be unique.
    """
    k = df.select("*", *[c.alias(f"k_{n}") for n, c in by.items()])
    keys = [f"k_{n}" for n in by]
    if not keep_blank:
        full = None
        for n in keys[1:] or keys:
            full = (F.col(n) != "") if full is None else full & (F.col(n) != "")
        k = k.filter(full)
    aggs = [F.count("*").alias("n"), F.min(ord).alias("first_ord")]
    aggs += [F.min(F.struct(F.col(ord).alias("o"), F.col(c).alias("v")))["v"].alias(c) for c in first]
    aggs += [F.max(F.struct(F.length(F.coalesce(F.col(c), F.lit(""))).alias("l"), (-F.col(ord)).alias("o"), F.col(c).alias("v")))["v"].alias(c) for c in longest]
    out = k.groupBy(*keys).agg(*aggs)
    if sources:
        s = k.select(*keys, ord, F.posexplode(sources).alias("pos", "src")).filter("src IS NOT NULL").groupBy(*keys, "src").agg(F.min(F.struct(ord, "pos")).alias("at"))
        s = s.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "src"))), lambda x: x["src"]).alias("sources"))
        same = None
        for n in keys:
            c = F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
            same = c if same is None else same & c
        out = out.alias("a").join(s.alias("b"), same, "left").select("a.*", F.coalesce("b.sources", F.array().cast(dict(df.dtypes)[sources])).alias("sources"))
    return out


def processed_ids(df: DataFrame, by: str, ids: str) -> DataFrame:
    """(by, id): the distinct ids of each group, one a row, so that no group has to fit into one."""
    return df.select(by, F.explode(ids).alias("id")).filter("id IS NOT NULL").distinct()


def structured(df: DataFrame, kind: str, category: str, ord: str, by: tuple[str, ...] = (), sources: str | None = None) -> DataFrame:
    """Records of one category of a document type, merged by the key its profile gives: the first row of each key stays as it is, and sources are united. Blank keys are kept."""
    keys = schemas.profile(kind)[category]
    rest = tuple(c for c in df.columns if c not in (*by, ord, sources))
    return ordered_merge(df, {**{b: F.col(b) for b in by}, **{k: t.norm_ws(F.col(k)) for k in keys}}, ord, rest, sources=sources, keep_blank=True)


def extracted(extractions: DataFrame, kind: str, key: str = "chunk_id", column: str = "extraction") -> dict[str, DataFrame]:
    """The records of every category of a document type from extractions, one struct of arrays a chunk: each with the chunk as its one source and an order by chunk, then place in the array.

    Merging each of these once gives what folding one extraction after another in the order of chunks would give.
    """
    out = {}
    for category in schemas.profile(kind):
        x = extractions.select(F.col(key).alias("_chunk"), F.posexplode(F.col(f"{column}.{category}")).alias("_pos", "_r"))
        out[category] = x.select("_r.*", (F.col("_chunk").cast("bigint") * (1 << 32) + F.col("_pos")).alias("ord"), F.array(F.col("_chunk").cast("int")).alias("source_chunk_ids"))
    return out


def sources_of(df: DataFrame, ids: str, chunks: DataFrame, key: str, by: str = "book_id", batch: str | None = None) -> DataFrame:
    """(key, pos, chunk_id, ...): the chunks that a row names as its sources, once each, at the position where it first names them. chunks: by, chunk_id and what a source shows.

    Ids that are no numbers or no chunks are left out; with batch, a column of chunks, so are those outside the batch of the first chunk that is named.
    """
    named = df.select(key, by, F.posexplode(ids).alias("pos", "_id")).select(key, by, "pos", F.col("_id").try_cast("int").alias("chunk_id")).filter("chunk_id IS NOT NULL")
    first = named.groupBy(key, by, "chunk_id").agg(F.min("pos").alias("pos")).join(chunks, [by, "chunk_id"])
    if batch:
        of = first.groupBy(key).agg(F.min_by(batch, "pos").alias("_batch"))
        first = first.join(of, key).filter(F.col(batch) == F.col("_batch")).drop("_batch")
    return first
