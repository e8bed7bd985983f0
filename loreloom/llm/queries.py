"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.llm import copies, leaks, names, nearby, oracles, packing, pairs, scans, sentences, splitting, survivor
from loreloom.session import cut, table


def limit_of(spark: SparkSession, d: str, name: str) -> int:
    return table(spark, d, "limits").filter(F.col("limit_name") == name).first()["limit_value"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nearby.found(table(spark, d, "event_extractions"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearby.groups(table(spark, d, "event_extractions"), 0.6)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.found(table(spark, d, "character_extractions"), table(spark, d, "semantic_entity_aliases"))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.resolve(table(spark, d, "character_extractions"), table(spark, d, "semantic_entity_aliases"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "evaluation_results"))


def p3_defects(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "evaluation_results"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.found(table(spark, d, "character_extractions"), table(spark, d, "location_extractions"), table(spark, d, "extractors"))


def p4_characters(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "character_extractions"), table(spark, d, "extractors"), "char_key")


def p4_locations(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "location_extractions"), table(spark, d, "extractors"), "loc_key")


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    """(kind, first_key, best_key, source_chunk_ids as JSON) of every survivor, whether or not a member has a usable description."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "first_key", "best_key", F.coalesce(F.to_json("source_chunk_ids"), F.lit("[]")).alias("source_chunk_ids"))
    return one(p4_characters(spark, d), "character").unionByName(one(p4_locations(spark, d), "location"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(table(spark, d, "chunks"), limit_of(spark, d, "chunk_max"), limit_of(spark, d, "chunk_overlap"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "chunks"), limit_of(spark, d, "chunk_max"), limit_of(spark, d, "chunk_overlap"))


def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_key, words, within): the words that the pieces of a chunk cover, each once, and whether every piece keeps the limit and repeats at most half as much again as asked."""
    most, overlap = limit_of(spark, d, "chunk_max"), limit_of(spark, d, "chunk_overlap")
    p = p5_pieces(spark, d)
    fits = (F.col("words") <= most) & (splitting.n_words(F.col("text")) == F.col("words")) & F.when(F.col("piece") == 0, F.col("overlap") == 0).otherwise(F.col("overlap").between(overlap // 2, overlap + overlap // 2))
    return p.groupBy("chunk_key").agg(F.sum(F.col("words") - F.col("overlap")).alias("words"), F.min(fits).alias("within"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(table(spark, d, "chunks"), table(spark, d, "books"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "chunks"), table(spark, d, "books"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "relationship_extractions"))


def p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, "relationship_extractions"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), limit_of(spark, d, "container_capacity"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, tokens, pieces, within): every document's tokens over its pieces, how many it is in, and whether all its containers keep the capacity."""
    capacity = limit_of(spark, d, "container_capacity")
    p = cut(p8_containers(spark, d))
    load = p.groupBy("container").agg(F.sum("tokens").alias("load"))
    return p.join(load, "container").groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.min(F.col("load") <= capacity).alias("within"))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    """(tokens, tight): all tokens, and whether the containers are at most one in a hundred, and one, more than the least that could hold them."""
    capacity = limit_of(spark, d, "container_capacity")
    p = p8_containers(spark, d).groupBy("container").agg(F.sum("tokens").alias("load"))
    return p.agg(F.sum("load").alias("tokens"), (F.count("*") <= F.ceil(F.sum("load") / capacity) * 1.01 + 1).alias("tight"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "test_items"))


def p9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leaks.overlaps(table(spark, d, "documents"), table(spark, d, "test_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(table(spark, d, "documents"))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
