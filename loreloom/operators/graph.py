"""The relationship graph: distinct edges, degrees, the busiest nodes and where they are drawn."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions import text as t


def distinct_edges(rel: DataFrame, by: str, ord: str) -> DataFrame:
    """Edges with both ends, the first of those equal but for letter case and outer spaces."""
    low = [F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).alias(f"k_{c}") for c in ("subject", "relation", "object")]
    k = rel.select("*", *low).filter("k_subject <> '' AND k_object <> ''")
    return k.groupBy(by, "k_subject", "k_relation", "k_object").agg(F.min(F.struct(ord, "subject", "relation", "object"))["subject"].alias("subject"), F.min(F.struct(ord, "relation"))["relation"].alias("relation"), F.min(F.struct(ord, "object"))["object"].alias("object"), F.min(ord).alias(ord)).select(by, ord, "subject", "relation", "object")


def between(edges: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """Edges both of whose ends are nodes, without self-loops."""
    n = nodes.select(by, "name").distinct()
    a = edges.join(n.withColumnRenamed("name", "subject"), [by, "subject"], "left_semi")
    return a.join(n.withColumnRenamed("name", "object"), [by, "object"], "left_semi").filter("subject <> object")


def top_nodes(edges: DataFrame, by: str, ord: str, k: int = 10) -> DataFrame:
    """(by, name, degree, rank): the k nodes with most edge ends in each group; ties by first appearance, a subject before an object."""
    ends = edges.select(by, F.col("subject").alias("name"), (F.col(ord) * 2).alias("at")).unionAll(edges.select(by, F.col("object").alias("name"), (F.col(ord) * 2 + 1).alias("at")))
    d = ends.groupBy(by, "name").agg(F.count("*").alias("degree"), F.min("at").alias("at"))
    w = Window.partitionBy(by).orderBy(F.desc("degree"), "at")
    return d.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select(by, "name", "degree", "rank")


def layout(top: DataFrame, by: str, x: float = 450, y: float = 300, radius: float = 220) -> DataFrame:
    """top with x and y on a circle, the first node above."""
    n = F.count("*").over(Window.partitionBy(by))
    angle = 2 * math.pi / n * (F.col("rank") - 1) - math.pi / 2
    return top.withColumn("x", F.round(x + radius * F.cos(angle), 4)).withColumn("y", F.round(y + radius * F.sin(angle), 4))


def neighbours(edges: DataFrame, selected: DataFrame, by: str, ord: str, k: int = 10) -> DataFrame:
    """(by, name, ord, relation, other): the first k edges of the selected node of each group, with the other end."""
    s = selected.select(by, F.col("name").alias("sel"))
    e = edges.join(s, by).filter("subject = sel OR object = sel")
    w = Window.partitionBy(by).orderBy(ord)
    return e.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).select(by, F.col("sel").alias("name"), ord, "relation", F.when(F.col("subject") == F.col("sel"), F.col("object")).otherwise(F.col("subject")).alias("other"))


def drawn(edges: DataFrame, placed: DataFrame, by: str, ord: str) -> DataFrame:
    """(by, ord, x1, y1, x2, y2): edges from the point of their subject to that of their object; edges with an end that has no point are left out."""
    at = lambda end, n: placed.select(by, F.col("name").alias(end), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    return edges.join(at("subject", 1), [by, "subject"]).join(at("object", 2), [by, "object"]).select(by, ord, "x1", "y1", "x2", "y2")


def cards(sources: DataFrame, by: str, k: int) -> DataFrame:
    """(by, card, chunk_id, chapter, page_start, page_end, excerpt): the first k different chunks of each group in order of rank."""
    best = sources.groupBy(by, "book_id", "chunk_id").agg(F.min(F.struct("rank", "chapter", "page_start", "page_end", "text")).alias("r"))
    w = Window.partitionBy(by).orderBy("r.rank")
    n = best.withColumn("card", F.row_number().over(w).cast("int")).filter(F.col("card") <= k)
    return n.select(by, "card", "chunk_id", F.coalesce("r.chapter", F.lit("Unknown")).alias("chapter"), "r.page_start", "r.page_end", t.excerpt(F.col("r.text")).alias("excerpt"))
