"""From page blocks to chapter-aware, overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as t
from loreloom.operators.ordered import carried, placed
from loreloom.session import cut

TARGET, MOST, LEAST, PIECE = 220, 300, 25, 220
FIRST_CHAPTER = "Story Beginning"


def story_start(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, start): first page with a primary heading that is no page of contents, else first with 150 words or more, else 1. pages: doc, page, blocks, raw_text."""
    toc = t.is_toc_page(F.col("raw_text"))
    headed = F.exists("blocks", lambda b: t.is_primary_heading(b))
    full = F.size(F.filter(F.split(F.array_join("blocks", " "), t.WS), lambda w: w != "")) >= 150
    return pages.groupBy(doc).agg(F.coalesce(F.min(F.when(headed & ~toc, F.col("page"))), F.min(F.when(full & ~toc, F.col("page"))), F.lit(1)).alias("start"))


def carry_chapters(blocks: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("page", "block_ord"), span: int = 64) -> DataFrame:
    """blocks with is_heading, chapter (the last heading so far) and island (runs of one chapter). A task takes span of the first column of the order, so a very long document lies in many. Blocks without a document are left out."""
    h = blocks.withColumn("is_heading", t.is_heading(F.col("text")))
    h = h.withColumn("_heading", F.when(F.col("is_heading"), t.clean_text(F.col("text"))))
    return carried(h, doc, list(order), "_heading", FIRST_CHAPTER, "chapter", "island", F.floor(F.col(order[0]) / span)).drop("_heading")


def headings(blocks: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("page", "block_ord")) -> DataFrame:
    """(doc, page, order, chapter): every heading, as the list of chapters of a document."""
    return blocks.filter(t.is_heading(F.col("text"))).select(doc, "page", *[c for c in order if c != "page"], t.clean_text(F.col("text")).alias("chapter"))


def from_start(blocks: DataFrame, starts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The blocks from the page on which the story of their document starts."""
    return blocks.join(starts, doc).filter(F.col("page") >= F.col("start")).drop("start")


def split_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks over MOST words as pieces of PIECE words; other blocks as piece 0. Adds piece and words."""
    w = blocks.withColumn("_w", t.words(F.col("text")))
    n = F.size("_w")
    slices = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(PIECE)), lambda i: F.array_join(F.slice(F.col("_w"), i + 1, F.lit(PIECE)), " "))
    out = w.select("*", F.posexplode(F.when(n > MOST, slices).otherwise(F.array("text"))).alias("piece", "_text")).drop("_w", "text").withColumnRenamed("_text", "text")
    return out.withColumn("words", t.word_count(F.col("text")))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy chunks over rows sorted by island and order, with two integers of state."""
    at, cur, prev, seq, last = None, 0, 0, 0, (0, 0)
    for pdf in batches:
        out = []
        for d, i, o, q, w in zip(pdf["d"], pdf["island"], pdf["o"], pdf["q"], pdf["words"], strict=True):
            if (d, i) != at:
                at, cur, prev, seq = (d, i), 0, 0, 0
            elif cur >= TARGET:
                out.append((d, i, *last, seq + 1))  # the block before opens the next chunk
                cur, seq = prev, seq + 1
            out.append((d, i, o, q, seq))
            cur, prev, last = cur + w, w, (o, q)
        yield pd.DataFrame(out, columns=["d", "island", "o", "q", "seq"])


def chunk_members(blocks: DataFrame, doc: str = "doc_id", order: tuple[str, str] = ("block_ord", "piece")) -> DataFrame:
    """(doc, island, *order, seq): the chunk or chunks of each block; blocks has doc, island, the two columns of its order in the doc, and words.

    Islands are streamed in order through a fold that holds two integers, so an island may be of any length.
    """
    rows = blocks.select(F.col(doc).alias("d"), "island", F.col(order[0]).cast("bigint").alias("o"), F.col(order[1]).cast("int").alias("q"), "words").repartition("d", "island").sortWithinPartitions("d", "island", "o", "q")
    kind = dict(blocks.dtypes)[doc]
    return rows.mapInPandas(_fold, f"d {kind}, island int, o bigint, q int, seq int").withColumnsRenamed({"d": doc, "o": order[0], "q": order[1]})


def chunks(blocks: DataFrame, doc: str = "doc_id", order: tuple[str, str] = ("block_ord", "piece")) -> DataFrame:
    """(doc, chunk_id, page_start, page_end, chapter, word_count, text) from blocks with doc, their order, page, chapter, island, words, text. Chunks under LEAST words are dropped before ids are given."""
    blocks = cut(blocks)  # read by the fold and for the texts
    m = chunk_members(blocks, doc, order).join(blocks, [doc, "island", *order])
    o = F.struct(*order)
    g = m.groupBy(doc, "island", "seq").agg(
        F.min_by("page", o).alias("page_start"), F.max_by("page", o).alias("page_end"), F.min_by("chapter", o).alias("chapter"), F.sum("words").cast("int").alias("word_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), "text"))), lambda x: x["text"]), "\n\n").alias("text")
    )
    kept = g.filter(F.col("word_count") >= LEAST)
    return placed(kept, doc, ["island", "seq"], "chunk_id", F.col("island")).select(doc, F.col("chunk_id").cast("int").alias("chunk_id"), "page_start", "page_end", "chapter", "word_count", "text")


def first_chunks(todo: DataFrame, most: int | None, *order: str) -> DataFrame:
    """The first chunks in order, for a trial run; all of them where most is None."""
    return todo if most is None else todo.orderBy(*order).limit(most)


def batches(todo: DataFrame, done: DataFrame, key: str = "chunk_id", by: str = "book_id", size: int = 18) -> DataFrame:
    """Rows of todo not in done, with a batch number: runs of size rows in order of key (a number) within each group. Rows of a null group are left out."""
    left = todo.join(done.select(by, key).distinct(), [by, key], "left_anti")
    return placed(left, by, [key], "_n", F.floor(F.col(key) / 4096)).withColumn("batch", F.floor(F.col("_n") / size).cast("int")).drop("_n")
