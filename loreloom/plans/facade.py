"""What an HTTP server would call, as plain functions over tables: checks of requests, and the rows of each endpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as t
from loreloom.operators import graph

LONGEST_QUESTION = 2000
UNAVAILABLE = "No answer could be generated right now."


class RequestError(ValueError):
    """A request that is refused, with the HTTP status that says why."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def checked_question(question: object) -> str:
    """The question without outer white space: 422 if it is no text of 1 to 2,000 characters, 400 if it is blank."""
    if not isinstance(question, str) or not 1 <= len(question) <= LONGEST_QUESTION:
        raise RequestError(422, f"question must have 1 to {LONGEST_QUESTION} characters")
    question = question.strip()
    if not question:
        raise RequestError(400, "Question cannot be empty.")
    return question


def health(**tables: DataFrame | None) -> dict:
    """ok if every table is there."""
    return {"status": "ok" if all(x is not None for x in tables.values()) else "unavailable", **{k: v is not None for k, v in tables.items()}}


def characters(items: DataFrame) -> DataFrame:
    """(name, text, sources) of the characters in the index, by name; a name that is missing is taken from the text."""
    c = items.filter("type = 'character'").withColumn("name", t.name_from_text(F.col("name"), F.col("text")))
    return c.filter("name IS NOT NULL AND name <> ''").orderBy(F.lower("name"), "world_item_id").select("name", "text", "sources")


def relationships(resolved: DataFrame | None, by: str, ord: str) -> DataFrame:
    """The distinct edges of the resolved memory; 404 where there is none."""
    if resolved is None:
        raise RequestError(404, "no resolved memory")
    return graph.distinct_edges(resolved, by, ord)


def chat(question: object, answer: Callable[[str], tuple[str, DataFrame, DataFrame]], debug: bool = False) -> dict:
    """Answer and source cards, and with debug the world evidence; whatever goes wrong inside is 503 and tells nothing of itself.

    answer: gives the answer, its story rows (rank, book_id, chunk_id, chapter, page_start, page_end, text) and its world rows (rank, type, text, sources). Both are as long as k.
    """
    asked = checked_question(question)
    try:
        text, story, world = answer(asked)
        cards = graph.cards(story.withColumn("_q", F.lit(0)), "_q", 1 << 30).orderBy("card").drop("_q", "card").collect()
        seen = world.orderBy("rank").select(F.coalesce("type", F.lit("unknown")).alias("type"), t.text_or_empty(F.col("text")).alias("text"), "sources").collect() if debug else None
    except Exception as e:
        raise RequestError(503, UNAVAILABLE) from e
    return {"answer": text, "sources": [r.asDict() for r in cards], "world_evidence": None if seen is None else [r.asDict(recursive=True) for r in seen]}
