"""Evidence contexts and prompts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as t

RULES = {
    "hybrid": "Answer only from the story evidence and the structured memory below. Cite pages as [Page n] or [Pages a-b]. If they do not settle the question, say exactly: " + t.UNKNOWN_RESPONSE,
    "story_only": "Answer only from the story evidence below. Cite pages as [Page n] or [Pages a-b]. If it does not settle the question, say exactly: " + t.UNKNOWN_RESPONSE,
}
EXTRACT = {
    "story": "List the characters, locations, relationships, events and facts of this passage as JSON.",
    "textbook": "List the concepts, definitions, formulas, processes, examples, relationships and facts of this passage as JSON.",
}


def story_section(rank: Column, chapter: Column, start: Column, end: Column, chunk: Column, text: Column) -> Column:
    show = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit("\n[STORY EVIDENCE "), rank.cast("string"), F.lit("]\n\nChapter:\n"), F.coalesce(chapter, F.lit("Unknown")), F.lit("\n\nPages:\n"), show(start), F.lit(" - "), show(F.coalesce(end, start)), F.lit("\n\nChunk ID:\n"), show(chunk), F.lit("\n\nPASSAGE:\n\n"), t.text_or_empty(text), F.lit("\n"))


def world_section(rank: Column, kind: Column, text: Column, sources: Column) -> Column:
    return F.concat(F.lit("\n[WORLD MEMORY "), rank.cast("string"), F.lit("]\n\nType:\n"), kind, F.lit("\n\nStructured knowledge:\n\n"), t.text_or_empty(text), F.lit("\n\nEvidence sources:\n"), sources, F.lit("\n"))


def joined(df: DataFrame, by: str, rank: str, text: str, sep: str = "\n") -> DataFrame:
    """(by, context): the texts of each group in order of rank. Groups are as large as k."""
    return df.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda x: x[text]), sep).alias("context"))


def batch_prompt(section: Column) -> Column:
    """The prompt for a batch of chunks, whose sections come in order; every record has to name the chunks it comes from."""
    return F.concat_ws("\n\n", F.lit(EXTRACT["story"] + " Give each record the ids of its chunks in source_chunk_ids."), section)


def character_entry(name: Column, description: Column) -> Column:
    return F.concat(F.lit("\nNAME:\n"), t.text_or_empty(name), F.lit("\n\nDESCRIPTION:\n"), t.text_or_empty(description), F.lit("\n"))


def statement_entry(subject: Column, relation: Column, object_: Column, explanation: Column) -> Column:
    return F.concat(F.lit("\n"), t.text_or_empty(subject), F.lit("\n--"), t.text_or_empty(relation), F.lit("-->\n"), t.text_or_empty(object_), F.lit("\n\nEvidence explanation:\n"), t.text_or_empty(explanation), F.lit("\n"))


def answer_prompt(arm: str, question: Column, story: Column, world: Column | None = None) -> Column:
    parts = [F.lit(RULES[arm]), F.lit("STORY EVIDENCE:"), story]
    if world is not None:
        parts += [F.lit("STRUCTURED MEMORY:"), world]
    return F.concat_ws("\n\n", *parts, F.lit("QUESTION:"), question)


def extraction_prompt(kind: str, chunk: Column, chapter: Column, text: Column) -> Column:
    if kind not in EXTRACT:
        raise ValueError(f"unknown document type: {kind}")
    return F.concat_ws("\n\n", F.lit(EXTRACT[kind]), F.concat(F.lit("Chunk "), chunk.cast("string"), F.lit(", chapter "), F.coalesce(chapter, F.lit("Unknown"))), text)
