"""Schemas of the documents that are read and written, and the profiles of structured memories."""

from __future__ import annotations

SOURCE = "struct<chunk_id:int,chapter:string,page_start:int,page_end:int>"
CHUNK = "chunk_id int, page int, page_start int, page_end int, chapter string, word_count int, text string"
PAGE = "page int, raw_text string, blocks array<string>, is_toc boolean"
QUESTION = "id int, question string, category string, expected_groups array<array<string>>, unanswerable boolean"
FIELDS = {
    "characters": "name string, description string",
    "locations": "name string, description string",
    "relationships": "subject string, relation string, object string, explanation string",
    "events": "summary string, participants array<string>, location string, explanation string",
    "facts": "subject string, predicate string, object string, explanation string",
    "concepts": "name string, explanation string",
    "definitions": "term string, definition string",
    "formulas": "name string, formula string, variables array<string>, explanation string",
    "processes": "name string, steps array<string>, explanation string",
    "examples": "topic string, summary string",
}
#: Per document type: the categories in order, each with the columns that make its key.
PROFILES: dict[str, dict[str, tuple[str, ...]]] = {
    "story": {"characters": ("name",), "locations": ("name",), "relationships": ("subject", "relation", "object"), "events": ("summary",), "facts": ("subject", "predicate", "object")},
    "textbook": {"concepts": ("name",), "definitions": ("term",), "formulas": ("name", "formula"), "processes": ("name",), "examples": ("topic", "summary"), "relationships": ("subject", "relation", "object"), "facts": ("subject", "predicate", "object")},
}
WORLD = "processed_chunk_ids array<int>, " + ", ".join(f"{c} array<struct<{FIELDS[c].replace(' ', ':').replace(',:', ',')},sources:array<{SOURCE}>>>" for c in PROFILES["story"])


def profile(kind: str) -> dict[str, tuple[str, ...]]:
    """The categories of a document type; an unknown type is an error."""
    if kind not in PROFILES:
        raise ValueError(f"unknown document type: {kind}")
    return PROFILES[kind]
