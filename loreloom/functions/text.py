"""String functions as column expressions. White space is Unicode white space throughout."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
#: Titles and the form they are compared in.
TITLES = {
    "mr": "mr", "mister": "mr", "mrs": "mrs", "miss": "miss", "ms": "ms", "dr": "dr", "doctor": "dr", "prof": "professor", "professor": "professor", "sir": "sir", "lady": "lady", "lord": "lord",
    "inspector": "inspector", "detective": "detective", "colonel": "colonel", "captain": "captain", "major": "major", "sergeant": "sergeant", "constable": "constable", "reverend": "reverend",
}
#: Fixed value: the sentence that declines an answer.
UNKNOWN_RESPONSE = "The available story evidence does not establish that."
EXCERPT = 350


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed, letter case kept; null gives an empty string."""
    return F.trim(F.regexp_replace(text_or_empty(c), WS, " "))


def norm_ws(c: Column) -> Column:
    return F.lower(clean_text(c))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def norm_nfkc(c: Column) -> Column:
    """NFKC, lower case, hyphens as spaces, other punctuation as spaces, collapsed. Only texts that are not ASCII leave the JVM."""
    x = text_or_empty(c)
    x = F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(_nfkc(x))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s]", " "), WS, " "))


def words(c: Column) -> Column:
    return F.filter(F.split(text_or_empty(c), WS), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def _may_be_heading(c: Column) -> Column:
    """Whether the text may have at most 150 characters when it is cleaned: of a long one, its beginning tells."""
    x = text_or_empty(c)
    return (F.length(x) <= 150) | (F.length(clean_text(F.left(x, F.lit(400)))) <= 150)


def is_primary_heading(c: Column) -> Column:
    x = clean_text(c)
    return _may_be_heading(c) & (x != "") & (F.length(x) <= 150) & x.rlike(r"(?i)^(chapter|part|book)\s+([0-9]+|[ivxlcdm]+)\.?(\s+.*)?$")


def is_heading(c: Column) -> Column:
    """A primary heading, a numbered one ("IV. Title"), or two to ten words in capitals without digits."""
    x = clean_text(c)
    n = F.size(F.split(x, " "))
    capitals = n.between(2, 10) & (F.upper(x) == x) & ~x.rlike(r"\p{Nd}") & x.rlike(r"\p{L}")
    return _may_be_heading(c) & (is_primary_heading(c) | (x != "") & (F.length(x) <= 150) & (x.rlike(r"^[IVXLCDM]+\.\s+[A-Za-z]") | capitals))


def is_toc_page(c: Column) -> Column:
    """A page of contents: the word itself, two lines with dot leaders, or five lines that end in a number."""
    low = F.lower(text_or_empty(c))
    lines = F.filter(F.transform(F.split(text_or_empty(c), r"\r\n|[\n\x0b\f\r]"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    many = lambda p, k: F.size(F.filter(lines, lambda x: x.rlike(p))) >= k
    # lines are looked at one by one only where the whole text has what they need
    dots = low.contains("....") & many(r"\.{4,}", 2)
    numbers = (F.regexp_count(low, F.lit(r"\d\s*(?:[\n\x0b\f\r]|$)")) >= 5) & many(r"\s\d{1,4}\s*$", 5)
    return low.contains("contents") & (low.contains("table of contents") | low.rlike(r"\bcontents\b")) | dots | numbers


def is_text_block(c: Column) -> Column:
    """Neither empty nor a bare page number."""
    x = clean_text(c)
    return (x != "") & ~x.rlike(r"^\d+$")


def title_of(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    return F.try_element_at(table, F.try_element_at(tokens, F.lit(1)))


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(norm_nfkc(c), " "), lambda w: w != "")


def core_tokens(tokens: Column) -> Column:
    return F.when(title_of(tokens).isNotNull(), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1)))).otherwise(tokens)


def name_score(c: Column) -> Column:
    """How good a canonical name is: many words, long, more than one word, with a title."""
    t = name_tokens(c)
    core = core_tokens(t)
    return 100 * F.size(core) + F.length(c) + F.when(F.size(core) >= 2, 200).otherwise(0) + F.when(title_of(t).isNotNull(), 10).otherwise(0)


def excerpt(c: Column, most: int = EXCERPT) -> Column:
    x = clean_text(c)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.left(x, F.lit(most))), F.lit("...")))


def name_from_text(name: Column, text: Column) -> Column:
    """name, else what a text "Character: X. ..." says before the first full stop."""
    head = F.trim(F.regexp_replace(F.substring_index(text, ".", 1), "Character:", ""))
    return F.when(text_or_empty(name) != "", name).when(text.startswith("Character:"), head)


def has_page_citation(c: Column) -> Column:
    return text_or_empty(c).rlike(r"(?i)\[Pages?\s+[0-9]+")


def correctly_refused(c: Column) -> Column:
    return norm_ws(c).contains(norm_ws(F.lit(UNKNOWN_RESPONSE)))


def retry_seconds(c: Column, default: float = 30.0, after: bool = True) -> Column:
    """The wait an error text asks for: "retry in" with two seconds more; then, where allowed, "retry after"; else the default."""
    first = F.regexp_extract(text_or_empty(c), r"(?i)retry in ([0-9.]+)s", 1).try_cast("double") + 2
    later = F.regexp_extract(text_or_empty(c), r"(?i)retry after ([0-9.]+)s", 1).try_cast("double")
    return F.coalesce(first, later, F.lit(default)) if after else F.coalesce(first, F.lit(default))


def humanise(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def pretty_relation(c: Column) -> Column:
    """Underscores as spaces and the first letter of every run of letters and digits in upper case, the rest as it is: "half-brother_of" gives "Half-Brother Of"."""
    runs = F.regexp_extract_all(humanise(c), F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))).otherwise(w)), "")


def short_name(c: Column) -> Column:
    s = F.split(c, " ")
    return F.when(F.size(s) <= 2, c).otherwise(F.concat_ws(" ", F.element_at(s, 1), F.element_at(s, -1)))


def page_label(start: Column, end: Column) -> Column:
    return F.concat(F.lit("Pages "), start.cast("string"), F.when((end != start) & end.isNotNull(), F.concat(F.lit("–"), end.cast("string"))).otherwise(""))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n != 1, "s").otherwise(""))


def source_label(chapter: Column, start: Column, end: Column, chunk: Column) -> Column:
    show = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit("Chapter="), F.coalesce(chapter, F.lit("Unknown")), F.lit(", Pages="), show(start), F.lit("-"), show(F.coalesce(end, start)), F.lit(", Chunk="), show(chunk))


def source_list(sources: Column) -> Column:
    """The labels of an array of sources (structs of chapter, page_start, page_end, chunk_id) on one line."""
    labels = F.transform(sources, lambda s: source_label(s["chapter"], s["page_start"], s["page_end"], s["chunk_id"]))
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.array_join(labels, " | ")).otherwise("No source metadata")
