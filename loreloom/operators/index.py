"""One typed index over characters, locations, relationships, facts and events, with dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as t
from loreloom.operators.ordered import numbered

RANKS = {"character": 0, "location": 1, "relationship": 2, "fact": 3, "event": 4}


def named_text(kind: str, name: Column, description: Column) -> Column:
    return F.concat(F.lit(f"{kind}: "), t.text_or_empty(name), F.lit(". "), t.text_or_empty(description))


def statement_text(subject: Column, relation: Column, object_: Column, explanation: Column) -> Column:
    return F.concat(t.text_or_empty(subject), F.lit(" "), t.humanise(t.text_or_empty(relation)), F.lit(" "), t.text_or_empty(object_), F.lit(". "), t.text_or_empty(explanation))


def event_text(summary: Column, participants: Column, location: Column, explanation: Column) -> Column:
    where = F.when(t.text_or_empty(location) != "", F.concat(F.lit("Location: "), location, F.lit(". "))).otherwise("")
    return F.concat(F.lit("Event: "), t.text_or_empty(summary), F.lit(". Participants: "), F.array_join(F.coalesce(participants, F.array().cast("array<string>")), ", "), F.lit(". "), where, t.text_or_empty(explanation))


def items(parts: dict[str, DataFrame]) -> DataFrame:
    """(type_rank, type, ord, text, ...): the parts one under another; each has ord, text and columns of its own."""
    out = None
    for kind, df in parts.items():
        x = df.withColumn("type", F.lit(kind)).withColumn("type_rank", F.lit(RANKS[kind]))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def dense_ids(df: DataFrame, order: list[str], name: str = "world_item_id") -> DataFrame:
    """df with ids from 0 in the given order (which must be unique): ranges are sorted apart, and each starts where the sizes of those before end."""
    return numbered(df, order, name)
