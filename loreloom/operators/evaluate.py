"""Scoring of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as t


def concept_coverage(text: Column, groups: Column) -> Column:
    """Share of groups one of whose alternatives is in the text; no groups give 1, an empty group never matches."""
    x = t.norm_ws(text)
    hit = F.size(F.filter(groups, lambda g: F.exists(g, lambda a: x.contains(t.norm_ws(a)))))
    return F.when(F.size(groups) > 0, hit / F.size(groups)).otherwise(F.lit(1.0))


def score_answer(answer: Column, groups: Column, unanswerable: Column) -> Column:
    """struct(concept_coverage, citation, correct_refusal, quality_score), rounded to four places."""
    refused = t.correctly_refused(answer)
    cover = concept_coverage(answer, groups)
    cites = t.has_page_citation(answer)
    one = F.when(refused, 1.0).otherwise(0.0)
    return F.struct(
        F.when(unanswerable, one).otherwise(F.round(cover, 4)).alias("concept_coverage"),
        (~unanswerable & cites).alias("citation"),
        (unanswerable & refused).alias("correct_refusal"),
        F.when(unanswerable, one).otherwise(F.round(0.8 * cover + F.when(cites, 0.2).otherwise(0.0), 4)).alias("quality_score"),
    )


def winner(story: Column, hybrid: Column) -> Column:
    return F.when(hybrid > story, "hybrid").when(story > hybrid, "story_only").otherwise("tie")


def summary(results: DataFrame) -> DataFrame:
    """One row of averages and counts; results has story_q, hybrid_q, story_c, hybrid_c and winner."""
    mean = lambda c: F.round(F.avg(c), 4)
    return results.agg(
        F.count("*").alias("questions"), mean("story_q").alias("story_only_average_score"), mean("hybrid_q").alias("hybrid_average_score"), mean("story_c").alias("story_only_average_coverage"), mean("hybrid_c").alias("hybrid_average_coverage"),
        F.count_if(F.col("winner") == "hybrid").alias("hybrid_wins"), F.count_if(F.col("winner") == "story_only").alias("story_only_wins"), F.count_if(F.col("winner") == "tie").alias("ties"),
    )
