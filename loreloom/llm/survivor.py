"""Problem 4: one surviving record for each group of records of one name, by consistent bundles.

Fields that depend on each other form bundles that are taken whole from one record or batch:
  account   description, extractor, extracted_at (all given by the record)
  origin    batch_id, extractor
  label     the spelling of the name, batch_id, extractor
Under the functional dependencies "record -> account", "batch -> extractor" and "record -> extractor" a survivor has one extractor and one batch, so the bundles
constrain each other: the batch must be the extractor's of the account, and the spelling must stand in that batch. Branch and bound takes the best
account and, with it, the origin and label whose trust together is greatest, which need not be the most trusted origin. Alternatives that cannot be part of the best
choice are pruned by aggregation beforehand, so a group meets in one task with one account an extractor and one batch for each
extractor and spelling. source_chunk_ids is the union over all members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.session import cut

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
#: Descriptions that say nothing, as their letters and digits in lower case.
PLACEHOLDERS = (
    "na", "none", "null", "nil", "nan", "unknown", "tbd", "tba", "tbc", "todo", "nodetails", "nodetail", "nonegiven", "notgiven", "nodescription", "nodescriptionavailable",
    "nodescriptiongiven", "notdescribed", "notdescribedinthispassage", "notdescribedinthetext", "notavailable", "notapplicable", "notmentioned", "notspecified", "unspecified", "mentionedonlybyname",
    "onlymentionedbyname", "mentionedbyname", "nofurtherdetails", "noinformation", "noinformationavailable", "description", "placeholder", "empty", "missing", "unclear", "undetermined", "seeabove", "asabove", "ditto",
)
#: Abbreviations after which a text does not end.
OPEN_ENDS = r"(?i)(^|[^\p{L}])(mr|mrs|ms|dr|prof|capt|st|rev|vs|cf|e\.g|i\.e|approx|no|vol|ch|fig|pp)\.$"


def norm_name(c: Column) -> Column:
    """Letter case, outer and repeated white space ignored."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS, " ")))


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), WS), lambda w: w != ""))


def usable(c: Column) -> Column:
    """Not null, blank, a placeholder or broken off: it has to end in a full stop, question or exclamation mark, or a closing quote or bracket."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x0b\x1c-\x1f\x85\p{Z}​﻿]+$", "")
    bare = F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    closed = t.rlike(r"[.!?。！？।؟][\"'”’»)\]}」』›“*_]*$") | t.rlike(r"[)\]”»」』]$")
    broken = t.rlike(r"(\.\.|…)[\"'”’»)\]}*_]*$") | t.rlike(OPEN_ENDS)
    return (bare != "") & ~bare.isin(*PLACEHOLDERS) & closed & ~broken


def _members(df: DataFrame, key: str, extractors: DataFrame) -> DataFrame:
    trust = extractors.groupBy("extractor").agg(F.max("trust").alias("trust"))
    flat = df.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), "book_id", norm_name(F.col("name")).alias("norm"), "name", "description", "extractor", "batch_id", "extracted_at", "source_chunk_ids"
    )
    # a table of a few extractors; the optimiser broadcasts it when its size allows
    return flat.filter("norm <> ''").join(trust, "extractor", "left").withColumn("trust", F.coalesce("trust", F.lit(-(1 << 31))))


def bound(options: list[list[tuple]]) -> list[tuple | None]:
    """Branch and bound over bundles.

    options: for each bundle its alternatives (score, what it fixes, payload), where what it fixes maps attributes to values, and alternatives that fix one attribute differently exclude each
    other. Takes at most one alternative of each bundle: the first bundle's has the greatest score that any has, and together with it the sum of the other scores is
    greatest; among equal sums the choice found first, by descending scores, stays. A bundle that no alternative fits, or that is in the way of better ones, stays empty (None).
    """
    ranked = [sorted(o, key=lambda x: x[0], reverse=True) for o in options]
    # what bundles k, k + 1, ... can add at most
    most = [0] * (len(ranked) + 1)
    for k in range(len(ranked) - 1, 0, -1):
        most[k] = most[k + 1] + (ranked[k][0][0] if ranked[k] else 0)
    best: list = []
    top = -1

    def search(k: int, chosen: list, fixed: dict, total: int) -> None:
        nonlocal best, top
        if k == len(ranked):
            if total > top:
                best, top = list(chosen), total
            return
        if total + most[k] <= top:
            return
        fits = [c for c in ranked[k] if all(fixed.get(a, v) == v for a, v in c[1].items())]
        for c in [*fits, None] if k or not fits else fits[:1]:  # the first bundle does not yield to the others
            search(k + 1, [*chosen, c], fixed if c is None else fixed | c[1], total + (0 if c is None or k == 0 else c[0]))

    search(0, [], {}, 0)
    return best


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for gid, first, accounts, pairs in zip(pdf["gid"], pdf["first_key"], pdf["accounts"], pdf["pairs"], strict=True):
            account = [((a["words"], a["trust"], a["at"], -a["key"]), {"extractor": a["tag"]}, a["key"]) for a in accounts if a["words"] is not None]
            origin = {(p["tag"], p["batch_id"]): (int(p["origin"]), {"extractor": p["tag"], "batch": p["batch_id"]}, p["batch_id"]) for p in pairs if p["batch_id"] is not None}
            label = [(int(p["votes"]), {"extractor": p["tag"]} | ({"batch": p["batch_id"]} if p["batch_id"] is not None else {}), p["name"]) for p in sorted(pairs, key=lambda p: p["seen_at"])]
            got = bound([account, [origin[k] for k in sorted(origin)], label])
            rows.append((gid, int(first), *(None if g is None else g[2] for g in got)))
        yield pd.DataFrame(rows, columns=["gid", "first_key", "best_key", "batch_id", "label"]).astype({"best_key": "Int64"})


def chosen(df: DataFrame, extractors: DataFrame, key: str) -> DataFrame:
    """(book_id, norm, first_key, best_key, batch_id, label) of each group of one name in one book.

    best_key is null when no member has a usable description. Rows with a null key, or a null or blank name, belong to no group; a null book_id is
    a book of its own. A key delivered again counts once. Ties end with the smaller key.
    """
    g = ["book_id", "norm"]
    m = _members(df, key, extractors)
    tag = F.coalesce(F.col("extractor"), F.lit("\u0001none"))
    micros = F.coalesce(F.unix_micros("extracted_at"), F.lit(-(1 << 62)))
    good = usable(F.col("description"))
    account = F.when(good, F.struct(n_words(F.col("description")).alias("words"), F.col("trust"), micros.alias("at"), (-F.col("key")).alias("minus_key")))
    # a batch and a spelling weigh as much as the trust of the members that have them
    weight = F.greatest(F.col("trust"), F.lit(0)).cast("bigint") + 1
    one = m.groupBy("key").agg(F.min(F.struct(*g, "name", "trust", "batch_id", tag.alias("tag"), weight.alias("weight"), account.alias("a"))).alias("r")).select("key", "r.*")
    few = one.groupBy(*g, "tag", "batch_id", "name").agg(F.sum("weight").alias("weight"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("a").alias("a"))
    few = cut(few)
    accounts = few.groupBy(*g, "tag").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("a").alias("a"))
    accounts = accounts.groupBy(*g).agg(F.min("lo").alias("first_key"), F.max("hi").alias("last_key"), F.collect_list(F.struct(F.col("a.words").alias("words"), F.col("a.trust").alias("trust"), F.col("a.at").alias("at"), (-F.col("a.minus_key")).alias("key"), "tag")).alias("accounts")).filter("first_key < last_key")
    origins = few.groupBy(*g, "tag", "batch_id").agg(F.sum("weight").alias("origin"))
    votes = few.groupBy(*g, "name").agg(F.sum("weight").alias("votes"), F.min("lo").alias("seen_at"))
    # of the batches of one extractor and spelling only the weightiest can be part of the best choice
    best = _null_safe(few.select(*g, "tag", "batch_id", "name"), origins, (*g, "tag", "batch_id")).groupBy(*g, "tag", "name").agg(F.max(F.struct("origin", "batch_id")).alias("o"))
    pairs = _null_safe(best, votes, (*g, "name")).groupBy(*g).agg(F.collect_list(F.struct("tag", F.col("o.batch_id").alias("batch_id"), F.col("o.origin").alias("origin"), "name", "votes", "seen_at")).alias("pairs"))
    gid = F.to_json(F.struct(*g))
    got = _null_safe(accounts, pairs).select(gid.alias("gid"), "first_key", "accounts", "pairs").mapInPandas(_choose, "gid string, first_key bigint, best_key bigint, batch_id string, label string")
    return got.withColumn("g", F.from_json("gid", "book_id bigint, norm string")).select("g.book_id", "g.norm", "first_key", "best_key", "batch_id", "label")


def _null_safe(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("book_id", "norm")) -> DataFrame:
    x, y = a.alias("x"), b.alias("y")
    same = reduce(lambda p, q: p & q, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in on])
    return x.join(y, same).select("x.*", *[F.col(f"y.{c}") for c in b.columns if c not in on])


def survivors(df: DataFrame, extractors: DataFrame, key: str) -> DataFrame:
    """(book_id, label, first_key, best_key, description, batch_id, source_chunk_ids): the surviving record of each group of two or more.

    source_chunk_ids is the sorted union over all members, without nulls; it is as long as the book has chunks, however many members there are.
    """
    c = chosen(df, extractors, key)
    m = _members(df, key, extractors)
    ids = m.select("book_id", "norm", F.explode("source_chunk_ids").alias("id")).filter("id IS NOT NULL").groupBy("book_id", "norm").agg(F.sort_array(F.collect_set("id")).alias("source_chunk_ids"))
    with_ids = c.alias("x").join(ids.alias("y"), F.col("x.book_id").eqNullSafe(F.col("y.book_id")) & (F.col("x.norm") == F.col("y.norm")), "left").select("x.*", "y.source_chunk_ids")
    text = m.groupBy(F.col("key").alias("best_key")).agg(F.min("description").alias("description"))
    return with_ids.join(text, "best_key", "left").select("book_id", "label", "first_key", "best_key", "description", "batch_id", "source_chunk_ids")


def found(characters: DataFrame, locations: DataFrame, extractors: DataFrame) -> DataFrame:
    """(kind, first_key, best_key) of every group with a usable description."""
    one = lambda df, key, kind: chosen(df, extractors, key).filter("best_key IS NOT NULL").select(F.lit(kind).alias("kind"), "first_key", "best_key")
    return one(characters, "char_key", "character").unionByName(one(locations, "loc_key", "location"))
