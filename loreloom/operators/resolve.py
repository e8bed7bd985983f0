"""Conservative alias resolution by rules, in closed form: windows and one equi-join instead of union-find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions import text as t
from loreloom.session import cut

#: Changed names that are broadcast; they take well under 100 MB.
FEW_NAMES = 200_000


def same_names(names: DataFrame, by: str = "book_id", name: str = "name", ord: str = "ord", strict_titles: bool = False) -> DataFrame:
    """names (by, name, ord; name distinct within by) with title, core and comp, the component each belongs to.

    Equal core words merge unless only titles tell them apart; a single word joins the one full name that ends in it, if titles allow and no
    two titles claim the bare word. With strict_titles, full names with different titles stay apart even if the bare name occurs too.
    """
    tokens = t.name_tokens(F.col(name))
    n = names.withColumn("title", t.title_of(tokens)).withColumn("_core", t.core_tokens(tokens)).withColumn("core", F.array_join("_core", " ")).withColumn("n_tokens", F.size("_core"))
    w = Window.partitionBy(by, "core")
    n = n.withColumn("has_bare", F.max(F.col("title").isNull()).over(w)).withColumn("n_titles", F.size(F.collect_set("title").over(w)))
    titled = F.concat_ws("|", F.col("core"), F.coalesce("title", F.lit("")))
    every = F.concat(F.col("core"), F.lit("|*"))
    many = F.col("has_bare") & (F.col("n_titles") <= 1) if strict_titles else F.col("has_bare")
    comp = F.when(F.col("n_tokens") == 0, F.concat(F.lit("#"), F.col(ord).cast("string"))).when(F.col("n_tokens") >= 2, F.when(many, every).otherwise(titled)).when(F.col("n_titles") <= 1, every).otherwise(titled)
    n = n.withColumn("comp", comp).drop("_core")
    full = n.filter("n_tokens >= 2").select(F.col(by), F.element_at(F.split("core", " "), -1).alias("core"), F.col("title").alias("f_title"), F.col("comp").alias("f_comp"))
    short = n.filter("n_tokens = 1 AND NOT (title IS NULL AND n_titles > 1)").select(by, "core", "title", ord)
    fits = F.col("title").isNull() | F.col("f_title").isNull() | (F.col("title") == F.col("f_title"))
    # the least and the greatest fitting component: equal when there is just one
    target = short.join(full, [by, "core"]).filter(fits).groupBy(by, ord).agg(F.min("f_comp").alias("lo"), F.max("f_comp").alias("hi")).filter("lo = hi").select(by, ord, F.col("lo").alias("target"))
    out = n.join(target, [by, ord], "left")
    return out.withColumn("comp", F.coalesce(F.max("target").over(Window.partitionBy(by, "comp")), F.col("comp"))).drop("target", "has_bare", "n_titles", "n_tokens")


def alias_map(resolved: DataFrame, by: str = "book_id", name: str = "name", ord: str = "ord") -> DataFrame:
    """(by, alias_key, canonical): one row per normalised alias; where groups share a key, the last group's canonical name wins."""
    best = resolved.groupBy(by, "comp").agg(F.max(F.struct(t.name_score(F.col(name)).alias("s"), (-F.col(ord)).alias("o"), F.col(name).alias("v")))["v"].alias("canonical"), F.min(ord).alias("g"))
    keyed = resolved.join(best, [by, "comp"]).withColumn("alias_key", t.norm_nfkc(F.col(name)))
    return keyed.filter("alias_key <> ''").groupBy(by, "alias_key").agg(F.max(F.struct("g", F.col("canonical").alias("v")))["v"].alias("canonical"))


def report(resolved: DataFrame, by: str = "book_id", name: str = "name", ord: str = "ord") -> DataFrame:
    """(by, comp, canonical, aliases): every component with its spellings, once each, in order of appearance."""
    a = resolved.groupBy(by, "comp").agg(
        F.max(F.struct(t.name_score(F.col(name)).alias("s"), (-F.col(ord)).alias("o"), F.col(name).alias("v")))["v"].alias("canonical"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord).alias("o"), F.col(name).alias("v")))), lambda x: x["v"])).alias("aliases")
    )
    return a


def longest_names(names: DataFrame, by: str = "book_id", name: str = "name", ord: str = "ord") -> DataFrame:
    """(by, alias_key, canonical) for places: the longest spelling of each normalised name, the first among equals."""
    return names.withColumn("alias_key", t.norm_nfkc(F.col(name))).filter("alias_key <> ''").groupBy(by, "alias_key").agg(F.max(F.struct(F.length(name).alias("l"), (-F.col(ord)).alias("o"), F.col(name).alias("v")))["v"].alias("canonical"))


def resolve(df: DataFrame, column: str, first: DataFrame, second: DataFrame | None = None, by: str = "book_id", key: Column | None = None) -> DataFrame:
    """df with column replaced by its canonical name: from the first map, then the second, else as it is. key: how column is looked up.

    Every different name is looked up once. The names that change are broadcast up to FEW_NAMES of them, so that rows need not be shuffled; more are joined by a shuffle.
    """
    d = df.select(by, column).filter(F.col(column).isNotNull()).distinct().withColumn("alias_key", key if key is not None else t.norm_nfkc(F.col(column)))
    d = d.join(first.withColumnRenamed("canonical", "_c1"), [by, "alias_key"], "left")
    got = F.col("_c1")
    if second is not None:
        d = d.join(second.withColumnRenamed("canonical", "_c2"), [by, "alias_key"], "left")
        got = F.coalesce(got, F.col("_c2"))
    changed = cut(d.select(by, column, got.alias("_new")).filter(F.col("_new") != F.col(column)))
    near = F.broadcast(changed) if changed.count() <= FEW_NAMES else changed
    return df.join(near, [by, column], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def valid_plan(groups: DataFrame, names: DataFrame, by: str = "book_id", ord: str = "ord") -> DataFrame:
    """(by, alias_key, canonical) from a merge plan: groups of high confidence whose names exist, taken in order unless an alias is already another's.

    A plan is a small table of proposals; those of one book are folded in order inside one aggregate of that book's valid groups.
    """
    known = names.select(by, F.col("name").alias("canonical")).filter("canonical IS NOT NULL").distinct()
    g = groups.filter("confidence = 'high'").join(known, [by, "canonical"], "left_semi").select(by, ord, "canonical", F.posexplode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("canonical"))).alias("pos", "alias"))
    ok = g.join(known.select(by, F.col("canonical").alias("alias")), [by, "alias"], "left_semi").groupBy(by, ord, "canonical").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "alias"))), lambda x: x["alias"]).alias("aliases")).filter(F.size("aliases") >= 2)
    ok = ok.withColumn("keys", F.transform("aliases", lambda a: F.lower(F.trim(F.regexp_replace(a, t.WS, " ")))))
    seq = ok.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(ord, "canonical", "keys"))).alias("plan"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def step(acc: Column, p: Column) -> Column:
        clash = F.exists(p["keys"], lambda k: F.coalesce(F.try_element_at(acc, k) != p["canonical"], F.lit(False)))
        fresh = F.filter(F.array_distinct(p["keys"]), lambda k: ~F.map_contains_key(acc, k))
        return F.when(clash, acc).otherwise(F.map_concat(acc, F.map_from_arrays(fresh, F.transform(fresh, lambda _: p["canonical"]))))

    return seq.select(by, F.explode(F.aggregate("plan", empty, step)).alias("alias_key", "canonical"))
