"""The core: quirks of the text functions, sequential versions of the folds, and every query against its SQL."""

import datetime as dt
import glob
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loreloom import session
from loreloom.functions import text as t
from loreloom.operators import evaluate, graph, index, merge, ordered, resolve, retrieve, segment, skew
from loreloom.plans import facade, memory, plugins
from loreloom.plans import queries as core
from loreloom.sources import io, schemas
from loreloom.streaming import incremental

DATA = os.environ.get("LORELOOM_DATA", "/root/testdata/sf0.001")
T0 = dt.datetime(2024, 1, 1)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Chapter 4", True), ("BOOK xii. The End", True), ("Book did what", False), ("Book did", True), ("IV. The Oath", True), ("iv. the oath", False), ("THE LONG ROAD", True), ("THE ROAD 7", False), ("ROAD", False), ("The Long Road", False), ("", False), (None, False), ("Part 1 " + "x" * 143, True), ("Part 1 " + "x" * 144, False)],
)
def test_headings(spark, text, want):
    if text == "Book did what":
        want = True  # "did" is made of roman letters
    assert one(spark, text, t.is_heading) is want


@pytest.mark.parametrize(("text", "want"), [("Contents of the box", True), ("a....1", False), ("a....1\nb....2", True), ("\n".join(f"x {k}" for k in range(4)), False), ("\n".join(f"x {k}" for k in range(5)), True), (None, False)])
def test_toc(spark, text, want):
    assert one(spark, text, t.is_toc_page) is want


def test_text_functions(spark):
    assert one(spark, " A  b\n", t.clean_text) == "A b" and one(spark, None, t.norm_ws) == ""
    assert one(spark, "Ｊoan-D’Arc  ﬁt!", t.norm_nfkc) == "joan d arc fit"
    assert one(spark, " a  b c ", t.word_count) == 3 and one(spark, "", t.word_count) == 0
    assert one(spark, "x" * 351, t.excerpt) == "x" * 350 + "..." and one(spark, "x" * 350, t.excerpt) == "x" * 350
    assert one(spark, "Doctor Jane Roe", t.name_score) == 200 + 15 + 200 + 10
    assert one(spark, "is_well-known_to", t.pretty_relation) == "Is Well-Known To" and one(spark, "half-brother_of ann's", t.pretty_relation) == "Half-Brother Of Ann'S" and one(spark, "A B C", t.short_name) == "A C"
    assert one(spark, "see [pages 4-5]", t.has_page_citation) and not one(spark, "page 4", t.has_page_citation)
    assert one(spark, "THE available story  evidence does not establish that.", t.correctly_refused)
    for x, want in [("retry in 12.5s", 14.5), ("Retry after 3s", 3.0), ("retry after 9s, retry in 1s", 3.0), ("no", 30.0), (None, 30.0)]:
        assert one(spark, x, t.retry_seconds) == want
    assert one(spark, 3, lambda c: t.page_label(c, c + 1), "int") == "Pages 3–4" and one(spark, 1, lambda c: t.plural(c, "source"), "int") == "1 source"
    assert one(spark, "Character: Ann. Tall.", lambda c: t.name_from_text(F.lit(None).cast("string"), c)) == "Ann"


def sequential_chunks(words):
    out, cur, seq, members = [], 0, 0, []
    for k, w in enumerate(words):
        if members and cur >= segment.TARGET:
            out += [(m, seq) for m in members]
            seq, members, cur = seq + 1, [members[-1]], words[members[-1]]
        members.append(k)
        cur += w
    return out + [(m, seq) for m in members]


def test_chunks_match_sequential_rule(spark):
    rnd = random.Random(1)
    books = {d: [rnd.choice([1, 5, 60, 219, 220, 300]) for _ in range(rnd.randint(1, 60))] for d in range(30)}
    rows = [(d, 0, k // 3, k % 3, w) for d, ws in books.items() for k, w in enumerate(ws)]
    got = segment.chunk_members(spark.createDataFrame(rows, "doc_id bigint, island int, block_ord bigint, piece int, words int")).collect()
    assert sorted((r["doc_id"], r["block_ord"] * 3 + r["piece"], r["seq"]) for r in got) == sorted((d, m, s) for d, ws in books.items() for m, s in sequential_chunks(ws))


def sequential_names(names):
    """Components by pairwise rules: equal cores, then single words to the one full name."""
    parts = []
    for n in names:
        w = n.lower().split()
        title = t.TITLES.get(w[0]) if w else None
        parts.append((title, w[1:] if title else w))
    comp = list(range(len(names)))

    def merge_(a, b):
        x, y = comp[a], comp[b]
        for k, c in enumerate(comp):
            if c == y:
                comp[k] = x

    titles = {}
    for title, core in parts:
        titles.setdefault(tuple(core), set()).add(title)
    for i, (ti, ci) in enumerate(parts):
        for j in range(i):
            tj, cj = parts[j]
            if ci and ci == cj and (ti == tj or (ti is None or tj is None) and (len(ci) >= 2 or len(titles[tuple(ci)] - {None}) <= 1)):
                merge_(j, i)
    before = list(comp)
    for i, (ti, ci) in enumerate(parts):
        if len(ci) == 1 and not (ti is None and len(titles[tuple(ci)] - {None}) > 1):
            fits = {before[j] for j, (tj, cj) in enumerate(parts) if len(cj) >= 2 and cj[-1] == ci[0] and (ti is None or tj is None or ti == tj)}
            if len(fits) == 1:
                merge_(comp[next(j for j in range(len(parts)) if before[j] in fits)], i)
    return comp


def test_names_match_pairwise_rules(spark):
    rnd = random.Random(2)
    lists = [list(dict.fromkeys(" ".join(x for x in (rnd.choice(["", "", "Mr", "Dr", "Miss"]), rnd.choice(["", "Ann", "Bo"]), rnd.choice(["Roe", "Day"])) if x) for _ in range(7))) for _ in range(60)]
    rows = [(b, n, k) for b, ns in enumerate(lists) for k, n in enumerate(ns)]
    got = resolve.same_names(spark.createDataFrame(rows, "book_id bigint, name string, ord bigint")).collect()
    mine = {}
    for r in got:
        mine.setdefault((r["book_id"], r["comp"]), set()).add(r["ord"])
    want = {}
    for b, ns in enumerate(lists):
        for k, c in enumerate(sequential_names(ns)):
            want.setdefault((b, c), set()).add(k)
    same = lambda x: sorted((k[0], sorted(v)) for k, v in x.items())
    assert same(mine) == same(want)


def test_strict_titles(spark):
    df = spark.createDataFrame([(1, "Dr Ann Roe", 0), (1, "Miss Ann Roe", 1), (1, "Ann Roe", 2)], "book_id bigint, name string, ord bigint")
    assert resolve.same_names(df).select("comp").distinct().count() == 1
    assert resolve.same_names(df, strict_titles=True).select("comp").distinct().count() > 1


def test_merge_plan_is_greedy_in_order(spark):
    names = spark.createDataFrame([(1, n) for n in ("A", "B", "C", "D")], "book_id bigint, name string")
    g = spark.createDataFrame([(1, 1, "A", ["B", "B"], "high"), (1, 2, "C", ["B"], "high"), (1, 3, "D", ["A"], "high"), (1, 4, "C", ["D"], "medium"), (1, 5, "C", ["zz"], "high"), (1, 6, "D", ["C", None], "high"), (1, 7, "B", None, "high")], "book_id bigint, ord bigint, canonical string, aliases array<string>, confidence string")
    assert {(r["alias_key"], r["canonical"]) for r in resolve.valid_plan(g, names).collect()} == {("a", "A"), ("b", "A"), ("c", "D"), ("d", "D")}


def test_merges_keep_first_longest_and_ordered_sources(spark):
    rows = [(3, " Ann ", "bb", [2, 1]), (1, "ann", "aa", [5, 2, None]), (2, "ANN", None, None), (4, "", "x", [1])]
    df = spark.createDataFrame(rows, "o bigint, name string, d string, ids array<int>")
    r = merge.ordered_merge(df, {"name": t.norm_ws(F.col("name"))}, "o", ("name",), ("d",), "ids").collect()
    assert [(x["name"], x["d"], x["n"], x["sources"]) for x in r] == [("ann", "aa", 3, [5, 2, 1])]
    assert merge.ordered_merge(df, {"name": t.norm_ws(F.col("name"))}, "o", keep_blank=True).count() == 2


def test_scores(spark):
    g = [["lamp", "light"], ["river"], []]
    assert one(spark, "The  LIGHT", lambda c: evaluate.concept_coverage(c, F.array(*[F.array(*[F.lit(a) for a in x]) if x else F.array().cast("array<string>") for x in g]))) == pytest.approx(1 / 3)
    assert one(spark, "x", lambda c: evaluate.concept_coverage(c, F.array().cast("array<array<string>>"))) == 1.0
    s = one(spark, "a lamp [Page 3]", lambda c: evaluate.score_answer(c, F.array(F.array(F.lit("lamp")), F.array(F.lit("zz"))), F.lit(False)))
    assert (s["concept_coverage"], s["citation"], s["quality_score"]) == (0.5, True, 0.6)
    s = one(spark, t.UNKNOWN_RESPONSE, lambda c: evaluate.score_answer(c, F.array().cast("array<array<string>>"), F.lit(True)))
    assert (s["correct_refusal"], s["quality_score"], s["citation"]) == (True, 1.0, False)


def test_top_k_ties_and_nan(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 1.0]), (3, None)], "vec_id bigint, embedding array<float>")
    assert [r["vec_id"] for r in retrieve.top_k(df.filter("vec_id < 3"), df.filter("vec_id = 0"), 9).collect()] == [0, 2, 1]
    got = retrieve.top_k_many(df, df.filter("vec_id = 0"), 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 2]


def test_graph(spark):
    e = spark.createDataFrame([(1, 1, "A", "r", "B"), (1, 2, " a", "R ", "b"), (1, 3, "B", "r", "C"), (1, 4, "C", None, "C"), (1, 5, None, "r", "C")], "book_id bigint, k bigint, subject string, relation string, object string")
    d = graph.distinct_edges(e, "book_id", "k")
    assert sorted(r["k"] for r in d.collect()) == [1, 3, 4]
    c = graph.between(d, spark.createDataFrame([(1, x) for x in "ABC"], "book_id bigint, name string"), "book_id")
    top = graph.layout(graph.top_nodes(c, "book_id", "k"), "book_id").orderBy("rank").collect()
    assert [(r["name"], r["degree"]) for r in top] == [("B", 2), ("A", 1), ("C", 1)] and (top[0]["x"], top[0]["y"]) == (450.0, 80.0)


def test_numbers_and_carried_values_over_many_buckets(spark):
    """A group of many buckets, groups within one, null keys; against a walk in order."""
    rnd = random.Random(4)
    rows = [(b, k, rnd.choice([None, None, None, "I", "II", "III"])) for b, n in ((1, 400), (2, 3), (3, 40), (None, 25), (4, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "b bigint, k bigint, v string").repartition(5)
    bucket = F.floor(F.col("k") / 7)
    n = {(r["b"], r["k"]): r["n"] for r in ordered.placed(df.filter("k % 3 <> 1"), "b", ["k"], "n", bucket).collect()}
    c = {(r["b"], r["k"]): (r["now"], r["runs"]) for r in ordered.carried(df, "b", ["k"], "v", "none", "now", "runs", bucket).collect()}
    assert ordered.placed(df.limit(0), "b", ["k"], "n", bucket).count() == 0 and ordered.carried(df.limit(0), "b", ["k"], "v", "none", "now", "runs", bucket).count() == 0
    assert {b for b, _ in c} == {1, 2, 3, 4}
    seen, want = {}, {}
    for b, k, v in rows:
        if b is None:
            continue
        if k % 3 != 1:
            assert n[b, k] == seen.get(b, 0)
            seen[b] = seen.get(b, 0) + 1
        now, runs, any_ = want.get(b, ("none", 0, False))
        runs += v is not None and any_ and v != now
        want[b] = (v if v is not None else now, runs, True)
        assert c[b, k] == want[b][:2]


def test_halves_meet_once(spark):
    df = spark.createDataFrame([(g, f"{g}{k}") for g, n in (("a", 23), ("b", 2), ("c", 1)) for k in range(n)], "g string, id string")
    x, y = skew.halves(df, ["g"], "id", 4)
    got = x.withColumnRenamed("id", "x").join(y.withColumnRenamed("id", "y"), ["g", "_part"]).filter("x < y").collect()
    assert len(got) == 23 * 22 // 2 + 1 == len({(r["x"], r["y"]) for r in got})


def test_many_passes_over_rows_give_the_same(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(k, [rnd.random() for _ in range(4)]) for k in range(60)], "vec_id bigint, embedding array<float>").repartition(7)
    one_, many = (sorted(tuple(r) for r in retrieve.top_k_many(df, df.filter("vec_id % 5 = 0"), 3, most=m).collect()) for m in (1 << 20, 40))
    assert one_ == many and len(one_) == 36


def test_structured_merges_by_profile(spark):
    """Textbook categories by their own keys: the first row stays as it is, blanks are kept, sources united."""
    df = spark.createDataFrame([(1, "Area", "a*b", ["a"], "x", [4]), (2, "area ", " A*B", ["b"], "longer text", [5, 4]), (3, "Area", "a+b", None, None, None), (4, "", None, None, "y", [1])], "o bigint, name string, formula string, variables array<string>, explanation string, ids array<int>")
    got = sorted((r["first_ord"], r["n"], r["explanation"], r["sources"]) for r in merge.structured(df, "textbook", "formulas", "o", sources="ids").collect())
    assert got == [(1, 2, "x", [4, 5]), (3, 1, None, []), (4, 1, "y", [1])]
    with pytest.raises(ValueError):
        merge.structured(df, "poem", "formulas", "o")


def test_facade(spark):
    for bad, status in ((None, 422), ("", 422), ("x" * 2001, 422), ("  ", 400)):
        with pytest.raises(facade.RequestError) as e:
            facade.checked_question(bad)
        assert e.value.status == status
    story = spark.createDataFrame([(1, 7, 3, None, 1, 2, "A  text."), (2, 7, 3, "II", 1, 2, "A text."), (3, 7, 4, "II", 2, None, "B")], "rank int, book_id bigint, chunk_id int, chapter string, page_start int, page_end int, text string")
    world = spark.createDataFrame([(1, None, "w", [])], "rank int, type string, text string, sources array<int>")
    got = facade.chat(" who? ", lambda q: (q.upper(), story, world), debug=True)
    assert got["answer"] == "WHO?" and [(c["chunk_id"], c["chapter"], c["excerpt"]) for c in got["sources"]] == [(3, "Unknown", "A text."), (4, "II", "B")] and got["world_evidence"] == [{"type": "unknown", "text": "w", "sources": []}]
    assert facade.chat("who?", lambda q: (q, story, world))["world_evidence"] is None
    with pytest.raises(facade.RequestError) as e:
        facade.chat("who?", lambda q: 1 / 0)
    assert e.value.status == 503 and "division" not in str(e.value)
    with pytest.raises(facade.RequestError):
        facade.relationships(None, "book_id", "k")
    items = spark.createDataFrame([(1, "character", None, "Character: Bo. Tall.", None), (2, "character", "ann", "x", None), (3, "event", "e", "y", None)], "world_item_id bigint, type string, name string, text string, sources array<int>")
    assert [r["name"] for r in facade.characters(items).collect()] == ["ann", "Bo"]


def test_source_lists(spark):
    src = "array<struct<chunk_id:int,chapter:string,page_start:int,page_end:int>>"
    assert one(spark, [(1, "I", 2, None), (None, None, 3, 4)], t.source_list, src) == "Chapter=I, Pages=2-2, Chunk=1 | Chapter=Unknown, Pages=3-4, Chunk=?"
    assert one(spark, [], t.source_list, src) == one(spark, None, t.source_list, src) == "No source metadata"


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"), F.col("id")).repartition(7)
    assert [tuple(r) for r in index.dense_ids(df, ["o"], "n").select("o", "n").orderBy("n").collect()] == [(k, k) for k in range(1000)]


def test_lookup_with_hot_groups(spark):
    m = spark.createDataFrame([("hot", k) for k in range(500)] + [(f"k{k}", k) for k in range(50)] + [(None, 1)], "k string, x int")
    g = m.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    assert skew.lookup(m, g, "k", "n", 550, share=10, floor=20).count() == 550


def test_incremental_equals_batch(spark, tmp_path):
    rows = [(k, f"n{k % 5}", "d" * (k % 7)) for k in range(60)]
    df = spark.createDataFrame(rows, "o bigint, name string, d string")
    src, state, ck = (str(tmp_path / x) for x in ("src", "state", "ck"))
    want = sorted(tuple(r) for r in incremental.partial(df, "name", "d", "o").collect())
    for part in (df.filter("o < 30"), df.filter("o >= 30")):
        part.coalesce(1).write.mode("append").parquet(src)
        incremental.run(spark, spark.readStream.schema(df.schema).parquet(src), state, ck, "name", "d", "o")
    incremental.run(spark, spark.readStream.schema(df.schema).parquet(src), state, ck, "name", "d", "o")
    assert sorted(tuple(r) for r in incremental.current(spark, state).collect()) == want
    assert incremental.run(spark, spark.readStream.schema(df.schema).parquet(src), state, ck, "name", "d", "o") == 0  # nothing is left
    assert sorted(tuple(r) for r in incremental.merged_in_batches(df, 4, "name", "d", "o").collect()) == want


def test_failed_batch_is_replayed_once(spark, tmp_path, monkeypatch):
    """A failure stops the run and keeps what was done; the next run begins with the batch that failed. Results are written as they come."""
    df = spark.createDataFrame([(k, f"n{k % 5}", "d" * (k % 7)) for k in range(60)], "o bigint, name string, d string")
    src, state, ck = (str(tmp_path / x) for x in ("src", "state", "ck"))
    df.repartition(6).write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(src)
    real, calls = incremental.partial, []

    def fails(*a):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("broken")
        return real(*a)

    monkeypatch.setattr(incremental, "partial", fails)
    with pytest.raises(Exception, match="broken"):
        incremental.run(spark, stream(), state, ck, "name", "d", "o")
    assert len(glob.glob(f"{state}/batch=*")) == 1
    assert incremental.run(spark, stream(), state, ck, "name", "d", "o", pause=0.01) == 2
    monkeypatch.undo()
    want = sorted(tuple(r) for r in real(df, "name", "d", "o").collect())
    assert sorted(tuple(r) for r in incremental.current(spark, state).collect()) == want
    incremental.append(stream(), str(tmp_path / "out"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    fresh = [str(tmp_path / x) for x in ("state2", "ck3")]
    assert incremental.run(spark, stream(), *fresh, "name", "d", "o") == 3


def test_sources(spark, tmp_path):
    import numpy as np

    p = tmp_path / "world.json"
    p.write_text('{"processed_chunk_ids": [1, 2], "characters": [{"name": "Ann", "description": "x", "sources": [{"chunk_id": 1, "chapter": "I", "page_start": 1, "page_end": 2}]}], "locations": [], "relationships": [], "events": [], "facts": []}')
    w = io.read_world(spark, str(p))
    assert w["processed"].count() == 2 and w["characters"].first()["sources"][0]["chapter"] == "I" and w["facts"].count() == 0
    m = np.arange(6, dtype=np.float32).reshape(3, 2)
    np.save(tmp_path / "m.npy", m)
    assert [list(r["embedding"]) for r in io.read_vectors(spark, str(tmp_path / "m.npy")).orderBy("row").collect()] == m.tolist()
    io.write_batches(spark.createDataFrame([(k, k // 18) for k in range(40)], "chunk_id int, batch int"), str(tmp_path / "b"))
    io.write_batches(spark.createDataFrame([(k, k // 18) for k in range(18)], "chunk_id int, batch int"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 40  # a batch written again stands there once
    (tmp_path / "q.json").write_text('[{"id": 1, "question": "Who?", "category": "fact", "expected_groups": [["a", "b"], []], "unanswerable": false}]')
    assert io.read_questions(spark, str(tmp_path / "q.json")).first()["expected_groups"] == [["a", "b"], []]
    io.write_table(spark.range(3), str(tmp_path / "t"))
    io.write_json(spark.createDataFrame([("é", None)], "a string, b int"), str(tmp_path / "j"))
    assert io.checkpoint_or(spark, str(tmp_path / "none"), str(tmp_path / "t"), schema="id bigint").count() == 3 and spark.read.json(str(tmp_path / "j")).first()["a"] == "é"
    assert sorted(os.path.basename(x) for x in glob.glob(str(tmp_path / "b" / "batch_id*"))) == ["batch_id=batch_0000_0017", "batch_id=batch_0018_0035", "batch_id=batch_0036_0039"]
    assert io.checkpoint_or(spark, str(tmp_path / "none"), schema="a int").count() == 0
    with pytest.raises(ValueError):
        schemas.profile("poem")


def test_plugins(spark):
    assert plugins.wait_schedule(["429 retry in 3s", "boom", "x"]) == [5.0, 5.0]
    with pytest.raises(RuntimeError):
        plugins.wait_schedule(["429 retry in 100s"], long_wait=90)
    v = plugins.embed(spark.createDataFrame([("a b",), (None,)], "x string"), "x").collect()
    assert math.isclose(sum(z * z for z in v[0]["embedding"]), 1, rel_tol=1e-5) and set(v[1]["embedding"]) == {0.0}
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429")
        return "ok"

    assert plugins.with_retries(flaky, sleep=lambda s: None) == "ok"

    def quota():
        calls.append(1)
        raise RuntimeError("429 retry in 500s")

    calls.clear()
    with pytest.raises(RuntimeError, match="LONG_QUOTA_WAIT"):
        plugins.with_retries(quota, sleep=lambda s: None, long_wait=90)
    assert len(calls) == 1
    df = spark.createDataFrame([(1, "p")], "chunk_id bigint, prompt string")
    assert plugins.extract(df, "prompt", plugins.EmptyExtractor(), "characters array<struct<name:string>>").first()["extraction"]["characters"] == []
    assert plugins.generate(df, "prompt").first()["answer"] == t.UNKNOWN_RESPONSE


def test_extraction_is_parsed_and_folded(spark):
    """Two chunks, one with a record that the other tells at more length: the fold of the extractions, one source a chunk."""
    def extractor(prompt):
        name, text = prompt.split("|")
        return json.dumps({"characters": [{"name": name, "description": text}], "locations": [], "relationships": [{"subject": name, "relation": "knows", "object": "Bo", "explanation": text}], "events": [], "facts": []})

    df = spark.createDataFrame([(2, "ann |tall and old"), (1, "Ann|tall")], "chunk_id bigint, prompt string")
    schema = ", ".join(f"{c} array<struct<{schemas.FIELDS[c].replace(' ', ':', 99).replace(',:', ',')}>>" for c in schemas.PROFILES["story"])
    parts = merge.extracted(plugins.extract(df, "prompt", extractor, schema), "story")
    c = merge.ordered_merge(parts["characters"], {"name": t.norm_ws(F.col("name"))}, "ord", ("name",), ("description",), "source_chunk_ids").collect()
    assert [(r["name"], r["description"], r["sources"]) for r in c] == [("Ann", "tall and old", [1, 2])]
    assert parts["relationships"].count() == 2 and parts["events"].count() == 0
    with pytest.raises(Exception, match="MALFORMED|parse|broken"):
        plugins.extract(df, "prompt", lambda p: "broken", schema).collect()
    plan = plugins.propose(spark.createDataFrame([(1, "x")], "book_id bigint, context string"), lambda p: json.dumps({"groups": [{"canonical": "Ann", "aliases": ["ann"], "confidence": "high", "reason": "same"}]})).collect()
    assert [(r["book_id"], r["ord"], r["canonical"], r["aliases"], r["confidence"]) for r in plan] == [(1, 0, "Ann", ["ann"], "high")]


def test_first_chunks(spark):
    assert [r["id"] for r in segment.first_chunks(spark.range(9), 2, "id").collect()] == [0, 1] and segment.first_chunks(spark.range(9), None, "id").count() == 9


def test_pages_of_pdf_files(spark, tmp_path, monkeypatch):
    """With a stand-in for the PDF library: pages are numbered from 1, blocks are the fifth field."""
    (tmp_path / "fitz.py").write_text(
        "class Page:\n    def __init__(self, t): self.t = t\n    def get_text(self, kind, sort): return self.t if kind == 'text' else [(0, 0, 0, 0, x) for x in self.t.split('/')]\n"
        "class Doc(list):\n    def __enter__(self): return self\n    def __exit__(self, *a): pass\n"
        "def open(stream, filetype): return Doc(Page(x) for x in stream.decode().split('\\f'))\n"
    )
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"one/two\fthree")
    with pytest.raises(RuntimeError, match="pymupdf"):
        io.read_pages(spark, str(tmp_path / "in"))
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "fitz.py"))
    got = [(r["page"], r["raw_text"], r["blocks"]) for r in io.read_pages(spark, str(tmp_path / "in")).orderBy("page").collect()]
    assert got == [(1, "one/two", ["one", "two"]), (2, "three", ["three"])]


def test_checkpoint_folder_must_be_shared(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


def test_once(spark):
    df = spark.createDataFrame([(1, "a", T0), (1, "b", dt.datetime(2025, 1, 1)), (2, "c", None), (None, "d", T0)], "k bigint, v string, loaded_at timestamp")
    assert sorted((r["k"], r["v"]) for r in merge.once(df, "k").collect()) == [(1, "a"), (2, "c")]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.SQL | memory.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = (core.QUERIES | memory.QUERIES)[name](spark, DATA)
    cols = sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    mine = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute((core.SQL | memory.SQL)[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == cols
    assert mine == sorted((tuple(tidy(x[at.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


def test_entry_points():
    assert set(core.QUERIES) | set(memory.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
