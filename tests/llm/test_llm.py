"""Small cases and brute-force checks of the training-data operators."""

import datetime as dt
import glob
import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loreloom.llm import copies, leaks, names, nearby, oracles, packing, pairs, queries, scans, sentences, splitting, survivor
from loreloom.llm.components import components
from loreloom.llm.learners import Boosted, Logistic

T0 = dt.datetime(2024, 1, 1)
EVENT = "event_key bigint, book_id bigint, summary string, explanation string, loaded_at timestamp, words string, rep bigint"
REL = "rel_key bigint, book_id bigint, subject string, relation string, object string, raw_record string, loaded_at timestamp, k string"
CHAR = "char_key bigint, book_id bigint, batch_id string, name string, description string, source_chunk_ids array<int>, extractor string, extracted_at timestamp, loaded_at timestamp, trust string"
ALIAS = "alias_group_key bigint, book_id bigint, canonical string, aliases array<string>"
CHUNK = "chunk_key bigint, book_id bigint, chunk_id int, page_start int, page_end int, chapter string, text string, loaded_at timestamp, piece string"
ARM = "struct<answer:string,scores:struct<quality_score:double>>"
RESULT = f"result_key bigint, question string, category string, unanswerable boolean, story_only {ARM}, hybrid {ARM}, arm string"


# --- 1 ----------------------------------------------------------------------------------------------------------
def brute_pairs(rows, s):
    w = {r[0]: set(re.findall(r"[^\W_]+", f"{r[2] or ''} {r[3] or ''}".lower())) for r in rows if r[0] is not None}
    ids = sorted(w)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if w[a] and w[b] and len(w[a] & w[b]) / len(w[a] | w[b]) >= s}


@pytest.mark.parametrize("part", [4, 2048])
def test_p1_pairs_match_brute_force(spark, part):
    rnd = random.Random(3)
    vocab = [f"w{k}" for k in range(300)]
    rows = [(None, 1, "x y z", "a", T0, "w", 1), (9000, 1, None, None, T0, None, None), (9001, 1, " ", "", T0, None, None), (9002, None, "ab " * 3000, None, T0, None, None)]
    for k in range(120):
        base = rnd.sample(vocab, 30) if k % 4 == 0 else base  # noqa: F821
        text = [w for w in base if rnd.random() > 0.1] + rnd.sample(vocab, rnd.randint(0, 4))
        rows.append((k, k % 3, " ".join(text[:10]).upper(), " ".join(text[10:]), T0, "clash", 5))
    rows += [rows[10], (500, 1, rows[10][2], rows[10][3], T0, None, None)]
    df = spark.createDataFrame(rows, EVENT)
    got = {tuple(r) for r in nearby.found(df, 0.6, part=part).collect()}
    assert got == brute_pairs(rows, 0.6)
    assert nearby.found(df.limit(0)).count() == 0


def test_p1_groups_give_one_row_per_record(spark):
    rows = [(1, 1, "a b c d e", "f g", T0, None, None), (2, 1, "a b c d e", "f h", T0, None, None), (3, 1, "a b c d e", "f g", T0, None, None), (4, 1, "z", None, T0, None, None), (5, 1, None, None, T0, None, None)]
    g = {r["event_key"]: (r["group_key"], r["links"], r["copies"]) for r in nearby.groups(spark.createDataFrame(rows, EVENT), 0.6).collect()}
    assert g == {1: (1, 1, 2), 2: (1, 1, 1), 3: (1, 1, 2), 4: (4, 0, 1), 5: (5, 0, 1)}


@pytest.mark.parametrize("part", [3, 2048])
def test_p1_exact_mode_loses_nothing(spark, part):
    rnd = random.Random(5)
    rows = []
    for k in range(80):
        base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 25))] if k % 3 == 0 else base  # noqa: F821
        rows.append((k, 1, " ".join(base[rnd.randint(0, 2) :]), rnd.choice(["", "x", "y z"]), T0, None, None))
    got = {tuple(r) for r in nearby.found(spark.createDataFrame(rows, EVENT), 0.5, miss=0, part=part).collect()}
    assert got == brute_pairs(rows, 0.5) and got


def test_p1_hot_class_is_expanded_whole(spark, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK", 5)
    rows = [(k, 1, "a b c d e f" if k < 23 else "a b c d e f g", None, T0, None, None) for k in range(36)]
    assert {tuple(r) for r in nearby.found(spark.createDataFrame(rows, EVENT), 0.6).collect()} == {(a, b) for a in range(36) for b in range(a + 1, 36)}


def test_p1_trie_join_is_exact():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 63, (60, 2), dtype=np.uint64)
    for k in range(1, 60, 2):
        s[k] = s[k - 1] ^ np.array([1 << int(rng.integers(0, 63)), 5], np.uint64)
    order = np.lexsort((s[:, 1], s[:, 0]))
    s, n = s[order], np.full(60, 10)
    i, j = nearby.trie_join(s, n, (np.array([0, 25]), np.array([25, 60]), np.array([0, 25]), np.array([25, 60])), 0.5, nearby.budgets(0))
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if (a < 25) == (b < 25) and int(np.bitwise_count(s[a] ^ s[b]).sum()) <= 10}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want


def test_p1_budgets_prune_most_pairs():
    """One trie of unrelated records and near copies: node pairs and paths are pruned, near copies kept."""
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 62, 40) for _ in range(3000)]
    sets += [np.concatenate([x[:36], rng.integers(0, 1 << 62, 4)]) for x in sets[:200]]
    b = pa.RecordBatch.from_pydict({"id": pa.array(range(len(sets))), "w": pa.array([np.unique(x) for x in sets], pa.list_(pa.int64()))})
    t = pa.Table.from_batches(list(nearby._plant(iter([b]), 1, 0)))
    s = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")], 1)
    order = np.lexsort((s[:, 1], s[:, 0]))
    ids, whole = t.column("id").to_numpy()[order], (np.array([0]), np.array([len(sets)]), np.array([0]), np.array([len(sets)]))
    told = {}
    i, j = nearby.trie_join(s[order], t.column("n").to_numpy()[order].astype(np.int64), whole, 0.25, nearby.budgets(nearby.LOSS), told)
    total = len(sets) * (len(sets) - 1) // 2
    assert told["nodes_pruned"] > 0 and told["pairs_under_pruned_nodes"] + told["pairs_pruned_on_paths"] > 0.9 * total and told["pairs_compared"] < 0.1 * total
    got = {tuple(sorted(x)) for x in zip(ids[i].tolist(), ids[j].tolist(), strict=True)}
    assert len(got & {(k, 3000 + k) for k in range(200)}) >= 180


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 7), (7, 8), (8, 9)], "a bigint, b bigint")
    assert {tuple(r) for r in components(e).collect()} == {(1, 1), (2, 1), (3, 1), *((k, 5) for k in range(5, 10))}


# --- 2 ----------------------------------------------------------------------------------------------------------
def test_p2_links_spellings_and_leaves_roles(spark):
    def char(k, book, name):
        return (k, book, None, name, None, None, None, None, T0, None)

    one = ["Dorothy Jelmicktree", "Dolly Jelmicktree", "Jelmicktree, D.", "Mrs. Jelmicktre", "DOROTHY  JELMICKTREE", "Doro. Jelmicktree", "Jelmicktree Dorothy", "Dorothy “Dot” Jelmi-cktree", "Dorothy Jelmíckträe "]
    org = ["Zelsaw Mill Brotherhood", "The Zelsaw Mill Bros.", "ZMB", "Mill Brotherhood of Zelsaw", "Zelsaw & Bros.", "Zelsaw"]
    rest = ["Harriet Orbowcroft", "the Narrator", "an unnamed clerk", "  ", None, "Susan Vekyarup", "Fred Vekyarup", "Vekyarup"]
    c = spark.createDataFrame([char(k, 1, n) for k, n in enumerate(one[:5] + org[:3] + rest)] + [char(99, 2, one[0]), char(100, None, one[0])], CHAR)
    a = spark.createDataFrame([(1, 1, one[0], [*one[5:], None]), (2, 1, org[0], org[3:]), (3, 1, None, None)], ALIAS)
    got = {tuple(r) for r in names.found(c, a).collect()}
    pairs_of = lambda x: {(1, *sorted((p, q))) for i, p in enumerate(x) for q in x[i + 1 :]}
    assert got == pairs_of(one[:-1]) | pairs_of(org) or got == pairs_of(one) | pairs_of(org)
    assert names.found(c.limit(0), a.limit(0)).count() == 0


def test_p2_words_no_table_has(spark, monkeypatch):
    """Unknown given names, kinds and abbreviations of organisations, four-letter surnames, and a block split into parts."""
    monkeypatch.setattr("loreloom.operators.skew.halves.__defaults__", (3,))
    groups = [
        ["Quorline Veshtak", "Quory Veshtak", "Q. Veshtak", "Mrs. Veshtak"], ["Dorrin Candle Ministry", "Candle Ministry of Dorrin", "Candle Ministry, Dorrin", "DCM", "Dorrin Candle Mnstry."],
        ["Anna Hale", "Ann Hael"], ["Bartolf Zimmerhald", "Zimmerhald, Bartolf", "Bartolf Zimerhald", "Bartolf  Zimmerhadl", "BARTOLF ZIMMERHALD", "Bartolf Zimmerhalt"],
    ]
    c = spark.createDataFrame([(k, 1, None, n, None, None, None, None, T0, None) for k, n in enumerate(x for g in groups for x in g)], CHAR)
    a = spark.createDataFrame([], ALIAS)
    assert {tuple(r) for r in names.found(c, a).collect()} == {(1, *sorted((p, q))) for g in groups for i, p in enumerate(g) for q in g[i + 1 :]}


def test_p2_broadcasts_nothing_that_grows(spark, monkeypatch, tmp_path):
    """Profiles, their keys and linked names are shuffled however small Spark takes a checkpoint of them to be; without hot blocks no join has a broadcast side."""
    monkeypatch.setattr(names, "cut", lambda df, cut=names.cut: plans.append(df) or cut(df))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for k, strings in enumerate((["Dorothy Jelmicktree", "Dolly Jelmicktree", "D. Jelmicktree"], ["Harriet Orbowcroft", "Susan Vekyarup"])):
            spark.createDataFrame([(k, 1, None, n, None, None, None, None, T0, None) for k, n in enumerate(strings)], CHAR).write.parquet(f"{tmp_path}/c{k}")
            spark.createDataFrame([], ALIAS).write.parquet(f"{tmp_path}/a{k}")
            plans: list = []
            links = names.found(spark.read.parquet(f"{tmp_path}/c{k}"), spark.read.parquet(f"{tmp_path}/a{k}"))
            told = [df._jdf.queryExecution().executedPlan().toString() for df in [*plans, links]]
            assert sum("SortMergeJoin" in x for x in told) > 1 and not any("BroadcastExchange" in x for x in told)
            assert {r[1:] for r in links.collect()} == ({(p, q) for p in strings for q in strings if p < q} if k == 0 else set())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_p2_near():
    for a, b, ok in [("jelmick", "jelmikc", True), ("jelmick", "jelmck", True), ("abc", "abd", False), ("jelmick", "jxlmixk", False), ("henry", "herny", True)]:
        assert names.near(a, b) is ok and names.near(b, a) is ok


# --- 3 ----------------------------------------------------------------------------------------------------------
def test_p3_defects(spark):
    q = "Why did Mary Orbow leave the old lantern?"
    fill = "The old lantern stood beside the gate. They found the lantern."
    cases = [
        (q, False, None, "empty"), (q, True, " ​ ", "empty"), (q, False, "N/A", "empty"), (q, False, "**Answer:**", "empty"), (q, False, "why did mary orbow leave the old lantern", "copied_question"), (q, False, "Question: " + q, "copied_question"),
        (q, False, "I do not have sufficient information.", "refusal"), (q, True, "I do not have sufficient information.", None), (q, False, "I cannot stay, said Mary Orbow to the gate.", None), ("Wo lebt Mary Orbow?", False, "Dazu kann ich keine Auskunft geben.", "refusal"),
        (q, False, "Die Wirtin ging nach dem Markt nach Hause, und die Mühle blieb stehen.", "other_language"), (q, False, "粉屋の娘は夕方古い地図を描いた。", "other_language"), (q, False, "Mary met the widow and called out “Wo ist die Treppe?” [page 3].", None),
        (q, False, fill + " Then the keeper saw the", "truncated"), (q, False, fill + " Then they left [Page", "truncated"), (q, False, "* the keeper found the lantern\n* they left the gate", None), (q, False, "Mary Orbow", None), (q, False, fill, None), (None, None, "Yes.", None),
    ]
    rows = [(k, x, None, u, (a, None), (fill, None), "clash") for k, (x, u, a, _) in enumerate(cases)]
    rows += [rows[0], (None, q, None, None, None, None, None), (900, q, "unanswerable", None, ("I do not know.", None), None, None)]
    got = {(r["result_key"], r["arm"]): r["defect"] for r in pairs.found(spark.createDataFrame(rows, RESULT)).collect()}
    for k, (_, _, a, want) in enumerate(cases):
        assert got.get((k, "story_only")) == want, a
    assert got[(900, "hybrid")] == "empty" and (900, "story_only") not in got
    assert pairs.found(spark.createDataFrame([], RESULT)).count() == 0


def test_p3_every_triggered_type(spark):
    """An answer that refuses in another language and breaks off has three defects; a right refusal has none, whatever its form."""
    q = "Why did Mary Orbow leave the old lantern?"
    rows = [(1, q, None, False, ("Leider kann ich das nicht beantworten, denn die Wirtin ging nach", None), ("", None), None), (2, q, None, True, ("Leider kann ich das nicht beantworten, denn die Wirtin ging nach", None), ("I cannot answer this. " + "The old lantern stood beside the gate. " * 30, None), None), (3, q, None, False, ("The old lantern stood beside the gate. " * 30 + "I cannot answer this.", None), ("She left (as the long and winding tale of the old keeper of the gate has it for all of us", None), None)]
    got = {}
    for r in pairs.defects(spark.createDataFrame(rows, RESULT)).collect():
        got.setdefault((r["result_key"], r["arm"]), []).append((r["rank"], r["defect"]))
    got = {k: [d for _, d in sorted(v)] for k, v in got.items()}
    assert got == {(1, "story_only"): ["refusal", "other_language", "truncated"], (1, "hybrid"): ["empty"], (3, "hybrid"): ["truncated"]}


def test_p3_more_text_gives_the_same(spark):
    """A hundred times the texts: no verdict is lost, a word that never closes a sentence becomes known as such, and a word that is cut off stays so though the fragment is seen elsewhere."""
    fill = "The old lantern stood beside the gate. They found the lantern."
    base = [(k, "Who left?", None, False, (a, None), (fill, None), None) for k, a in enumerate(["They saw the lanter", "They saw the", "The old gate", "They found the lantern", fill])]
    more = [(k + 5 * n, *r[1:]) for n in range(100) for k, r in enumerate(base)] + [(9999, "Who saw the lanter of old?", None, False, (fill, None), (fill, None), None)]
    one, many = ({(r["result_key"], r["arm"], r["defect"]) for r in pairs.found(spark.createDataFrame(x, RESULT)).collect()} for x in (base, more))
    assert one == {(0, "story_only", "truncated")} and {(k % 5, a, d) for k, a, d in many} == one | {(1, "story_only", "truncated")}


# --- 4 ----------------------------------------------------------------------------------------------------------
def test_p4_best_and_survivor(spark):
    def row(k, name, text, ids=None, ex="a", at=T0, book=1):
        return (k, book, f"b{k}", name, text, ids, ex, at, T0, "clash")

    rows = [
        row(5, "Ann  Bo", "A tall clerk who left early.", [3, 1, None]), row(2, " ann bo ", "A tall clerk who left...", [7]), row(3, "ANN BO", "A short clerk of the town.", None, "b"), row(3, "ANN BO", "A short clerk of the town.", None, "b"),
        row(8, "Cy Do", None), row(9, "Cy Do", "unknown."), row(10, "Eve", "Only one."), row(10, "Eve", "Only one."), row(11, None, "x."), row(12, "  ", "y."), row(13, "Fay", "Ends with Mr."), row(14, "fay", "A."), row(15, "Gus", "Same size here.", book=None), row(16, "Gus", "Same size here.", book=None),
    ]
    df = spark.createDataFrame(rows, CHAR)
    ex = spark.createDataFrame([("a", 1), ("b", 2)], "extractor string, trust int")
    got = {(r["first_key"], r["best_key"]) for r in survivor.chosen(df, ex, "char_key").filter("best_key IS NOT NULL").collect()}
    assert got == {(2, 3), (13, 14), (15, 15)}
    s = {r["first_key"]: r for r in survivor.survivors(df, ex, "char_key").collect()}
    assert s[2]["source_chunk_ids"] == [1, 3, 7] and s[2]["description"] == "A short clerk of the town." and s[8]["best_key"] is None
    empty = df.limit(0)
    assert survivor.found(empty, empty.withColumnRenamed("char_key", "loc_key"), ex).count() == 0


def test_p4_branch_and_bound_is_best():
    rnd = random.Random(5)
    differs = 0
    for _ in range(300):
        def some(attributes):
            return [(rnd.randint(0, 6), {a: rnd.choice("xyz") for a in attributes if rnd.random() < 0.9}, k) for k in range(rnd.randint(0, 5))]

        o = [[((s,), f, k) for s, f, k in some(["extractor"])], some(["extractor", "batch"]), some(["batch"])]
        agree = lambda c: all(x[1].get(k, v) == v for x in c if x for y in c if y for k, v in y[1].items())
        all_ = [c for c in itertools.product(*[[*x, None] for x in o]) if agree(c) and (c[0] is None) == (not o[0]) and (c[0] is None or c[0][0] == max(x[0] for x in o[0]))]
        value = lambda c: sum(x[0] for x in c[1:] if x)
        got = survivor.bound(o)
        first = max(o[0], key=lambda x: x[0], default=None)
        assert agree(got) and (got[0] or (None,))[0] == (first or (None,))[0]
        same = [c for c in all_ if c[0] is None or c[0] == got[0]]
        assert value(got) == max(map(value, same))
        fits = [x for x in o[1] if got[0] is None or all(got[0][1].get(k, v) == v for k, v in x[1].items())]
        differs += bool(fits) and got[1] is not None and got[1][0] < max(x[0] for x in fits)
    assert differs > 5  # the most trusted origin is not always part of the best choice


def test_p4_bundles_agree(spark):
    """The account's extractor decides the batch, and the batch decides the spelling, against the more frequent ones."""
    def row(k, name, text, batch, ex):
        return (k, 1, batch, name, text, [k], ex, T0, T0, None)

    rows = [row(1, "ann bo", "The longest account of them all.", "b1", "a"), row(2, "ann bo", "Short.", "b1", "a"), row(3, "Ann Bo", "Short.", "b2", "a"), row(4, "ANN BO", "A short one.", "b3", "b"), row(5, "ANN BO", "A short one.", "b3", "b"), row(6, "Ann Bo", "Short.", "b2", "a"), row(7, "Ann Bo", "Short.", "b2", "a")]
    ex = spark.createDataFrame([("a", 1), ("b", 9)], "extractor string, trust int")
    r = survivor.survivors(spark.createDataFrame(rows, CHAR), ex, "char_key").collect()
    assert [(x["first_key"], x["best_key"], x["batch_id"], x["label"], x["source_chunk_ids"]) for x in r] == [(1, 1, "b2", "Ann Bo", [1, 2, 3, 4, 5, 6, 7])]


# --- 5 ----------------------------------------------------------------------------------------------------------
def test_p5_pieces_cover_the_text():
    rnd = random.Random(2)
    for n in (0, 10, 300, 301, 420, 1500, 5000):
        words = [rnd.choice(["lamp", "gate.", "river,", "they", "Old"]) + rnd.choice([" ", " ", "\n", "\n\n", " "]) for _ in range(n)]
        text = "".join(words)
        p = splitting.cut_points(text, 300, 40)
        w = text.split()
        assert p[0][0] == 0 and p[-1][1] == len(w)
        for (a, b, x, y), nxt in zip(p, [*p[1:], None], strict=True):
            assert b - a <= 300 and text[x:y].split() == w[a:b]
            if nxt:
                assert 20 <= b - nxt[0] <= 60 and nxt[1] > b


def test_p5_edit_moves_only_neighbours():
    rnd = random.Random(4)
    words = [rnd.choice(["lamp", "gate", "river", "they", "old", "mill", "wind", "stone"]) + str(rnd.randint(0, 99)) + rnd.choice(["", "", "."]) for _ in range(4000)]
    cut = lambda w: {" ".join(w[a:b]) for a, b, _, _ in splitting.cut_points(" ".join(w), 300, 40)}
    a, b = cut(words), cut([*words[:2000], "inserted", *words[2000:]])
    assert len(a & b) >= 0.6 * len(a)


def test_p5_edge_cases(spark):
    rows = [(1, 1, 1, 4, None, None, "w " * 301, T0, "clash"), (1, 1, 1, 4, None, None, "w " * 301, T0, "clash"), (2, 1, 2, 4, 4, "c", "w " * 300, T0, None), (3, None, None, None, None, None, None, None, None), (None, 1, 1, 1, 1, "c", "w " * 900, T0, None), (4, 1, 1, 1, 1, "c", " ", T0, None)]
    df = spark.createDataFrame(rows, CHUNK)
    assert [r[0] for r in splitting.found(df, 300, 40).collect()] == [1]
    assert splitting.split(df.limit(0), 300, 40).count() == 0
    with pytest.raises(ValueError):
        splitting.split(df, 40, 40)


# --- 6 ----------------------------------------------------------------------------------------------------------
def test_p6_noise_and_repair(spark):
    rnd = random.Random(1)
    base = ["window", "garden", "lantern", "harbour", "stone", "carried", "beneath", "evening", "river", "keeper", "half-open", "market"]
    plain = [(k, 1, k, 10, 10, "I. The Long Road", " ".join(rnd.choice(base) for _ in range(120)) + ".", T0, None) for k in range(100, 160)]
    noisy = [
        (1, 1, 1, 12, 13, "I. The Long Road", "The keeper carried the lan-\ntern beneath the half-\nopen window\nTHE OLD HOUSE    12\nof the harbour.", T0, "x"),
        (2, 1, 2, 14, 14, "I. The Long Road", "I. The Long Road\n\nThe w!ndow of the gard¬ en\n— 14 —\nstood beside the st0ne.", T0, "x"),
        (3, 1, 3, 14, 14, None, None, T0, None), (4, None, 3, None, None, None, " ", None, None), (None, 1, 1, 1, 1, "c", "x", T0, None), (1, 1, 1, 12, 13, "I. The Long Road", "late copy", dt.datetime(2025, 1, 1), None),
    ]
    df = spark.createDataFrame(plain + noisy, CHUNK)
    books = spark.createDataFrame([(1, "The Old House"), (2, None)], "book_id bigint, title string")
    got = {tuple(r) for r in scans.noise(df, books).collect()}
    assert {x for x in got if x[0] < 100} == {(1, "hyphenation"), (1, "header"), (1, "page_number"), (2, "hyphenation"), (2, "misread"), (2, "page_number")}
    assert not {x for x in got if x[0] >= 100}
    text = {r[0]: r[1] for r in scans.repair(df, books).collect()}
    assert text[1] == "The keeper carried the lantern beneath the half-open window of the harbour."
    assert "The window of the garden stood beside the stone." in text[2]
    assert scans.noise(df.limit(0), books.limit(0)).count() == 0


def scanned(spark, texts, known):
    """Texts under keys from 1 among 60 chunks of plain text, which also hold each known word as often as given."""
    rnd = random.Random(1)
    base = ["window", "garden", "lantern", "harbour", "stone", "carried", "beneath", "evening", "river", "keeper", "half-open", "market"]
    more = [w for w, n in known.items() for _ in range(n)]
    rows = [(100 + k, 1, 100 + k, 10, 10, "I. The Long Road", " ".join([*(rnd.choice(base) for _ in range(120)), *more[k::60]]) + ".", T0, None) for k in range(60)]
    rows += [(k, 1, k, 10, 10, "I. The Long Road", text, T0, None) for k, text in enumerate(texts, 1)]
    return spark.createDataFrame(rows, CHUNK), spark.createDataFrame([(1, "The Old House")], "book_id bigint, title string")


def test_p6_words_beyond_the_held_ones(spark, monkeypatch):
    monkeypatch.setattr(scans, "COMMON_SHARE", 0.02)  # as in a large corpus, where a name of one book has no such share
    df, books = scanned(spark, ["The keeper of 5elorvoe carried the lantern.", "The keeper of selor\nvoe carried the lantern."], {"selorvoe": 40})
    assert {tuple(r) for r in scans.noise(df, books).collect()} == {(1, "misread"), (2, "hyphenation")}
    text = {r[0]: r[1] for r in scans.repair(df, books).collect()}
    assert text[1] == text[2] == "The keeper of selorvoe carried the lantern."


def test_p6_frequent_misreads(spark):
    df, books = scanned(spark, ["The keeper carried the lantcrn."], {"lantern": 12000, "lantcrn": 1100})
    assert (1, "misread") in {tuple(r) for r in scans.noise(df, books).collect()}
    assert "The keeper carried the lantern." in {r["text"] for r in scans.repair(df, books).collect()}


def test_p6_breaks_between_frequent_fragments(spark):
    known = {"stranger": 3000, "str": 40, "anger": 60, "around": 600, "a": 4000, "round": 150}
    df, books = scanned(spark, ["The keeper carried the str\nanger beneath.", "The keeper carried the str anger beneath.", "The keeper carried a\nround lantern."], known)
    assert {x for x in map(tuple, scans.noise(df, books).collect()) if x[0] < 100} == {(1, "hyphenation"), (2, "hyphenation")}
    text = {r[0]: r[1] for r in scans.repair(df, books).collect()}
    assert text[1] == text[2] == "The keeper carried the stranger beneath."
    assert text[3] == "The keeper carried a round lantern."


def test_p6_models_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((Boosted().fit(x[:400], y[:400]).predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9
    z = (x @ [1, -2, 0.5] > 0).astype(float)
    assert ((Logistic().fit(x[:400], z[:400]).predict(x[400:]) > 0.5) == z[400:]).mean() > 0.95


def test_p6_ranking_on_held_out_words():
    rnd = random.Random(9)
    words = {"".join(rnd.choice("abcdefghilmnoprstuvw") for _ in range(rnd.randint(5, 9))): 50 for _ in range(600)}
    train, test = dict(list(words.items())[:400]), list(words)[400:]
    model = scans.train_ranking(train)
    bad = [(scans.corrupt(w, rnd), w) for w in test]
    hit = model.predict(np.array([scans.rank_features(b, w, 1, 50) for b, w in bad if b != w])) > 0.5
    miss = model.predict(np.array([scans.rank_features(w, v, 1, 50) for w, v in zip(test, test[1:], strict=False)])) > 0.5
    assert hit.mean() > 0.9 and miss.mean() < 0.05


def test_p6_more_text_gives_the_same(spark):
    """The same chunks once and twenty times: the same kinds of noise, for frequent misreadings, short words, long lines and breaks between frequent fragments."""
    rnd = random.Random(12)
    vocab = "the and lantern window garden harbour stranger forgotten merchant telegram village evening carried walked towards behind market bridge captain letter some thing other winter".split()
    book = "The Remarkably Long and Winding Chronicle of the Old Harbour Village beside the Forgotten Northern Market Bridge"
    texts = []
    for k in range(90):
        lines = [" ".join(rnd.choices(vocab, k=11)) for _ in range(6)]
        if k % 9 == 0:
            lines[2] = lines[2] + " thc lantcrn"
        if k % 9 == 1:
            lines[1], lines[2] = lines[1] + " stran-", "ger " + lines[2]
        if k % 9 == 2:
            lines.insert(3, book.upper())
        if k % 9 == 3:
            lines.insert(3, str(k))
        texts.append("\n".join(lines))
    rows = lambda n: [(k + 1000 * r, 1, k, k, k, "Chapter 1 Rain", x, T0, None) for r in range(n) for k, x in enumerate(texts)]
    books = spark.createDataFrame([(1, book)], "book_id bigint, title string")
    one, many = ({(r["chunk_key"] % 1000, r["noise"]) for r in scans.noise(spark.createDataFrame(rows(n), CHUNK), books).collect()} for n in (1, 20))
    assert one == many == {(k, n) for k in range(90) for m, n in enumerate(("misread", "hyphenation", "header", "page_number")) if k % 9 == m}


def test_p6_likeness_is_the_edit_distance():
    rnd = random.Random(3)
    for _ in range(300):
        a = "".join(rnd.choices("abcd", k=rnd.randint(4, 70)))
        b = "".join(c if rnd.random() > 0.15 else rnd.choice(["", "x", c + "y"]) for c in a)
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
            prev = row
        n = max(len(a), len(b))
        assert scans.similar(a, b) == (pytest.approx(1 - prev[-1] / n) if abs(len(a) - len(b)) <= 0.3 * n and min(len(a), len(b)) > 3 else float(a == b))


def test_p6_quick_costs_agree():
    rnd = random.Random(1)
    for _ in range(3000):
        w = x = rnd.choice(["lantern", "window", "clinic", "million", "minister", "riddle", "cluster"])
        for _ in range(rnd.randint(0, 4)):
            x = scans.corrupt(x, rnd)
        x = x if rnd.random() > 0.3 else x[:2] + rnd.choice("xqz") + x[3:]
        full, quick = scans.confusion_cost(w, x), scans.confusions(w, x, scans.MOST_COST)
        assert quick == (pytest.approx(full) if full < scans.MOST_COST - 1e-9 else None)


# --- 7 ----------------------------------------------------------------------------------------------------------
def test_p7_groups_by_letters_and_digits(spark):
    raw = '{"Object" : "BO", "explanation":"x", "SUBJECT":"a.nn", "relation":"likes"}'
    rows = [(5, 1, "Ann", "likes", "Bo", None, T0, "c"), (5, 1, "Ann", "likes", "Bo", None, T0, "c"), (3, 1, " a-n n ", "LIKES.", "“bo”", None, T0, None), (4, 1, None, None, None, raw, T0, None), (6, 2, "Ann", "likes", "Bo", None, T0, None), (7, 1, None, None, None, raw[:30], T0, None), (8, 1, "Ann", " ", "Bo", None, T0, None), (9, 1, "Ánn", "likes", "Bo", None, T0, None), (None, 1, "Ann", "likes", "Bo", None, T0, None), (10, None, "x", "y", "z", None, None, None), (11, None, "X", "y", "z", None, None, None)]
    df = spark.createDataFrame(rows, REL)
    assert {tuple(r) for r in copies.copies(df).collect()} == {(3, 4), (3, 5), (10, 11)}
    assert copies.copies(df.limit(0)).count() == 0 and copies.collapse(df.limit(0)).count() == 0
    c = sorted(tuple(r) for r in copies.collapse(df.filter("rel_key IS NOT NULL")).collect())
    assert c == [(3, 3), (6, 1), (7, 1), (8, 1), (9, 1), (10, 2)]


def test_p7_small_filters_change_nothing(spark):
    rows = [(k, 1, f"s{k % 700}", "r", "o", None, T0, None) for k in range(2000)]
    df = spark.createDataFrame(rows, REL).repartition(5)
    want = {(k % 700, k) for k in range(700, 2000)}
    for bits in (1 << 15, 1 << 20, 64):  # 64: more rows than any filter of that size could tell apart
        assert {tuple(r) for r in copies.copies(df, max_bits=bits).collect()} == want


def test_p7_filters_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(copies, "FAN_IN", 2)
    df = spark.createDataFrame([(k, 1, f"s{k % 700}", "r", "o", None, T0, None) for k in range(2000)], REL).repartition(7)
    k = copies.keyed(df)
    hashes = k.select(F.xxhash64("k").alias("h"))
    one, bits = copies.repeats_filter(hashes.coalesce(1), 2000)
    many, _ = copies.repeats_filter(hashes.repartition(7), 2000)
    assert ((one & ~many) == 0).all()  # no repeat is lost
    assert {tuple(r) for r in copies.copies(df).collect()} == {(x % 700, x) for x in range(700, 2000)}


# --- 8 ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("windows", [1, 3, 4096])
def test_p8_every_text_once_and_whole(spark, windows):
    rnd = random.Random(6)
    texts = ["x" * rnd.choice([0, 1, 50, 99, 100, 101, 250, 399]) for _ in range(300)] + [None, " ", "é" * 60, "z" * 1000]
    df = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(texts)], "doc_id bigint, text string, container string").repartition(20)
    rows = packing.pack(df, 100, windows=windows, fan_in=4).collect()
    by, load = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["first_token"], r["tokens"]))
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
    assert max(load.values()) <= 100
    for k, x in enumerate(texts):
        size = len((x or "").encode()) + 1
        p = sorted(by[k])
        assert sum(t for _, t in p) == size and len(p) == max(1, -(-size // 100))
        assert [f for f, _ in p] == [100 * i for i in range(len(p))]
    assert packing.pack(df.limit(0), 100).count() == 0


# --- 9 ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("limit", "hot"), [(0, 10_000), (0, 2), (4_000_000, 10_000)])
def test_p9_matches_brute_force(spark, limit, hot):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rnd.choices(words, k=40)), " ".join(rnd.choices(words, k=14)), "clash") for k in range(12)] + [(50, None, " ", None), (None, "x", "y", None)]
    docs = [(None, "a", 1), (900, None, 1), (901, " ", 1), (902, "w1 " * 5000, 1)]
    for k in range(80):
        i = rnd.choice(items[:12])
        src = rnd.choice(i[1:3]).split()
        n = rnd.choice([10, 11, 12, 13, 14])
        at = rnd.randint(0, max(0, len(src) - n))
        docs.append((k, (" ".join(rnd.choices(words, k=20)) + ", " + "; ".join(src[at : at + n]).upper() + "! " + " ".join(rnd.choices(words, k=5))), 1))
    docs.append(docs[-1])
    seen = {}
    for i, p, q, _ in items:
        for x in (p, q):
            w = (x or "").split()
            for a in range(len(w) - 11):
                seen.setdefault(tuple(w[a : a + 12]), set()).add(i)
    want = set()
    for k, x, _ in docs:
        w = re.findall(r"\w+", (x or "").lower())
        for a in range(len(w) - 11):
            want |= {(k, i) for i in seen.get(tuple(w[a : a + 12]), ())} if k is not None else set()
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, passage string, question string, text string")
    assert {tuple(r) for r in leaks.leaked(d, t, max_broadcast=limit, hot=hot).collect()} == want and want
    assert leaks.leaked(d.limit(0), t).count() == 0 and leaks.leaked(d, t.limit(0)).count() == 0


def test_p9_tolerates_substitutions(spark):
    item = [f"w{k}" for k in range(30)]
    doc = [*item]
    doc[8] = doc[20] = "other"
    d, t = spark.createDataFrame([(1, " ".join(doc))], "doc_id bigint, text string"), spark.createDataFrame([(7, " ".join(item), None)], "item_id bigint, passage string, question string")
    r = leaks.overlaps(d, t).first()
    assert (r["item_id"], r["run"], r["stretch"], r["mismatches"]) == (7, 11, 30, 2)


# --- 10 ---------------------------------------------------------------------------------------------------------
SENTENCES = [
    ["“The ladder rose?” Gilbert Orbow asked.", "Mr. Nash paid 1.55 crowns at 6 p.m. sharp.", "J. R. Grim of St. Orrin Rd. bought No. 8, e.g. the coin, and so on.", "He left at 1 p.m.", "They sat."],
    ["‘No,’ said Capt. Hale, ‘not yet.’", "N.B. The gate shut.", "He counted to ten ... then went.", "(It rang.)", "Why?!"],
    ["Die Uhr kostete 24,50 Taler, z. B. auf dem Markt.", "Am 19. Mai kam Dr. Quell.", "„Wo ist die Treppe?“, fragte er.", "Sie sagte: „Die Karte gehört mir.“", "In Haus Nr. 24 schlief er!"],
    ["« Où est la carte ? » demanda le notaire.", "Vers 5 h. il vendit la cloche…", "M. Tavernoy répondit : « Elle est à moi. »", "Oui, p. ex. au port."],
    ["«¿Dónde está?», preguntó.", "La Sra. Ubrique guardó la jaula... y calló.", "¡Nadie vio el núm. 7!"],
    ["— Где мой сундук? — спросил писарь.", "Он дал 7,5 руб. за замок, т. е. мало.", "В 1870 г. сосед ушёл."],
    ["डॉ. वेलंकी ने घड़ी देखी।", "“सीढ़ी कहाँ है?” नाविक ने सुबह पूछा।", "दाम 12.5 रुपये था।"],
    ["«أين الصندوق؟» سأل الجار.", "قال د. نوراز إن الجار باع الحبل.", "كان ثمن 7.5 دراهم."],
    ["ระฆังราคา 12.5 บาท", "เรือราคา 7 บาท", "ไม่มีใครเห็น"],
    ["Πού είναι η σκάλα;", "Ο κ. Νάσος πλήρωσε, π.χ. για το ρολόι.", "Έφυγε!"],
    ["ខ្ញុំទៅផ្សារ។", "គាត់នៅផ្ទះ។"],
    ["ང་ཁྲོམ་ལ་འགྲོ།", "ཁོང་ནང་ལ་ཡོད།"],
    ["እኔ ወደ ገበያ ሄድኩ።", "እሱ ቤት ነው።"],
    ["Ես գնացի շուկա։", "Նա տանն է։"],
    ["Il sig. Neri non vide la chiave, p. es. nella torre.", "Chi era con lui?", "Il Dott. Bassi tornò."],
    ["De heer en dhr. Vos zagen het huis, d.w.z. niet de molen.", "Wie was dat?"],
]


@pytest.mark.parametrize("parts", SENTENCES)
def test_p10_languages(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.sentences(text)] == parts


def test_p10_no_space_after_signs():
    assert [e for _, e in sentences.sentences("እኔ ሄድኩ።እሱ ቤት ነው።")] == [7, 16]
    assert sentences.language("The gate of the mill was by the river, and he was not in it.")["latin"] == "en" and sentences.language("Ja.")["latin"] is None


def test_p10_far_context():
    """What decides may stand far away: a long quotation before its speaker, a long name of a speaker."""
    long = "那个" * 300
    assert len(sentences.sentences(f"“水车在哪里？”{long}的村长问道。他走了。")) == 2
    text = "“Where is it?” the Keeper of the Great Old Northern Mill and the Long Low Bridge of Orrin asked. He left."
    assert len(sentences.sentences(text)) == 2


def test_p10_scripts_without_spaces():
    for parts in (["「船はどこですか。」と渡し守が尋ねた。", "しかし……彼は黙った。", "誰も見なかった！"], ["“水车在哪里？”村长问道。", "他说：“绳子是我的。”", "邻居走了。"]):
        text = "".join(parts)
        assert [text[a:b] for a, b in sentences.sentences(text)] == parts


def test_p10_blocks_and_edges(spark):
    text = "CHAPTER I\n\nDear Ann,\n\nOne line\nbreak here. Two. \n \nYours ever,\nBo\n"
    assert [text[a:b] for a, b in sentences.sentences(text)] == ["CHAPTER I", "Dear Ann,", "One line\nbreak here.", "Two.", "Yours ever,\nBo"]
    df = spark.createDataFrame([(1, "A. B"), (2, None), (3, " \n "), (4, "x " * 50_000), (1, "A. B"), (None, "Hi.")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in sentences.found(df).filter("doc_id IS NOT NULL").collect())
    assert got[-1] == (4, 99_999) and {r[0] for r in got} == {1, 4}
    assert sentences.found(df.limit(0)).count() == 0


DATA = os.environ.get("LORELOOM_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, DATA)
    r = con.execute(oracles.SQL[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == sorted(df.columns)
    assert sorted((tuple(x[c] for c in at) for x in df.collect()), key=repr) == sorted(r.fetchall(), key=repr)


def test_every_query_is_registered():
    q = queries.queries()
    assert {f"p{n}_found" for n in (*range(1, 8), 9, 10)} <= set(q) and "p8_containers" in q
    assert F.lit(1) is not None
