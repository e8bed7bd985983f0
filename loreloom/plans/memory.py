"""Queries over the resolved memory: merged tables, the way from questions to scored answers, and what a front end shows; each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreloom.functions import text as t
from loreloom.operators import evaluate, graph, index, merge, resolve, retrieve, segment
from loreloom.plans import plugins, prompts
from loreloom.plans import queries as q
from loreloom.session import cut, table
from loreloom.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STORY_K, WORLD_K, CARDS = 5, 7, 3


def query(sql: str):
    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return wrap


# --- resolved tables --------------------------------------------------------------------------------------------
def _merged(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    m = merge.once(table(spark, d, name), key).filter("book_id IS NOT NULL")
    out = merge.ordered_merge(m, {"book": F.col("book_id"), "name": t.norm_ws(F.col("name"))}, key, ("name",), ("description",), "source_chunk_ids")
    return out.select(F.col("k_book").alias("book_id"), "first_ord", "name", "description", "sources")


def _by_canonical(rows: DataFrame, best: str) -> DataFrame:
    keep = {"first": ("description",)} if best == "first" else {"longest": ("description",)}
    out = merge.ordered_merge(rows, {"book": F.col("book_id"), "name": F.col("name")}, "first_ord", sources="sources", keep_blank=True, **keep)
    return out.select("k_book", "k_name", "n", "first_ord", "description", "sources")


def _json(df: DataFrame) -> DataFrame:
    return df.withColumn("sources", F.to_json("sources"))


def _canonical_sql(source: str, best: str) -> str:
    """source: a query of book_id, c (canonical name), first_ord, description, sources (JSON)."""
    pick = "min({'o': first_ord, 'v': description}).v" if best == "first" else "nullif(arg_max(coalesce(description, '<null>'), {'l': length(coalesce(description, '')), 'o': -first_ord}), '<null>')"
    return f"""k AS (SELECT book_id AS k_book, c AS k_name, first_ord, description, CAST(sources AS INTEGER[]) AS source_chunk_ids FROM ({source})),
 g AS (SELECT k_book, k_name, count(*) AS n, min(first_ord) AS first_ord, {pick} AS description FROM k GROUP BY 1, 2), {q._sources_sql('k', 'k_book, k_name', 'first_ord')}"""


_MERGED = "(SELECT k_book AS book_id, * EXCLUDE (k_book) FROM ({}) WHERE k_book IS NOT NULL)"
_CHARS, _LOCS = (_MERGED.format(q._named_sql(n, k)) for n, k in (("character_extractions", "char_key"), ("location_extractions", "loc_key")))
_RESOLVED = _canonical_sql(f"SELECT m.book_id, coalesce(a.canonical, m.name) AS c, m.first_ord, m.description, m.sources FROM {_CHARS} m LEFT JOIN amap a ON a.book_id = m.book_id AND a.alias_key = {q.nfkc_sql('m.name')}", "longest")


@query(f"WITH {q._resolved_sql()}, {_RESOLVED} SELECT * FROM f")
def resolved_characters(spark: SparkSession, d: str) -> DataFrame:
    return _json(_characters(spark, d))


def _characters(spark: SparkSession, d: str) -> DataFrame:
    return _by_canonical(resolve.resolve(_merged(spark, d, "character_extractions", "char_key"), "name", q.maps(spark, d)[0]), "longest")


@query(f"WITH {q._LMAP}, {_canonical_sql(f'SELECT m.book_id, coalesce(l.canonical, m.name) AS c, m.first_ord, m.description, m.sources FROM {_LOCS} m LEFT JOIN lmap l ON l.book_id = m.book_id AND l.alias_key = ' + q.nfkc_sql('m.name'), 'first')} SELECT * FROM f")
def resolved_locations(spark: SparkSession, d: str) -> DataFrame:
    return _json(_by_canonical(resolve.resolve(_merged(spark, d, "location_extractions", "loc_key"), "name", q.maps(spark, d)[1]), "first"))


@query(f"WITH {q._resolved_sql()} SELECT book_id, canonical, to_json(list(name ORDER BY ord)) AS aliases FROM (SELECT sc.book_id, ca.canonical, sc.fc, sc.name, sc.ord FROM sc JOIN ca ON ca.book_id = sc.book_id AND ca.fc = sc.fc) GROUP BY book_id, canonical, fc")
def alias_report(spark: SparkSession, d: str) -> DataFrame:
    """The spellings of each character under its canonical name, in order of appearance."""
    return resolve.report(resolve.same_names(q.names(spark, d))).select("book_id", "canonical", F.to_json("aliases").alias("aliases"))


_SEMANTIC = _canonical_sql(f"SELECT m.k_book AS book_id, coalesce(p.canonical, m.k_name) AS c, m.first_ord, m.description, m.sources FROM (WITH {q._resolved_sql()}, {_RESOLVED} SELECT * FROM f) m LEFT JOIN plan p ON p.book_id = m.k_book AND p.alias_key = {q.norm_sql('m.k_name')}", "longest")


@query(f"WITH RECURSIVE {q.PLAN}, {_SEMANTIC} SELECT * FROM f")
def semantic_characters(spark: SparkSession, d: str) -> DataFrame:
    """The resolved characters merged once more as the accepted plan says."""
    c = _characters(spark, d).select(F.col("k_book").alias("book_id"), F.col("k_name").alias("name"), "first_ord", "description", "sources")
    return _json(_by_canonical(resolve.resolve(c, "name", q.merge_plan(spark, d), key=t.norm_ws(F.col("name"))), "longest"))


def _planned(c: str, src: str) -> str:
    return f"(SELECT r.*, coalesce(p.canonical, r.{c}) AS m_{c} FROM {src} r LEFT JOIN plan p ON p.book_id = r.book_id AND p.alias_key = {q.norm_sql('r.' + c)})"


@query(f"""WITH RECURSIVE {q.PLAN}, k AS (SELECT *, book_id AS k_book, {q.norm_sql('m_subject')} AS k_s, {q.norm_sql('relation')} AS k_r, {q.norm_sql('m_object')} AS k_o FROM {_planned('object', _planned('subject', q.RELATIONS))}),
 g AS (SELECT k_book, k_s, k_r, k_o, count(*) AS n, min(rel_key) AS first_ord, arg_min(coalesce(m_subject, ''), rel_key) AS subject, arg_min(coalesce(m_object, ''), rel_key) AS object FROM k GROUP BY 1, 2, 3, 4), {q._sources_sql('k', 'k_book, k_s, k_r, k_o', 'rel_key')} SELECT * FROM f""")
def semantic_relationships(spark: SparkSession, d: str) -> DataFrame:
    plan, r = cut(q.merge_plan(spark, d)), q.relations(spark, d)
    for c in ("subject", "object"):
        r = resolve.resolve(r, c, plan, key=t.norm_ws(F.col(c)))
    by = {"book": F.col("book_id"), "s": t.norm_ws(F.col("subject")), "r": t.norm_ws(F.col("relation")), "o": t.norm_ws(F.col("object"))}
    out = merge.ordered_merge(r, by, "rel_key", ("subject", "object"), sources="source_chunk_ids", keep_blank=True)
    return _json(out.withColumns({c: t.text_or_empty(F.col(c)) for c in ("subject", "object")}))


@query(f"""WITH RECURSIVE {q.PLAN}, e AS (SELECT event_key, book_id, participants[pos] AS p, pos FROM (SELECT *, unnest(range(1, len(participants) + 1)) AS pos FROM {q._EVENTS})),
 m AS (SELECT e.event_key, coalesce(p.canonical, e.p) AS p, min(e.pos) AS pos FROM e LEFT JOIN plan p ON p.book_id = e.book_id AND p.alias_key = {q.norm_sql('e.p')} WHERE e.p IS NOT NULL GROUP BY 1, 2) SELECT event_key, to_json(list(p ORDER BY pos)) AS participants FROM m GROUP BY 1""")
def semantic_events(spark: SparkSession, d: str) -> DataFrame:
    """Participants as the accepted plan says; locations stay as they are."""
    e = merge.once(table(spark, d, "event_extractions"), "event_key").filter("book_id IS NOT NULL")
    return q.participants_of(e, q.merge_plan(spark, d), key=t.norm_ws(F.col("p")))


# --- merges -----------------------------------------------------------------------------------------------------
_FACT_ROWS = f"(SELECT * FROM {q.RELATIONS} WHERE starts_with(coalesce(relation, ''), 'is_'))"


@query(f"""WITH k AS (SELECT *, book_id AS k_book, {q.norm_sql('subject')} AS k_s, {q.norm_sql('relation')} AS k_p, {q.norm_sql('object')} AS k_o FROM {_FACT_ROWS}),
 g AS (SELECT k_book, k_s, k_p, k_o, count(*) AS n, min(rel_key) AS first_ord, min({{'o': rel_key, 'v': relation}}).v AS predicate, min({{'o': rel_key, 'v': explanation}}).v AS explanation FROM k GROUP BY 1, 2, 3, 4), {q._sources_sql('k', 'k_book, k_s, k_p, k_o', 'rel_key')} SELECT * FROM f""")
def merged_facts(spark: SparkSession, d: str) -> DataFrame:
    f = q.relations(spark, d).filter(F.col("relation").startswith("is_")).withColumnRenamed("relation", "predicate")
    by = {"book": F.col("book_id"), "s": t.norm_ws(F.col("subject")), "p": t.norm_ws(F.col("predicate")), "o": t.norm_ws(F.col("object"))}
    return _json(merge.ordered_merge(f, by, "rel_key", ("predicate", "explanation"), sources="source_chunk_ids", keep_blank=True))


@query(f"""WITH k AS (SELECT *, book_id AS k_book, {q.norm_sql('name')} AS k_name FROM {q.once_sql('character_extractions', 'char_key')} WHERE {q.norm_sql('name')} <> ''),
 g AS (SELECT k_book, k_name, count(*) AS n, min(char_key) AS first_ord, arg_min({q.clean_sql('name')}, char_key) AS name FROM k GROUP BY 1, 2) SELECT * FROM g""")
def batch_characters(spark: SparkSession, d: str) -> DataFrame:
    """The merge of batches: names without the white space about them, blank ones dropped."""
    m = merge.once(table(spark, d, "character_extractions"), "char_key").withColumn("name", t.clean_text(F.col("name")))
    return merge.ordered_merge(m, {"book": F.col("book_id"), "name": t.norm_ws(F.col("name"))}, "char_key", ("name",))


@query(f"SELECT book_id AS k_book, {q.norm_sql('summary')} AS k_summary, count(*) AS n, min(event_key) AS first_ord FROM {q.once_sql('event_extractions', 'event_key')} GROUP BY 1, 2")
def batch_events(spark: SparkSession, d: str) -> DataFrame:
    """The merge of batches keeps events without a summary, as one."""
    m = merge.once(table(spark, d, "event_extractions"), "event_key")
    return merge.ordered_merge(m, {"book": F.col("book_id"), "summary": t.norm_ws(F.col("summary"))}, "event_key", keep_blank=True)


_BATCHED = f"(SELECT book_id, chunk_id, any_value(chapter) AS chapter, min(batch) AS batch FROM (SELECT *, ((row_number() OVER (PARTITION BY book_id ORDER BY chunk_id, chunk_key) - 1) // 18)::INT AS batch FROM {q.once_sql('chunks', 'chunk_key')}) GROUP BY 1, 2)"


@query(f"""WITH e AS (SELECT event_key, book_id, source_chunk_ids[pos] AS chunk_id, pos FROM (SELECT *, unnest(range(1, len(source_chunk_ids) + 1)) AS pos FROM {q.once_sql('event_extractions', 'event_key')})),
 m AS (SELECT e.event_key, c.chunk_id, c.batch, min(e.pos) AS pos FROM e JOIN {_BATCHED} c ON c.book_id = e.book_id AND c.chunk_id = e.chunk_id GROUP BY 1, 2, 3), b AS (SELECT event_key, arg_min(batch, pos) AS batch FROM m GROUP BY 1)
 SELECT m.event_key, m.chunk_id, m.batch, (row_number() OVER (PARTITION BY m.event_key ORDER BY m.pos) - 1)::INT AS place FROM m JOIN b ON b.event_key = m.event_key AND b.batch = m.batch""")
def allowed_sources(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that each event may name: of one batch of 18, once each, in the order they are named in."""
    c = segment.batches(q.chunks_once(spark, d).select("book_id", "chunk_id", "chunk_key").dropDuplicates(["book_id", "chunk_id"]), spark.createDataFrame([], "book_id bigint, chunk_id int"))
    e = merge.once(table(spark, d, "event_extractions"), "event_key")
    s = merge.sources_of(e, "source_chunk_ids", c.select("book_id", "chunk_id", "batch"), "event_key", batch="batch")
    w = Window.partitionBy("event_key").orderBy("pos")
    return s.select("event_key", "chunk_id", "batch", (F.row_number().over(w) - 1).cast("int").alias("place"))


_STRUCTURED = {
    "characters": ("character_extractions", "char_key", ("name",)), "locations": ("location_extractions", "loc_key", ("name",)), "events": ("event_extractions", "event_key", ("summary",)),
    "relationships": (q.RELATIONS, "rel_key", ("subject", "relation", "object")), "facts": (_FACT_ROWS.replace("SELECT *", "SELECT * RENAME (relation AS predicate)", 1), "rel_key", ("subject", "predicate", "object")),
}


def _structured_sql(category: str) -> str:
    src, key, cols = _STRUCTURED[category]
    rows = src if src.startswith("(") else f"(SELECT * FROM {q.once_sql(src, key)} WHERE book_id IS NOT NULL)"
    keys = " || chr(31) || ".join(q.norm_sql(c) for c in cols)
    return f"SELECT '{category}' AS category, book_id, {keys} AS key, count(*) AS n, min({key}) AS first_ord FROM {rows} GROUP BY ALL"


@query(" UNION ALL ".join(_structured_sql(c) for c in _STRUCTURED))
def structured_memory(spark: SparkSession, d: str) -> DataFrame:
    """Every category of a story's structured memory under the key its profile gives; blank keys are kept."""
    one = lambda n, k: merge.once(table(spark, d, n), k).filter("book_id IS NOT NULL")
    r = q.relations(spark, d)
    rows = {c: one(*_STRUCTURED[c][:2]) for c in ("characters", "locations", "events")} | {"relationships": r, "facts": r.filter(F.col("relation").startswith("is_")).withColumnRenamed("relation", "predicate")}
    out = None
    for c, df in rows.items():
        _, key, cols = _STRUCTURED[c]
        m = merge.structured(df.select("book_id", key, *cols), "story", c, key, by=("book_id",))
        x = m.select(F.lit(c).alias("category"), F.col("k_book_id").alias("book_id"), F.concat_ws("\x1f", *[F.col(f"k_{k}") for k in cols]).alias("key"), "n", "first_ord")
        out = x if out is None else out.unionByName(x)
    return out


@query(f"""WITH k AS (SELECT *, {q.norm_sql('name')} AS k FROM {q.once_sql('character_extractions', 'char_key')}) SELECT k, min(char_key) AS first_ord, arg_min(name, char_key) AS name, max(length(coalesce(description, '')))::INT AS len, count(*) AS n FROM k WHERE k <> '' GROUP BY 1""")
def streamed_merge(spark: SparkSession, d: str) -> DataFrame:
    """The merge by a stream that is stopped, started again on nothing new, and asked for its state."""
    return incremental.streamed(spark, f"{d}/character_extractions.parquet", "name", "description", "char_key").select("k", "first_ord", "name", "len", "n")


# --- from questions to answers ----------------------------------------------------------------------------------
_ASKED = f"(SELECT * FROM {q.once_sql('evaluation_results', 'result_key')} WHERE result_key % 20 = 0)"


def _vectors_sql(name: str, src: str, key: str, text: str) -> str:
    return f"""{name}_v AS (SELECT {key} AS id, h % 64 AS dim, sum(CASE WHEN (h // 64) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM (SELECT {key}, ('0x' || left(md5(w), 4))::INT AS h FROM (SELECT {key}, unnest({q.words_sql(f"lower({text})")}) AS w FROM {src})) GROUP BY 1, 2),
 {name} AS (SELECT s.{key} AS id, coalesce(n.norm, 1) AS norm FROM {src} s LEFT JOIN (SELECT id, nullif(sqrt(sum(v * v)), 0) AS norm FROM {name}_v GROUP BY 1) n ON n.id = s.{key})"""


def _best_sql(name: str, rows: str, k: int) -> str:
    return f"""{name} AS (SELECT result_key, id, score, rank FROM (SELECT a.id AS result_key, b.id, coalesce(round(s.dot / (a.norm * b.norm), 9), 0) AS score, row_number() OVER (PARTITION BY a.id ORDER BY coalesce(round(s.dot / (a.norm * b.norm), 9), 0) DESC, b.id DESC)::INT AS rank
 FROM asked a CROSS JOIN {rows} b LEFT JOIN (SELECT x.id AS qid, y.id AS rid, sum(x.v * y.v) AS dot FROM asked_v x JOIN {rows}_v y ON y.dim = x.dim GROUP BY 1, 2) s ON s.qid = a.id AND s.rid = b.id) WHERE rank <= {k})"""


EVIDENCE = f"""qs AS (SELECT result_key, coalesce(question, '') AS question, coalesce(unanswerable, false) AS un, {q._GROUPS} AS grp FROM {_ASKED}), cs AS (SELECT * FROM {q.once_sql('chunks', 'chunk_key')}), {q.ITEMS},
 ws AS (SELECT row_number() OVER (ORDER BY type_rank, ord) - 1 AS world_item_id, * FROM items), {_vectors_sql('asked', 'qs', 'result_key', 'question')}, {_vectors_sql('story', 'cs', 'chunk_key', 'text')}, {_vectors_sql('world', 'ws', 'world_item_id', 'text')},
 {_best_sql('story_best', 'story', STORY_K)}, {_best_sql('world_best', 'world', WORLD_K)}"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every question whose key is divisible by 20, with one vector that serves both memories."""
    r = merge.once(table(spark, d, "evaluation_results"), "result_key").filter("result_key % 20 = 0")
    r = r.select("result_key", t.text_or_empty(F.col("question")).alias("question"), F.coalesce("unanswerable", F.lit(False)).alias("unanswerable"), q.concept_groups().alias("groups"))
    return cut(plugins.embed(r, "question", plugins.DigestEmbedder()))


def world(spark: SparkSession, d: str) -> DataFrame:
    items = index.items(q.world_parts(spark, d)).select("type_rank", "type", "ord", "text", "sources")
    return cut(index.dense_ids(items, ["type_rank", "ord"]))


def evidence(questions: DataFrame, rows: DataFrame, key: str, k: int) -> DataFrame:
    """(result_key, rank, key, score): the k nearest rows of every question."""
    v = plugins.embed(rows.select(key, "text"), "text", plugins.DigestEmbedder())
    asked_ = questions.select(F.col("result_key").alias(key), "embedding")
    return retrieve.top_k_many(v, asked_, k, key, digits=9).withColumnRenamed("query_id", "result_key")


@query(f"WITH {EVIDENCE} SELECT result_key, 'story' AS memory, rank, id, round(score, 6) AS score FROM story_best UNION ALL SELECT result_key, 'world', rank, id, round(score, 6) FROM world_best")
def question_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The nearest story chunks and world items of every question that is asked."""
    qs = asked(spark, d)
    one = lambda rows, key, k, kind: evidence(qs, rows, key, k).select("result_key", F.lit(kind).alias("memory"), "rank", F.col(key).alias("id"), F.round("score", 6).alias("score"))
    return one(q.chunks_once(spark, d), "chunk_key", STORY_K, "story").unionByName(one(world(spark, d), "world_item_id", WORLD_K, "world"))


def _context(spark: SparkSession, d: str) -> DataFrame:
    """(result_key, question, unanswerable, groups, story, story_text, world, world_text): contexts and plain evidence of every question that is asked."""
    qs, w = asked(spark, d), world(spark, d)
    chunks = q.chunks_once(spark, d)
    s = evidence(qs, chunks, "chunk_key", STORY_K).join(chunks, "chunk_key")
    s = s.withColumn("section", prompts.story_section(F.col("rank"), F.col("chapter"), F.col("page_start"), F.col("page_end"), F.col("chunk_id"), F.col("text"))).withColumn("text", t.text_or_empty(F.col("text")))
    v = evidence(qs, w, "world_item_id", WORLD_K).join(w, "world_item_id")
    v = v.withColumn("section", prompts.world_section(F.col("rank"), F.col("type"), F.col("text"), t.source_list(F.col("sources"))))
    out = qs
    for rows, name in ((s, "story"), (v, "world")):
        out = out.join(prompts.joined(rows, "result_key", "rank", "section").withColumnRenamed("context", name), "result_key", "left").join(prompts.joined(rows, "result_key", "rank", "text").withColumnRenamed("context", f"{name}_text"), "result_key", "left")
    return out.fillna("", ["story", "story_text", "world", "world_text"])


_STORY = "chr(10) || '[STORY EVIDENCE ' || rank::VARCHAR || ']' || chr(10) || chr(10) || 'Chapter:' || chr(10) || coalesce(chapter, 'Unknown') || chr(10) || chr(10) || 'Pages:' || chr(10) || coalesce(page_start::VARCHAR, '?') || ' - ' || coalesce(coalesce(page_end, page_start)::VARCHAR, '?') || chr(10) || chr(10) || 'Chunk ID:' || chr(10) || coalesce(chunk_id::VARCHAR, '?') || chr(10) || chr(10) || 'PASSAGE:' || chr(10) || chr(10) || coalesce(text, '') || chr(10)"
_WORLD = "chr(10) || '[WORLD MEMORY ' || rank::VARCHAR || ']' || chr(10) || chr(10) || 'Type:' || chr(10) || type || chr(10) || chr(10) || 'Structured knowledge:' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Evidence sources:' || chr(10) || 'No source metadata' || chr(10)"
CONTEXT = f"""{EVIDENCE}, sctx AS (SELECT b.result_key, string_agg({_STORY}, chr(10) ORDER BY rank) AS story, string_agg(coalesce(text, ''), chr(10) ORDER BY rank) AS story_text FROM story_best b JOIN cs ON cs.chunk_key = b.id GROUP BY 1),
 wctx AS (SELECT b.result_key, string_agg({_WORLD}, chr(10) ORDER BY rank) AS world, string_agg(text, chr(10) ORDER BY rank) AS world_text FROM world_best b JOIN ws ON ws.world_item_id = b.id GROUP BY 1),
 ctx AS (SELECT qs.*, coalesce(story, '') AS story, coalesce(story_text, '') AS story_text, coalesce(world, '') AS world, coalesce(world_text, '') AS world_text FROM qs LEFT JOIN sctx USING (result_key) LEFT JOIN wctx USING (result_key)),
 pr AS (SELECT *, concat_ws(chr(10) || chr(10), '{prompts.RULES["story_only"]}', 'STORY EVIDENCE:', story, 'QUESTION:', question) AS story_prompt, concat_ws(chr(10) || chr(10), '{prompts.RULES["hybrid"]}', 'STORY EVIDENCE:', story, 'STRUCTURED MEMORY:', world, 'QUESTION:', question) AS hybrid_prompt FROM ctx)"""


def _prompted(spark: SparkSession, d: str) -> DataFrame:
    c = _context(spark, d)
    return c.withColumn("story_prompt", prompts.answer_prompt("story_only", F.col("question"), F.col("story"))).withColumn("hybrid_prompt", prompts.answer_prompt("hybrid", F.col("question"), F.col("story"), F.col("world")))


@query(f"WITH {CONTEXT} SELECT result_key, md5(story_prompt) AS story_prompt, md5(hybrid_prompt) AS hybrid_prompt FROM pr")
def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompts of both arms, from what was retrieved."""
    return _prompted(spark, d).select("result_key", F.md5("story_prompt").alias("story_prompt"), F.md5("hybrid_prompt").alias("hybrid_prompt"))


def _covers(text: str) -> str:
    return q._COVER.replace("contains(ans,", f"contains({q.norm_sql(text)},")


def _echo(p: str) -> str:
    return f"CASE WHEN contains({p}, 'PASSAGE:') THEN string_split(regexp_replace(substring({p}, strpos({p}, 'PASSAGE:') + 8), '^{q.WS}|{q.WS}$', '', 'g'), chr(10))[1] ELSE '{t.UNKNOWN_RESPONSE}' END"


def _scores_sql(arm: str) -> str:
    cites, refused = rf"regexp_matches({arm}_answer, '(?i)\[Pages?\s+[0-9]+')", f"contains({q.norm_sql(arm + '_answer')}, {q.norm_sql(repr(t.UNKNOWN_RESPONSE))})"
    one = f"CASE WHEN {refused} THEN 1.0 ELSE 0.0 END"
    return f"CASE WHEN un THEN {one} ELSE round(0.8 * {_covers(arm + '_answer')} + CASE WHEN {cites} THEN 0.2 ELSE 0.0 END, 4) END::DOUBLE"


ANSWERS = f"""{CONTEXT}, an AS (SELECT *, {_echo('story_prompt')} AS story_answer, {_echo('hybrid_prompt')} AS hybrid_answer FROM pr),
 ev AS (SELECT result_key, round({_covers('story_text')}, 4) AS story_coverage, round({_covers("story_text || chr(10) || world_text")}, 4) AS hybrid_coverage, md5(story_answer) AS story_answer, md5(hybrid_answer) AS hybrid_answer, {_scores_sql('story')} AS story_quality, {_scores_sql('hybrid')} AS hybrid_quality FROM an)"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    # answers are written down once, as a model would be asked once
    c = cut(plugins.generate(plugins.generate(_prompted(spark, d), "story_prompt", name="story_answer"), "hybrid_prompt", name="hybrid_answer"))
    cover = lambda x: F.round(evaluate.concept_coverage(x, F.col("groups")), 4)
    quality = lambda a: evaluate.score_answer(F.col(a), F.col("groups"), F.col("unanswerable"))["quality_score"]
    both = F.concat_ws("\n", "story_text", "world_text")
    scored = c.select("result_key", cover(F.col("story_text")).alias("story_coverage"), cover(both).alias("hybrid_coverage"), "story_answer", "hybrid_answer", quality("story_answer").alias("story_quality"), quality("hybrid_answer").alias("hybrid_quality"))
    # only now, lest the scores take the digests for the answers
    return scored.withColumns({a: F.md5(a) for a in ("story_answer", "hybrid_answer")})


_WINNER = "CASE WHEN hybrid_quality > story_quality THEN 'hybrid' WHEN story_quality > hybrid_quality THEN 'story_only' ELSE 'tie' END"


@query(f"WITH {ANSWERS} SELECT *, {_WINNER} AS winner FROM ev")
def answered_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions answered in both arms from what was retrieved (offline generator), with coverage of the evidence, quality and winner."""
    return _evaluated(spark, d).withColumn("winner", evaluate.winner(F.col("story_quality"), F.col("hybrid_quality")))


@query(f"""WITH {ANSWERS} SELECT count(*) AS questions, round(avg(story_quality), 4) AS story_only_average_score, round(avg(hybrid_quality), 4) AS hybrid_average_score, round(avg(story_coverage), 4) AS story_only_average_coverage, round(avg(hybrid_coverage), 4) AS hybrid_average_coverage,
 count(*) FILTER (hybrid_quality > story_quality) AS hybrid_wins, count(*) FILTER (story_quality > hybrid_quality) AS story_only_wins, count(*) FILTER (story_quality = hybrid_quality) AS ties FROM ev""")
def answer_summary(spark: SparkSession, d: str) -> DataFrame:
    e = answered_questions(spark, d)
    return evaluate.summary(e.withColumnsRenamed({"story_quality": "story_q", "hybrid_quality": "hybrid_q", "story_coverage": "story_c", "hybrid_coverage": "hybrid_c"}))


@query(f"""WITH {EVIDENCE}, c AS (SELECT b.result_key, cs.book_id, cs.chunk_id, min(b.rank) AS rank FROM story_best b JOIN cs ON cs.chunk_key = b.id GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY result_key ORDER BY rank)::INT AS card FROM c)
 SELECT n.result_key, n.card, n.chunk_id, coalesce(x.chapter, 'Unknown') AS chapter, x.page_start, x.page_end, md5(CASE WHEN length({q.clean_sql('x.text')}) <= 350 THEN {q.clean_sql('x.text')} ELSE rtrim(left({q.clean_sql('x.text')}, 350)) || '...' END) AS excerpt
 FROM n JOIN story_best b ON b.result_key = n.result_key AND b.rank = n.rank JOIN cs x ON x.chunk_key = b.id WHERE card <= {CARDS}""")
def source_cards(spark: SparkSession, d: str) -> DataFrame:
    """The first three source cards of every question: its story chunks, once each, with an excerpt."""
    chunks = q.chunks_once(spark, d)
    s = evidence(asked(spark, d), chunks, "chunk_key", STORY_K).join(chunks, "chunk_key")
    return graph.cards(s, "result_key", CARDS).withColumn("excerpt", F.md5("excerpt"))


# --- what models and front ends are given -----------------------------------------------------------------------
_CAT = "string_agg({}, chr(10) ORDER BY {})"
_ENTRY = "chr(10) || 'NAME:' || chr(10) || coalesce(name, '') || chr(10) || chr(10) || 'DESCRIPTION:' || chr(10) || coalesce(description, '') || chr(10)"
_LINE = "chr(10) || coalesce(subject, '') || chr(10) || '--' || coalesce(relation, '') || '-->' || chr(10) || coalesce(object, '') || chr(10) || chr(10) || 'Evidence explanation:' || chr(10) || coalesce(explanation, '') || chr(10)"


@query(f"""WITH rows AS (SELECT book_id, 0 AS part, first_ord AS o, {_ENTRY} AS x FROM {_CHARS} UNION ALL SELECT book_id, CASE WHEN starts_with(coalesce(relation, ''), 'is_') THEN 2 ELSE 1 END, rel_key, {_LINE} FROM {q.RELATIONS})
 SELECT book_id, part, md5({_CAT.format('x', 'o')}) AS context FROM rows GROUP BY 1, 2""")
def character_context(spark: SparkSession, d: str) -> DataFrame:
    """What a model that proposes merges is given of each book: its characters (0), relationships (1) and facts (2), each as one text, since it goes into one prompt."""
    c = _merged(spark, d, "character_extractions", "char_key").select("book_id", F.lit(0).alias("part"), F.col("first_ord").alias("o"), prompts.character_entry(F.col("name"), F.col("description")).alias("x"))
    fact = F.coalesce(F.col("relation").startswith("is_"), F.lit(False))
    r = q.relations(spark, d).select("book_id", F.when(fact, 2).otherwise(1).alias("part"), F.col("rel_key").alias("o"), prompts.statement_entry(F.col("subject"), F.col("relation"), F.col("object"), F.col("explanation")).alias("x"))
    g = c.unionByName(r).groupBy("book_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda y: y["x"]), "\n").alias("context"))
    return g.withColumn("context", F.md5("context"))


@query(f"""WITH c AS (SELECT *, ((row_number() OVER (PARTITION BY book_id ORDER BY chunk_key) - 1) // 18)::INT AS batch, row_number() OVER (PARTITION BY book_id ORDER BY chunk_key) AS rn FROM {q.once_sql('chunks', 'chunk_key')})
 SELECT book_id, batch, md5('{prompts.EXTRACT["story"]} Give each record the ids of its chunks in source_chunk_ids.' || chr(10) || chr(10) || string_agg('Chunk ' || chunk_id::VARCHAR || ', chapter ' || coalesce(chapter, 'Unknown') || chr(10) || chr(10) || coalesce(text, ''), chr(10) ORDER BY rn)) AS prompt FROM c GROUP BY 1, 2""")
def batch_prompts(spark: SparkSession, d: str) -> DataFrame:
    """One extraction prompt for every 18 chunks of a book."""
    c = segment.batches(q.chunks_once(spark, d), spark.createDataFrame([], "chunk_key bigint, book_id bigint"), key="chunk_key")
    x = c.withColumn("x", F.concat_ws("\n\n", F.concat(F.lit("Chunk "), F.col("chunk_id").cast("string"), F.lit(", chapter "), F.coalesce("chapter", F.lit("Unknown"))), t.text_or_empty(F.col("text"))))
    g = x.groupBy("book_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_key", "x"))), lambda y: y["x"]), "\n").alias("x"))
    return g.select("book_id", "batch", F.md5(prompts.batch_prompt(F.col("x"))).alias("prompt"))


@query(f"WITH {q.BLOCKS}, h AS (SELECT *, {q.clean_sql('text')} AS x FROM blocks) SELECT doc_id, page, block_ord, x AS chapter FROM h WHERE {q.heading_sql('x')}")
def detected_headings(spark: SparkSession, d: str) -> DataFrame:
    return segment.headings(q.blocks(spark, d), order=("block_ord",))


@query(f"""SELECT b.book_id, b.title, coalesce(c.n, 0) AS chunks, coalesce(k.n, 0) AS characters, coalesce(r.n, 0) AS relationships FROM (SELECT book_id, min(title) AS title FROM books GROUP BY 1) b LEFT JOIN (SELECT book_id, count(DISTINCT chunk_key) AS n FROM chunks GROUP BY 1) c USING (book_id)
 LEFT JOIN (SELECT book_id, count(*) AS n FROM {_CHARS} GROUP BY 1) k USING (book_id) LEFT JOIN (SELECT book_id, count(*) AS n FROM {q.RELATIONS} GROUP BY 1) r USING (book_id)""")
def story_info(spark: SparkSession, d: str) -> DataFrame:
    """What a front end says of each story: its title and how much is known."""
    count = lambda df, name: df.groupBy("book_id").agg(F.count("*").alias(name))
    out = table(spark, d, "books").groupBy("book_id").agg(F.min("title").alias("title"))
    for df, name in ((table(spark, d, "chunks").select("book_id", "chunk_key").distinct(), "chunks"), (_merged(spark, d, "character_extractions", "char_key"), "characters"), (q.relations(spark, d), "relationships")):
        out = out.join(count(df, name), "book_id", "left")
    return out.fillna(0, ["chunks", "characters", "relationships"])


_XY = "round(450 + 220 * cos(2 * pi() / count(*) OVER (PARTITION BY book_id) * (rank - 1) - pi() / 2), 4) AS x, round(300 + 220 * sin(2 * pi() / count(*) OVER (PARTITION BY book_id) * (rank - 1) - pi() / 2), 4) AS y"


@query(f"""WITH {q.EDGES}, l AS (SELECT book_id, name, {_XY} FROM top) SELECT c.book_id, c.rel_key, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ce c JOIN l a ON a.book_id = c.book_id AND a.name = c.subject JOIN l b ON b.book_id = c.book_id AND b.name = c.object""")
def graph_drawing(spark: SparkSession, d: str) -> DataFrame:
    """The edges among the busiest nodes of each book, from point to point."""
    c, top = q._graph(spark, d)
    return graph.drawn(c, graph.layout(top, "book_id"), "book_id", "rel_key")
