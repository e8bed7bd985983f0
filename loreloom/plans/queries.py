"""The named queries of the core, each beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreloom.functions import text as t
from loreloom.operators import evaluate, graph, index, merge, resolve, retrieve, segment
from loreloom.operators.ordered import numbered
from loreloom.plans import prompts
from loreloom.session import cut, table
from loreloom.sources.schemas import SOURCE
from loreloom.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# --- pieces of SQL ----------------------------------------------------------------------------------------------
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def clean_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}', ' ', 'g'))"


def norm_sql(c: str) -> str:
    return f"lower({clean_sql(c)})"


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '{WS}'), lambda w: w <> '')"


def nfkc_sql(c: str) -> str:
    low = f"lower(nfc_normalize(coalesce({c}, '')))"
    return rf"trim(regexp_replace(regexp_replace({low}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '{WS}', ' ', 'g'))"


def once_sql(name: str, key: str) -> str:
    return f"(SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at) AS _rn FROM {name} WHERE {key} IS NOT NULL) WHERE _rn = 1)"


def heading_sql(x: str) -> str:
    primary = rf"regexp_matches({x}, '(?i)^(chapter|part|book)\s+([0-9]+|[ivxlcdm]+)\.?(\s+.*)?$')"
    capitals = rf"(len(string_split({x}, ' ')) BETWEEN 2 AND 10 AND upper({x}) = {x} AND NOT regexp_matches({x}, '\p{{Nd}}') AND regexp_matches({x}, '\p{{L}}'))"
    return rf"({x} <> '' AND length({x}) <= 150 AND ({primary} OR regexp_matches({x}, '^[IVXLCDM]+\.\s+[A-Za-z]') OR {capitals}))"


PRIMARY = r"(length({x}) <= 150 AND regexp_matches({x}, '(?i)^(chapter|part|book)\s+([0-9]+|[ivxlcdm]+)\.?(\s+.*)?$'))"
TITLE = "CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.TITLES.items()) + " END"


def query(sql: str | None):
    """Register the decorated function under its own name, with its SQL where SQL can say it."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


# --- tables -----------------------------------------------------------------------------------------------------
def chunks_once(spark: SparkSession, d: str) -> DataFrame:
    return merge.once(table(spark, d, "chunks"), "chunk_key")


#: Blocks are numbered by chunk and, in 32 bits below, by their place in it.
PLACE = 1 << 32


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of all chunks as page blocks: doc_id, page, block_ord, text."""
    c = chunks_once(spark, d).select(F.col("book_id").alias("doc_id"), F.col("page_start").alias("page"), "chunk_id", F.posexplode(F.split(t.text_or_empty(F.col("text")), "\n\n")).alias("pos", "text"))
    return c.select("doc_id", "page", (F.col("chunk_id").cast("bigint") * PLACE + F.col("pos")).alias("block_ord"), "text").filter(t.is_text_block(F.col("text")))


_PAGES = f"(SELECT book_id AS doc_id, page_start AS page, coalesce(text, '') AS text FROM {once_sql('chunks', 'chunk_key')})"
_LINES = r"list_filter(list_transform(string_split_regex(text, '\r\n|[\n\x0b\f\r]'), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '')"
_TOC = rf"(contains(lower(text), 'table of contents') OR regexp_matches(lower(text), '\bcontents\b') OR len(list_filter({_LINES}, lambda x: regexp_matches(x, '\.{{4,}}'))) >= 2 OR len(list_filter({_LINES}, lambda x: regexp_matches(x, '\s\d{{1,4}}\s*$'))) >= 5)"
START = f"""SELECT doc_id, coalesce(min(page) FILTER (NOT toc AND headed), min(page) FILTER (NOT toc AND filled), 1)::INT AS start FROM
 (SELECT *, {_TOC} AS toc, len(list_filter(string_split(text, E'\\n\\n'), lambda b: {clean_sql('b')} <> '' AND {PRIMARY.format(x=clean_sql('b'))})) > 0 AS headed, len({words_sql("array_to_string(string_split(text, E'\\n\\n'), ' ')")}) >= 150 AS filled FROM {_PAGES}) GROUP BY 1"""
BLOCKS = f"""blocks AS (SELECT * FROM (SELECT book_id AS doc_id, page_start AS page, chunk_id::BIGINT * 4294967296 + pos - 1 AS block_ord, parts[pos] AS text FROM
 (SELECT *, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT *, string_split(coalesce(text, ''), E'\\n\\n') AS parts FROM {once_sql('chunks', 'chunk_key')})))
 WHERE {clean_sql('text')} <> '' AND NOT regexp_matches({clean_sql('text')}, '^\\d+$'))"""
CHAPTERS = f"""{BLOCKS}, p AS ({START}), h AS (SELECT b.*, {clean_sql('text')} AS x FROM blocks b JOIN p ON p.doc_id = b.doc_id AND b.page >= p.start), h2 AS (SELECT *, {heading_sql('x')} AS is_heading FROM h),
 c AS (SELECT *, coalesce(last_value(CASE WHEN is_heading THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Story Beginning') AS chapter FROM h2),
 i1 AS (SELECT *, CASE WHEN chapter <> lag(chapter) OVER (PARTITION BY doc_id ORDER BY block_ord) THEN 1 ELSE 0 END AS fresh FROM c),
 isl AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY block_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INT AS island FROM i1)"""
PIECES = f"""{CHAPTERS}, w AS (SELECT *, {words_sql('text')} AS ws FROM isl),
 pieces AS (SELECT doc_id, page, chapter, island, is_heading, block_ord, 0 AS piece, text FROM w WHERE len(ws) <= 300 UNION ALL
  SELECT doc_id, page, chapter, island, is_heading, block_ord, k AS piece, array_to_string(ws[k * 220 + 1 : k * 220 + 220], ' ') AS text FROM (SELECT *, unnest(range(0, (len(ws) + 219) // 220)) AS k FROM w WHERE len(ws) > 300))"""


def chaptered(spark: SparkSession, d: str) -> DataFrame:
    """The blocks from the start of each story on, with their chapters."""
    return segment.carry_chapters(segment.from_start(blocks(spark, d), story_starts(spark, d)), order=("block_ord",), span=64 * PLACE)


def names(spark: SparkSession, d: str, name: str = "character_extractions", key: str = "char_key") -> DataFrame:
    return table(spark, d, name).filter("name IS NOT NULL AND book_id IS NOT NULL").groupBy("book_id", "name").agg(F.min(key).alias("ord"))


PARSED = ("subject", "relation", "object", "explanation")


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Statements, one row a key. Fields that are null come from the JSON object in raw_record, whatever the order and letter case of its names; only broken JSON is left out."""
    r = merge.once(table(spark, d, "relationship_extractions"), "rel_key").filter("book_id IS NOT NULL")
    # a text that breaks off inside an object is no JSON, though the parser gives the fields before the break
    whole = F.when(F.col("raw_record").rlike(r"\}\s*$"), F.col("raw_record"))
    r = r.withColumn("_e", F.map_entries(F.from_json(whole, "map<string,string>"))).filter("raw_record IS NULL OR _e IS NOT NULL")
    field = lambda c: F.coalesce(F.col(c), F.try_element_at(F.filter("_e", lambda x: F.lower(F.trim(x["key"])) == c), F.lit(1))["value"])
    return r.withColumns({c: field(c) for c in PARSED}).drop("_e", "raw_record")


_FIELD = "coalesce({c}, list_filter(kv, lambda e: lower(trim(e.key)) = '{c}')[1].value)"
RELATIONS = f"""(SELECT * EXCLUDE (kv, raw_record) REPLACE ({', '.join(_FIELD.format(c=c) + f' AS {c}' for c in PARSED)}) FROM (SELECT *, CASE WHEN raw_record IS NOT NULL AND json_valid(raw_record) THEN list_transform(json_keys(raw_record), lambda x: {{'key': x, 'value': json_extract_string(raw_record, '$."' || x || '"')}}) ELSE [] END AS kv
 FROM {once_sql('relationship_extractions', 'rel_key')} WHERE book_id IS NOT NULL AND (raw_record IS NULL OR json_valid(raw_record))))"""


# --- retrieval --------------------------------------------------------------------------------------------------
@query("""SELECT row_number() OVER (ORDER BY score DESC, vec_id DESC)::INT AS rank, vec_id, round(score, 4) AS score FROM (SELECT e.vec_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
 FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY score DESC, vec_id DESC LIMIT 5""")
def topk_story(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieve.top_k(e, e.filter("vec_id = 0"), 5).withColumn("score", F.round("score", 4))


@query("""SELECT * FROM (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id DESC)::INT AS rank, e.vec_id,
 round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 7""")
def topk_world_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieve.top_k_many(e, e.filter("vec_id % 20 = 0"), 7).withColumn("score", F.round("score", 4))


# --- text -------------------------------------------------------------------------------------------------------
@query(rf"""SELECT chunk_key, md5({clean_sql('text')}) AS cleaned, md5({norm_sql('text')}) AS normalised, len({words_sql('text')}) AS words,
 CASE WHEN length({clean_sql('text')}) <= 350 THEN {clean_sql('text')} ELSE rtrim(left({clean_sql('text')}, 350)) || '...' END AS excerpt FROM {once_sql('chunks', 'chunk_key')}""")
def text_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return chunks_once(spark, d).select("chunk_key", F.md5(t.clean_text(x)).alias("cleaned"), F.md5(t.norm_ws(x)).alias("normalised"), t.word_count(x).cast("bigint").alias("words"), t.excerpt(x).alias("excerpt"))


@query(f"SELECT DISTINCT name, {nfkc_sql('name')} AS normalised FROM character_extractions WHERE name IS NOT NULL")
def names_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "character_extractions").select("name").filter("name IS NOT NULL").distinct().select("name", t.norm_nfkc(F.col("name")).alias("normalised"))


_TOK = f"(SELECT *, list_filter(string_split({nfkc_sql('name')}, ' '), lambda w: w <> '') AS tok FROM (SELECT DISTINCT name FROM character_extractions WHERE name IS NOT NULL))"
_CORE = f"(SELECT *, {TITLE.format(x='tok[1]')} AS title, CASE WHEN {TITLE.format(x='tok[1]')} IS NOT NULL THEN tok[2:] ELSE tok END AS core FROM {_TOK})"


@query(f"SELECT name, title, array_to_string(core, ' ') AS core, (100 * len(core) + length(name) + CASE WHEN len(core) >= 2 THEN 200 ELSE 0 END + CASE WHEN title IS NOT NULL THEN 10 ELSE 0 END)::BIGINT AS score FROM {_CORE}")
def name_titles(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "character_extractions").select("name").filter("name IS NOT NULL").distinct()
    tok = t.name_tokens(F.col("name"))
    return n.select("name", t.title_of(tok).alias("title"), F.array_join(t.core_tokens(tok), " ").alias("core"), t.name_score(F.col("name")).cast("bigint").alias("score"))


@query(f"WITH {BLOCKS}, x AS (SELECT *, {clean_sql('text')} AS x FROM blocks) SELECT doc_id, block_ord, {PRIMARY.format(x='x')} AS is_primary, {heading_sql('x')} AS is_heading FROM x")
def block_headings(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return blocks(spark, d).select("doc_id", "block_ord", t.is_primary_heading(x).alias("is_primary"), t.is_heading(x).alias("is_heading"))


@query(f"SELECT doc_id, page, count(*) AS pages, count(*) FILTER ({_TOC}) AS toc_pages FROM {_PAGES} GROUP BY 1, 2")
def toc_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunks_once(spark, d).groupBy(F.col("book_id").alias("doc_id"), F.col("page_start").alias("page")).agg(F.count("*").alias("pages"), F.count_if(t.is_toc_page(F.col("text"))).alias("toc_pages"))


@query(START)
def story_starts(spark: SparkSession, d: str) -> DataFrame:
    p = chunks_once(spark, d).select(F.col("book_id").alias("doc_id"), F.col("page_start").alias("page"), t.text_or_empty(F.col("text")).alias("raw_text")).withColumn("blocks", F.split("raw_text", "\n\n"))
    return segment.story_start(p)


_RETRY = r"coalesce(TRY_CAST(nullif(regexp_extract(e, '(?i)retry in ([0-9.]+)s', 1), '') AS DOUBLE) + 2, TRY_CAST(nullif(regexp_extract(e, '(?i)retry after ([0-9.]+)s', 1), '') AS DOUBLE), 30.0)"
_ERROR = "CASE event_id % 4 WHEN 0 THEN '429: Please retry in ' || (event_id % 90)::VARCHAR || '.5s' WHEN 1 THEN 'Retry after ' || (event_id % 50)::VARCHAR || 's or RETRY IN 7s' WHEN 2 THEN 'retry after ' || (event_id % 20)::VARCHAR || 's' ELSE 'deadline' END"


@query(f"SELECT event_id, {_RETRY} AS wait FROM (SELECT event_id, {_ERROR} AS e FROM events)")
def retry_wait(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    s = lambda n: (i % n).cast("string")
    e = F.when(i % 4 == 0, F.concat(F.lit("429: Please retry in "), s(90), F.lit(".5s"))).when(i % 4 == 1, F.concat(F.lit("Retry after "), s(50), F.lit("s or RETRY IN 7s"))).when(i % 4 == 2, F.concat(F.lit("retry after "), s(20), F.lit("s"))).otherwise("deadline")
    return table(spark, d, "events").select("event_id", t.retry_seconds(e).alias("wait"))


_SHORT = "CASE WHEN len(string_split(subject, ' ')) <= 2 THEN subject ELSE string_split(subject, ' ')[1] || ' ' || string_split(subject, ' ')[-1] END"
_PRETTY = "array_to_string(list_transform(regexp_extract_all(replace(relation, '_', ' '), '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda w: CASE WHEN regexp_matches(w, '^[a-z]') THEN upper(left(w, 1)) || substring(w, 2) ELSE w END), '')"


@query(f"SELECT rel_key, replace(relation, '_', ' ') AS humanised, {_PRETTY} AS pretty, {_SHORT} AS short FROM {RELATIONS} WHERE relation IS NOT NULL AND subject IS NOT NULL")
def relation_labels(spark: SparkSession, d: str) -> DataFrame:
    r = relations(spark, d).filter("relation IS NOT NULL AND subject IS NOT NULL")
    return r.select("rel_key", t.humanise(F.col("relation")).alias("humanised"), t.pretty_relation(F.col("relation")).alias("pretty"), t.short_name(F.col("subject")).alias("short"))


_SRC = "'Chapter=' || coalesce(chapter, 'Unknown') || ', Pages=' || coalesce(page_start::VARCHAR, '?') || '-' || coalesce(coalesce(page_end, page_start)::VARCHAR, '?') || ', Chunk=' || coalesce(chunk_id::VARCHAR, '?')"
_PGL = "'Pages ' || page_start::VARCHAR || CASE WHEN page_end IS NOT NULL AND page_end <> page_start THEN '–' || page_end::VARCHAR ELSE '' END"


@query(f"SELECT chunk_key, {_SRC} AS source, {_PGL} AS pages FROM {once_sql('chunks', 'chunk_key')}")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    return chunks_once(spark, d).select("chunk_key", t.source_label(F.col("chapter"), F.col("page_start"), F.col("page_end"), F.col("chunk_id")).alias("source"), t.page_label(F.col("page_start"), F.col("page_end")).alias("pages"))


@query(r"""SELECT doc_id, CASE WHEN starts_with(text, 'Character:') THEN trim(replace(string_split(text, '.')[1], 'Character:', '')) END AS name FROM documents WHERE doc_kind = 'world_item' AND text IS NOT NULL""")
def item_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("doc_kind = 'world_item' AND text IS NOT NULL").select("doc_id", t.name_from_text(F.lit(None).cast("string"), F.col("text")).alias("name"))


# --- segmentation -----------------------------------------------------------------------------------------------
@query(f"WITH {CHAPTERS} SELECT doc_id, block_ord, chapter, island, is_heading FROM isl")
def chapter_islands(spark: SparkSession, d: str) -> DataFrame:
    return chaptered(spark, d).select("doc_id", "block_ord", "chapter", "island", "is_heading")


@query(f"WITH {PIECES} SELECT doc_id, block_ord, piece, len({words_sql('text')})::INT AS words, md5(text) AS text_md5 FROM pieces")
def split_blocks(spark: SparkSession, d: str) -> DataFrame:
    return segment.split_blocks(chaptered(spark, d)).select("doc_id", "block_ord", "piece", "words", F.md5("text").alias("text_md5"))


@query(f"""WITH RECURSIVE {PIECES}, n AS (SELECT doc_id, island, {{'b': block_ord, 'p': piece}} AS o, page, chapter, text, len({words_sql('text')})::BIGINT AS words FROM pieces),
 n2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY o) AS rn FROM n),
 r AS (SELECT doc_id, island, rn, o, words, words AS cur, 0 AS seq, 0 AS flush FROM n2 WHERE rn = 1 UNION ALL
  SELECT n2.doc_id, n2.island, n2.rn, n2.o, n2.words, CASE WHEN r.cur >= 220 THEN r.words ELSE r.cur END + n2.words, r.seq + CASE WHEN r.cur >= 220 THEN 1 ELSE 0 END, CASE WHEN r.cur >= 220 THEN 1 ELSE 0 END
  FROM r JOIN n2 ON n2.doc_id = r.doc_id AND n2.island = r.island AND n2.rn = r.rn + 1),
 m AS (SELECT doc_id, island, o, seq FROM r UNION ALL SELECT p.doc_id, p.island, p.o, r.seq FROM r JOIN r p ON p.doc_id = r.doc_id AND p.island = r.island AND p.rn = r.rn - 1 WHERE r.flush = 1),
 g AS (SELECT m.doc_id, m.island, m.seq, arg_min(n.page, n.o) AS page_start, arg_max(n.page, n.o) AS page_end, arg_min(n.chapter, n.o) AS chapter, sum(n.words)::INT AS word_count, string_agg(n.text, E'\\n\\n' ORDER BY n.o) AS text
  FROM m JOIN n ON n.doc_id = m.doc_id AND n.island = m.island AND n.o = m.o GROUP BY 1, 2, 3)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY island, seq) - 1)::INT AS chunk_id, page_start, page_end, chapter, word_count, md5(text) AS text_md5 FROM g WHERE word_count >= 25""")
def rebuilt_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.chunks(segment.split_blocks(chaptered(spark, d))).withColumn("text_md5", F.md5("text")).drop("text")


@query(f"""WITH done AS (SELECT DISTINCT book_id, unnest(source_chunk_ids) AS chunk_id FROM event_extractions), todo AS (SELECT c.book_id, c.chunk_id FROM {once_sql('chunks', 'chunk_key')} c WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.book_id = c.book_id AND done.chunk_id = c.chunk_id))
 SELECT book_id, chunk_id, ((row_number() OVER (PARTITION BY book_id ORDER BY chunk_id) - 1) // 18)::INT AS batch FROM todo""")
def remaining_batches(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "event_extractions").select("book_id", F.explode("source_chunk_ids").alias("chunk_id"))
    return segment.batches(chunks_once(spark, d).select("book_id", "chunk_id"), done)


@query("SELECT DISTINCT book_id, id FROM (SELECT book_id, unnest(source_chunk_ids) AS id FROM event_extractions) WHERE id IS NOT NULL")
def processed_ids(spark: SparkSession, d: str) -> DataFrame:
    return merge.processed_ids(table(spark, d, "event_extractions"), "book_id", "source_chunk_ids")


@query(f"""SELECT e.event_key, c.chunk_id, any_value(c.chapter) AS chapter, any_value(c.page_start) AS page_start FROM (SELECT DISTINCT event_key, book_id, unnest(source_chunk_ids) AS chunk_id FROM event_extractions) e
 JOIN {once_sql('chunks', 'chunk_key')} c ON c.book_id = e.book_id AND c.chunk_id = e.chunk_id GROUP BY 1, 2""")
def hydrated_sources(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "event_extractions").select("event_key", "book_id", F.explode("source_chunk_ids").alias("chunk_id")).distinct()
    return e.join(chunks_once(spark, d).select("book_id", "chunk_id", "chapter", "page_start"), ["book_id", "chunk_id"]).select("event_key", "chunk_id", "chapter", "page_start")


# --- merges -----------------------------------------------------------------------------------------------------
def _sources_sql(src: str, keys: str, ord: str) -> str:
    on = " AND ".join(f"s.{k.strip()} IS NOT DISTINCT FROM g.{k.strip()}" for k in keys.split(","))
    return f"""s1 AS (SELECT {keys}, src, min({{'o': {ord}, 'p': pos}}) AS seen_at FROM (SELECT {keys}, {ord}, source_chunk_ids[pos] AS src, pos FROM (SELECT *, unnest(range(1, len(source_chunk_ids) + 1)) AS pos FROM {src})) WHERE src IS NOT NULL GROUP BY {keys}, src),
 s AS (SELECT {keys}, to_json(list(src ORDER BY seen_at)) AS sources FROM s1 GROUP BY {keys}), f AS (SELECT g.*, coalesce(s.sources, '[]') AS sources FROM g LEFT JOIN s ON {on})"""


def _named_sql(name: str, key: str) -> str:
    return f"""WITH k AS (SELECT *, {norm_sql('name')} AS k_name, book_id AS k_book FROM {once_sql(name, key)} WHERE {norm_sql('name')} <> ''),
 g AS (SELECT k_book, k_name, count(*) AS n, min({key}) AS first_ord, arg_min(name, {key}) AS name, arg_max(coalesce(description, '<null>'), {{'l': length(coalesce(description, '')), 'o': -{key}}}) AS description FROM k GROUP BY 1, 2), {_sources_sql('k', 'k_book, k_name', key)}
 SELECT k_book, k_name, n, first_ord, name, nullif(description, '<null>') AS description, sources FROM f"""


def _named(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    m = merge.once(table(spark, d, name), key)
    return merge.ordered_merge(m, {"book": F.col("book_id"), "name": t.norm_ws(F.col("name"))}, key, ("name",), ("description",), "source_chunk_ids").withColumn("sources", F.to_json("sources"))


@query(_named_sql("character_extractions", "char_key"))
def merged_characters(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d, "character_extractions", "char_key")


@query(_named_sql("location_extractions", "loc_key"))
def merged_locations(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d, "location_extractions", "loc_key")


@query(f"""WITH k AS (SELECT *, book_id AS k_book, {norm_sql('subject')} AS k_s, {norm_sql('relation')} AS k_r, {norm_sql('object')} AS k_o FROM {RELATIONS}),
 g AS (SELECT k_book, k_s, k_r, k_o, count(*) AS n, min(rel_key) AS first_ord, min({{'o': rel_key, 'v': explanation}}).v AS explanation FROM k GROUP BY 1, 2, 3, 4), {_sources_sql('k', 'k_book, k_s, k_r, k_o', 'rel_key')} SELECT * FROM f""")
def merged_relationships(spark: SparkSession, d: str) -> DataFrame:
    by = {"book": F.col("book_id"), "s": t.norm_ws(F.col("subject")), "r": t.norm_ws(F.col("relation")), "o": t.norm_ws(F.col("object"))}
    return merge.ordered_merge(relations(spark, d), by, "rel_key", ("explanation",), sources="source_chunk_ids", keep_blank=True).withColumn("sources", F.to_json("sources"))


@query(f"""WITH k AS (SELECT *, book_id AS k_book, {norm_sql('summary')} AS k_summary FROM {once_sql('event_extractions', 'event_key')} WHERE {norm_sql('summary')} <> ''),
 g AS (SELECT k_book, k_summary, count(*) AS n, min(event_key) AS first_ord, min({{'o': event_key, 'v': location}}).v AS location FROM k GROUP BY 1, 2), {_sources_sql('k', 'k_book, k_summary', 'event_key')} SELECT * FROM f""")
def merged_events(spark: SparkSession, d: str) -> DataFrame:
    m = merge.once(table(spark, d, "event_extractions"), "event_key")
    return merge.ordered_merge(m, {"book": F.col("book_id"), "summary": t.norm_ws(F.col("summary"))}, "event_key", ("location",), sources="source_chunk_ids").withColumn("sources", F.to_json("sources"))


@query(f"""SELECT book_id AS k_book, {norm_sql('name')} AS k_name, count(*) AS n, min(char_key) AS first_ord, min({{'o': char_key, 'v': description}}).v AS description FROM {once_sql('character_extractions', 'char_key')} GROUP BY 1, 2""")
def structured_characters(spark: SparkSession, d: str) -> DataFrame:
    m = merge.once(table(spark, d, "character_extractions"), "char_key")
    return merge.ordered_merge(m, {"book": F.col("book_id"), "name": t.norm_ws(F.col("name"))}, "char_key", ("description",), keep_blank=True)


@query(f"""SELECT category, count(*) AS n FROM (SELECT 'characters' AS category FROM character_extractions GROUP BY char_key UNION ALL SELECT 'locations' FROM location_extractions GROUP BY loc_key UNION ALL SELECT 'relationships' FROM relationship_extractions GROUP BY rel_key
 UNION ALL SELECT 'events' FROM event_extractions GROUP BY event_key) GROUP BY 1""")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for c, n, k in (("characters", "character_extractions", "char_key"), ("locations", "location_extractions", "loc_key"), ("relationships", "relationship_extractions", "rel_key"), ("events", "event_extractions", "event_key")):
        x = table(spark, d, n).select(k).distinct().groupBy().agg(F.count("*").alias("n")).select(F.lit(c).alias("category"), "n")
        out = x if out is None else out.unionAll(x)
    return out


@query(f"""WITH k AS (SELECT *, {norm_sql('name')} AS k FROM {once_sql('character_extractions', 'char_key')}) SELECT k, min(char_key) AS first_ord, arg_min(name, char_key) AS name, max(length(coalesce(description, '')))::INT AS len, count(*) AS n FROM k WHERE k <> '' GROUP BY 1""")
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    m = merge.once(table(spark, d, "character_extractions"), "char_key")
    return incremental.merged_in_batches(m, 3, "name", "description", "char_key").select("k", "first_ord", "name", "len", "n")


# --- resolution -------------------------------------------------------------------------------------------------
def _resolved_sql() -> str:
    return f"""n0 AS (SELECT book_id, name, min(char_key) AS ord FROM character_extractions WHERE name IS NOT NULL AND book_id IS NOT NULL GROUP BY 1, 2),
 n1 AS (SELECT *, list_filter(string_split({nfkc_sql('name')}, ' '), lambda w: w <> '') AS tok FROM n0), n2 AS (SELECT *, {TITLE.format(x='tok[1]')} AS title FROM n1),
 n3 AS (SELECT *, CASE WHEN title IS NOT NULL THEN tok[2:] ELSE tok END AS ct FROM n2), n4 AS (SELECT *, array_to_string(ct, ' ') AS core, len(ct) AS nt FROM n3),
 n5 AS (SELECT *, bool_or(title IS NULL) OVER (PARTITION BY book_id, core) AS has_bare FROM n4), n6 AS (SELECT n5.*, x.n_titles FROM n5 JOIN (SELECT book_id, core, count(DISTINCT title) AS n_titles FROM n4 GROUP BY 1, 2) x USING (book_id, core)),
 n7 AS (SELECT *, CASE WHEN nt = 0 THEN '#' || ord::VARCHAR WHEN nt >= 2 THEN CASE WHEN has_bare THEN core || '|*' ELSE core || '|' || coalesce(title, '') END WHEN n_titles <= 1 THEN core || '|*' ELSE core || '|' || coalesce(title, '') END AS comp FROM n6),
 tg AS (SELECT s.book_id, s.ord, min(f.comp) AS target FROM n7 s JOIN n7 f ON f.book_id = s.book_id AND f.nt >= 2 AND f.ct[-1] = s.core AND (s.title IS NULL OR f.title IS NULL OR s.title = f.title) WHERE s.nt = 1 AND NOT (s.title IS NULL AND s.n_titles > 1) GROUP BY 1, 2 HAVING count(DISTINCT f.comp) = 1),
 n8 AS (SELECT n7.*, coalesce(max(tg.target) OVER (PARTITION BY n7.book_id, comp), comp) AS fc FROM n7 LEFT JOIN tg ON tg.book_id = n7.book_id AND tg.ord = n7.ord),
 sc AS (SELECT *, 100 * nt + length(name) + CASE WHEN nt >= 2 THEN 200 ELSE 0 END + CASE WHEN title IS NOT NULL THEN 10 ELSE 0 END AS score FROM n8),
 ca AS (SELECT book_id, fc, arg_max(name, {{'s': score, 'o': -ord}}) AS canonical, min(ord) AS g FROM sc GROUP BY 1, 2),
 amap AS (SELECT sc.book_id, {nfkc_sql('sc.name')} AS alias_key, arg_max(ca.canonical, {{'g': ca.g, 'v': ca.canonical}}) AS canonical FROM sc JOIN ca ON ca.book_id = sc.book_id AND ca.fc = sc.fc WHERE {nfkc_sql('sc.name')} <> '' GROUP BY 1, 2)"""


_LMAP = f"""lmap AS (SELECT book_id, alias_key, arg_max(name, {{'l': length(name), 'o': -ord}}) AS canonical FROM (SELECT book_id, name, min(loc_key) AS ord, {nfkc_sql('name')} AS alias_key FROM location_extractions WHERE name IS NOT NULL AND book_id IS NOT NULL GROUP BY ALL) WHERE alias_key <> '' GROUP BY 1, 2)"""


@query(f"WITH {_resolved_sql()} SELECT * FROM amap")
def character_aliases(spark: SparkSession, d: str) -> DataFrame:
    return resolve.alias_map(resolve.same_names(names(spark, d)))


@query(f"WITH {_LMAP} SELECT * FROM lmap")
def location_aliases(spark: SparkSession, d: str) -> DataFrame:
    return resolve.longest_names(names(spark, d, "location_extractions", "loc_key"))


def _mapped(c: str, src: str) -> str:
    return f"(SELECT r.*, coalesce(a.canonical, l.canonical, r.{c}) AS m_{c} FROM {src} r LEFT JOIN amap a ON a.book_id = r.book_id AND a.alias_key = {nfkc_sql('r.' + c)} LEFT JOIN lmap l ON l.book_id = r.book_id AND l.alias_key = {nfkc_sql('r.' + c)})"


def _statements_sql(where: str) -> str:
    return f"""WITH {_resolved_sql()}, {_LMAP}, k AS (SELECT *, book_id AS k_book, {nfkc_sql('m_subject')} AS k_s, {nfkc_sql('relation')} AS k_r, {nfkc_sql('m_object')} AS k_o FROM {_mapped('object', _mapped('subject', f'(SELECT * FROM {RELATIONS} WHERE {where})'))}),
 g AS (SELECT k_book, k_s, k_r, k_o, count(*) AS n, min(rel_key) AS first_ord, arg_min(coalesce(m_subject, ''), rel_key) AS subject, arg_min(coalesce(m_object, ''), rel_key) AS object, arg_min(coalesce(explanation, ''), rel_key) AS explanation FROM k GROUP BY 1, 2, 3, 4), {_sources_sql('k', 'k_book, k_s, k_r, k_o', 'rel_key')} SELECT * FROM f"""


def maps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The alias maps of characters and of locations, written down since several columns are looked up in them."""
    return cut(resolve.alias_map(resolve.same_names(names(spark, d)))), cut(resolve.longest_names(names(spark, d, "location_extractions", "loc_key")))


def _statements(spark: SparkSession, d: str, where: str) -> DataFrame:
    first, second = maps(spark, d)
    r = resolve.resolve(resolve.resolve(relations(spark, d).filter(where), "subject", first, second), "object", first, second)
    keys = {"s": "subject", "r": "relation", "o": "object"}
    # keys are worked out once for the merge and for the sources
    r = cut(r.select("book_id", "rel_key", "subject", "object", "explanation", "source_chunk_ids", *[t.norm_nfkc(F.col(c)).alias(f"_{k}") for k, c in keys.items()]))
    by = {"book": F.col("book_id"), **{k: F.col(f"_{k}") for k in keys}}
    out = merge.ordered_merge(r, by, "rel_key", ("subject", "object", "explanation"), sources="source_chunk_ids", keep_blank=True).withColumn("sources", F.to_json("sources"))
    return out.withColumns({c: t.text_or_empty(F.col(c)) for c in ("subject", "object", "explanation")})


# The tables have no facts; statements that say what somebody is stand in for them.
@query(_statements_sql("TRUE"))
def resolved_relationships(spark: SparkSession, d: str) -> DataFrame:
    return _statements(spark, d, "TRUE")


@query(_statements_sql("starts_with(coalesce(relation, ''), 'is_')"))
def resolved_facts(spark: SparkSession, d: str) -> DataFrame:
    return _statements(spark, d, "startswith(coalesce(relation, ''), 'is_')")


_EVENTS = f"(SELECT * FROM {once_sql('event_extractions', 'event_key')} WHERE book_id IS NOT NULL)"


@query(f"""WITH {_resolved_sql()}, {_LMAP}, e AS (SELECT event_key, book_id, participants[pos] AS p, pos FROM (SELECT *, unnest(range(1, len(participants) + 1)) AS pos FROM {_EVENTS})),
 m AS (SELECT e.event_key, coalesce(a.canonical, l.canonical, e.p) AS p, min(e.pos) AS pos FROM e LEFT JOIN amap a ON a.book_id = e.book_id AND a.alias_key = {nfkc_sql('e.p')} LEFT JOIN lmap l ON l.book_id = e.book_id AND l.alias_key = {nfkc_sql('e.p')} WHERE e.p IS NOT NULL GROUP BY 1, 2),
 ps AS (SELECT event_key, to_json(list(p ORDER BY pos)) AS participants FROM m GROUP BY 1)
 SELECT x.event_key, coalesce(ps.participants, '[]') AS participants, coalesce(x.m_location, '') AS location FROM {_mapped('location', _EVENTS)} x LEFT JOIN ps ON ps.event_key = x.event_key""")
def resolved_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event with its participants and its location under their canonical names; events are not merged."""
    first, second = maps(spark, d)
    e = merge.once(table(spark, d, "event_extractions"), "event_key").filter("book_id IS NOT NULL")
    where = resolve.resolve(e.select("event_key", "book_id", "location"), "location", first, second)
    return where.join(participants_of(e, first, second), "event_key", "left").select("event_key", F.coalesce("participants", F.lit("[]")).alias("participants"), t.text_or_empty(F.col("location")).alias("location"))


def participants_of(events: DataFrame, first: DataFrame, second: DataFrame | None = None, key=None) -> DataFrame:
    """(event_key, participants as JSON): mapped, and each once in the order of its first mention. An event has as many as were written down."""
    p = events.select("event_key", "book_id", F.posexplode("participants").alias("pos", "p")).filter("p IS NOT NULL")
    m = resolve.resolve(p, "p", first, second, key=key)
    g = m.groupBy("event_key").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("ps"))
    return g.select("event_key", F.to_json(F.array_distinct(F.transform("ps", lambda x: x["p"]))).alias("participants"))


PLAN = f"""nm AS (SELECT DISTINCT book_id, name FROM character_extractions WHERE name IS NOT NULL AND book_id IS NOT NULL),
 pg AS (SELECT g.book_id, g.alias_group_key AS o, g.canonical, list_filter(list_concat(coalesce(g.aliases, []), [g.canonical]), lambda a: a IS NOT NULL) AS al FROM {once_sql('semantic_entity_aliases', 'alias_group_key')} g JOIN nm ON nm.book_id = g.book_id AND nm.name = g.canonical WHERE g.confidence = 'high'),
 pa AS (SELECT DISTINCT pg.book_id, pg.o, pg.canonical, nm.name FROM (SELECT *, unnest(al) AS a FROM pg) pg JOIN nm ON nm.book_id = pg.book_id AND nm.name = pg.a),
 pk AS (SELECT book_id, o, canonical, list_distinct(list({norm_sql('name')})) AS keys FROM pa GROUP BY 1, 2, 3 HAVING count(*) >= 2), pn AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY o) AS rn FROM pk),
 pr AS (SELECT book_id, 0::BIGINT AS rn, MAP {{}}::MAP(VARCHAR, VARCHAR) AS m FROM pn GROUP BY 1 UNION ALL
  SELECT pn.book_id, pn.rn, CASE WHEN len(list_filter(pn.keys, lambda k: map_contains(pr.m, k) AND pr.m[k] <> pn.canonical)) > 0 THEN pr.m
   ELSE map_concat(pr.m, map_from_entries(list_transform(list_filter(pn.keys, lambda k: NOT map_contains(pr.m, k)), lambda k: {{'k': k, 'v': pn.canonical}}))) END FROM pr JOIN pn ON pn.book_id = pr.book_id AND pn.rn = pr.rn + 1),
 pm AS (SELECT book_id, unnest(map_entries(arg_max(m, rn))) AS e FROM pr GROUP BY 1), plan AS (SELECT book_id, e.key AS alias_key, e.value AS canonical FROM pm)"""


@query(f"WITH RECURSIVE {PLAN} SELECT * FROM plan")
def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """Greedy acceptance in the order of the proposals."""
    g = merge.once(table(spark, d, "semantic_entity_aliases"), "alias_group_key").withColumn("ord", F.col("alias_group_key"))
    return resolve.valid_plan(g, table(spark, d, "character_extractions").select("book_id", "name"))


# --- index ------------------------------------------------------------------------------------------------------
def world_parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    named = lambda n, k, kind: _named(spark, d, n, k).select(F.col("first_ord").alias("ord"), index.named_text(kind, F.col("name"), F.col("description")).alias("text"), "name")
    rel = relations(spark, d).select(F.col("rel_key").alias("ord"), index.statement_text(F.col("subject"), F.col("relation"), F.col("object"), F.col("explanation")).alias("text"), "subject", "relation", "object")
    ev = merge.once(table(spark, d, "event_extractions"), "event_key").select(F.col("event_key").alias("ord"), index.event_text(F.col("summary"), F.col("participants"), F.col("location"), F.col("explanation")).alias("text"), "summary")
    fact = F.coalesce(F.col("relation").startswith("is_"), F.lit(False))
    parts = {"character": named("character_extractions", "char_key", "Character"), "location": named("location_extractions", "loc_key", "Location"), "relationship": rel.filter(~fact), "fact": rel.filter(fact), "event": ev}
    # the ids of sources repeat from book to book, so items of several books name none
    return {k: v.withColumn("sources", F.lit(None).cast(f"array<{SOURCE}>")) for k, v in parts.items()}


_STATEMENT = "coalesce(subject, '') || ' ' || replace(coalesce(relation, ''), '_', ' ') || ' ' || coalesce(object, '') || '. ' || coalesce(explanation, '')"
_EVENT = "'Event: ' || coalesce(summary, '') || '. Participants: ' || coalesce(array_to_string(list_filter(participants, lambda p: p IS NOT NULL), ', '), '') || '. ' || CASE WHEN coalesce(location, '') <> '' THEN 'Location: ' || location || '. ' ELSE '' END || coalesce(explanation, '')"
ITEMS = f"""items AS (SELECT 0 AS type_rank, 'character' AS type, first_ord AS ord, 'Character: ' || coalesce(name, '') || '. ' || coalesce(description, '') AS text FROM ({_named_sql('character_extractions', 'char_key')})
 UNION ALL SELECT 1, 'location', first_ord, 'Location: ' || coalesce(name, '') || '. ' || coalesce(description, '') FROM ({_named_sql('location_extractions', 'loc_key')})
 UNION ALL SELECT CASE WHEN starts_with(coalesce(relation, ''), 'is_') THEN 3 ELSE 2 END, CASE WHEN starts_with(coalesce(relation, ''), 'is_') THEN 'fact' ELSE 'relationship' END, rel_key, {_STATEMENT} FROM {RELATIONS}
 UNION ALL SELECT 4, 'event', event_key, {_EVENT} FROM {once_sql('event_extractions', 'event_key')})"""


@query(f"WITH {ITEMS} SELECT row_number() OVER (ORDER BY type_rank, ord) - 1 AS world_item_id, type, ord, md5(text) AS text_md5 FROM items")
def world_items(spark: SparkSession, d: str) -> DataFrame:
    i = index.items(world_parts(spark, d)).select("type_rank", "type", "ord", F.md5("text").alias("text_md5"))
    return index.dense_ids(i, ["type_rank", "ord"]).select("world_item_id", "type", "ord", "text_md5")


@query(f"SELECT *, row_number() OVER (ORDER BY lower(name), ord) - 1 AS place FROM (SELECT name, min(char_key) AS ord FROM {once_sql('character_extractions', 'char_key')} WHERE {norm_sql('name')} <> '' GROUP BY 1)")
def character_list(spark: SparkSession, d: str) -> DataFrame:
    c = merge.once(table(spark, d, "character_extractions"), "char_key").filter(t.norm_ws(F.col("name")) != "")
    n = c.groupBy("name").agg(F.min("char_key").alias("ord")).withColumn("_low", F.lower("name"))
    return numbered(n, ["_low", "ord"], "place").drop("_low")


# --- contexts ---------------------------------------------------------------------------------------------------
@query(f"""SELECT e.event_key, string_agg(chr(10) || '[STORY EVIDENCE ' || rank::VARCHAR || ']' || chr(10) || chr(10) || 'Chapter:' || chr(10) || coalesce(chapter, 'Unknown') || chr(10) || chr(10) || 'Pages:' || chr(10) || page_start::VARCHAR || ' - ' || coalesce(page_end, page_start)::VARCHAR || chr(10) || chr(10) || 'Chunk ID:' || chr(10) || chunk_id::VARCHAR || chr(10) || chr(10) || 'PASSAGE:' || chr(10) || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY rank).md5() AS context
 FROM (SELECT x.event_key, c.*, row_number() OVER (PARTITION BY x.event_key ORDER BY c.chunk_id) AS rank FROM (SELECT DISTINCT event_key, book_id, unnest(source_chunk_ids) AS chunk_id FROM event_extractions) x JOIN {once_sql('chunks', 'chunk_key')} c ON c.book_id = x.book_id AND c.chunk_id = x.chunk_id) e WHERE rank <= 5 GROUP BY 1""")
def story_contexts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "event_extractions").select("event_key", "book_id", F.explode("source_chunk_ids").alias("chunk_id")).distinct()
    j = e.join(chunks_once(spark, d), ["book_id", "chunk_id"]).withColumn("rank", F.row_number().over(Window.partitionBy("event_key").orderBy("chunk_id"))).filter("rank <= 5")
    s = j.withColumn("section", prompts.story_section(F.col("rank"), F.col("chapter"), F.col("page_start"), F.col("page_end"), F.col("chunk_id"), F.col("text")))
    return prompts.joined(s, "event_key", "rank", "section").withColumn("context", F.md5("context"))


@query(f"""SELECT chunk_key, md5('{prompts.EXTRACT['story']}' || chr(10) || chr(10) || 'Chunk ' || chunk_id::VARCHAR || ', chapter ' || coalesce(chapter, 'Unknown') || chr(10) || chr(10) || coalesce(text, '')) AS prompt FROM {once_sql('chunks', 'chunk_key')}""")
def extraction_prompts(spark: SparkSession, d: str) -> DataFrame:
    return chunks_once(spark, d).select("chunk_key", F.md5(prompts.extraction_prompt("story", F.col("chunk_id"), F.col("chapter"), t.text_or_empty(F.col("text")))).alias("prompt"))


# --- evaluation -------------------------------------------------------------------------------------------------
_RESULTS = once_sql("evaluation_results", "result_key")
_GROUPS = f"list_transform(list_filter(list_distinct({words_sql('lower(question)')}), lambda w: length(w) >= 7), lambda w: [w, left(w, 5)])"
_COVER = f"CASE WHEN len(grp) > 0 THEN len(list_filter(grp, lambda g: len(list_filter(g, lambda a: contains(ans, {norm_sql('a')}))) > 0))::DOUBLE / len(grp) ELSE 1.0 END"


SCORED = rf"""arms AS (SELECT result_key, 'story_only' AS arm, coalesce(unanswerable, false) AS un, {_GROUPS} AS grp, story_only.answer AS answer FROM {_RESULTS} UNION ALL SELECT result_key, 'hybrid', coalesce(unanswerable, false), {_GROUPS}, hybrid.answer FROM {_RESULTS}),
 r AS (SELECT result_key, arm, un, grp, {norm_sql('answer')} AS ans, coalesce(answer, '') AS raw FROM arms),
 s AS (SELECT result_key, arm, un, {_COVER} AS cover, regexp_matches(raw, '(?i)\[Pages?\s+[0-9]+') AS cites, contains(ans, {norm_sql(f"'{t.UNKNOWN_RESPONSE}'")}) AS refused FROM r),
 scored AS (SELECT result_key, arm, CASE WHEN un THEN CASE WHEN refused THEN 1.0 ELSE 0.0 END ELSE round(cover, 4) END::DOUBLE AS concept_coverage, NOT un AND cites AS citation, un AND refused AS correct_refusal,
  CASE WHEN un THEN CASE WHEN refused THEN 1.0 ELSE 0.0 END ELSE round(0.8 * cover + CASE WHEN cites THEN 0.2 ELSE 0.0 END, 4) END::DOUBLE AS quality_score FROM s)"""


def concept_groups(question: str = "question"):
    """What an answer should mention: each long word of the question, or its beginning. The tables have no groups of their own."""
    return F.transform(F.filter(F.array_distinct(t.words(F.lower(question))), lambda w: F.length(w) >= 7), lambda w: F.array(w, F.left(w, F.lit(5))))


@query(f"WITH {SCORED} SELECT * FROM scored")
def scored_answers(spark: SparkSession, d: str) -> DataFrame:
    """The scores of the stored answers of both arms."""
    r = merge.once(table(spark, d, "evaluation_results"), "result_key")
    score = lambda a: F.struct(F.lit(a).alias("arm"), evaluate.score_answer(F.col(f"{a}.answer"), concept_groups(), F.coalesce("unanswerable", F.lit(False))).alias("s"))
    return r.select("result_key", F.explode(F.array(score("story_only"), score("hybrid"))).alias("x")).select("result_key", "x.arm", "x.s.*")


@query(f"""WITH {SCORED}, q AS (SELECT a.result_key, a.quality_score AS sq, b.quality_score AS hq FROM scored a JOIN scored b USING (result_key) WHERE a.arm = 'story_only' AND b.arm = 'hybrid')
 SELECT count(*) AS questions, round(avg(sq), 4) AS story_only_average_score, round(avg(hq), 4) AS hybrid_average_score, round(avg(retrieval.story_only_coverage), 4) AS story_only_average_coverage, round(avg(retrieval.hybrid_coverage), 4) AS hybrid_average_coverage, count(*) FILTER (hq > sq) AS hybrid_wins, count(*) FILTER (sq > hq) AS story_only_wins, count(*) FILTER (hq = sq) AS ties
 FROM q JOIN {_RESULTS} USING (result_key)""")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of the computed scores of the stored answers, with the stored coverages of their retrieval."""
    r = merge.once(table(spark, d, "evaluation_results"), "result_key")
    q = lambda a: evaluate.score_answer(F.col(f"{a}.answer"), concept_groups(), F.coalesce("unanswerable", F.lit(False)))["quality_score"]
    x = r.select(q("story_only").alias("story_q"), q("hybrid").alias("hybrid_q"), F.col("retrieval.story_only_coverage").alias("story_c"), F.col("retrieval.hybrid_coverage").alias("hybrid_c"))
    return evaluate.summary(x.withColumn("winner", evaluate.winner(F.col("story_q"), F.col("hybrid_q"))))


# --- graph ------------------------------------------------------------------------------------------------------
_KEYS = ", ".join(f"lower(trim(coalesce({c}, ''))) AS k_{c}" for c in ("subject", "relation", "object"))
EDGES = f"""ek AS (SELECT *, {_KEYS} FROM {RELATIONS}), edges AS (SELECT book_id, min(rel_key) AS rel_key, arg_min(subject, rel_key) AS subject, min({{'o': rel_key, 'v': relation}}).v AS relation, arg_min(object, rel_key) AS object FROM ek WHERE k_subject <> '' AND k_object <> '' GROUP BY book_id, k_subject, k_relation, k_object),
 nodes AS (SELECT DISTINCT book_id, name FROM character_extractions WHERE name IS NOT NULL), ce AS (SELECT e.* FROM edges e WHERE subject <> object AND EXISTS (SELECT 1 FROM nodes n WHERE n.book_id = e.book_id AND n.name = e.subject) AND EXISTS (SELECT 1 FROM nodes n WHERE n.book_id = e.book_id AND n.name = e.object)),
 ends AS (SELECT book_id, subject AS name, rel_key * 2 AS seen_at FROM ce UNION ALL SELECT book_id, object, rel_key * 2 + 1 FROM ce), deg AS (SELECT book_id, name, count(*) AS degree, min(seen_at) AS seen_at FROM ends GROUP BY 1, 2),
 top AS (SELECT * EXCLUDE (seen_at) FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY degree DESC, seen_at)::INT AS rank FROM deg) WHERE rank <= 10)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = graph.distinct_edges(relations(spark, d), "book_id", "rel_key")
    c = graph.between(e, table(spark, d, "character_extractions").filter("name IS NOT NULL"), "book_id")
    return c, graph.top_nodes(c, "book_id", "rel_key")


@query(f"WITH {EDGES} SELECT book_id, rel_key, subject, relation, object FROM edges")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_edges(relations(spark, d), "book_id", "rel_key")


@query(f"WITH {EDGES} SELECT book_id, name, degree, rank FROM top")
def degree_top10(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


@query(f"WITH {EDGES} SELECT book_id, name, degree, rank, round(450 + 220 * cos(2 * pi() / count(*) OVER (PARTITION BY book_id) * (rank - 1) - pi() / 2), 4) AS x, round(300 + 220 * sin(2 * pi() / count(*) OVER (PARTITION BY book_id) * (rank - 1) - pi() / 2), 4) AS y FROM top")
def graph_layout(spark: SparkSession, d: str) -> DataFrame:
    return graph.layout(_graph(spark, d)[1], "book_id")


@query(f"WITH {EDGES} SELECT c.book_id, c.rel_key, c.subject, c.object FROM ce c JOIN top a ON a.book_id = c.book_id AND a.name = c.subject JOIN top b ON b.book_id = c.book_id AND b.name = c.object")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    c, top = _graph(spark, d)
    return graph.between(c, top, "book_id").select("book_id", "rel_key", "subject", "object")


@query(f"""WITH {EDGES}, s AS (SELECT book_id, name AS sel FROM top WHERE rank = 1) SELECT book_id, sel AS name, rel_key, relation, CASE WHEN subject = sel THEN object ELSE subject END AS other FROM
 (SELECT c.*, s.sel, row_number() OVER (PARTITION BY c.book_id ORDER BY c.rel_key) AS n FROM ce c JOIN s ON s.book_id = c.book_id AND (c.subject = s.sel OR c.object = s.sel)) WHERE n <= 10""")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    c, top = _graph(spark, d)
    return graph.neighbours(c, top.filter("rank = 1"), "book_id", "rel_key")
