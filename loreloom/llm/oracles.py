"""SQL that the queries of the training-data operators must agree with, where SQL can say it."""

from __future__ import annotations

#: Descriptions that say nothing, stated again so that the SQL does not depend on the operator's list.
PLACEHOLDERS = "na none null nil nan unknown tbd tba tbc todo nodetails nodetail nonegiven notgiven nodescription nodescriptionavailable nodescriptiongiven notdescribed notdescribedinthispassage notdescribedinthetext notavailable notapplicable notmentioned notspecified unspecified mentionedonlybyname onlymentionedbyname mentionedbyname nofurtherdetails noinformation noinformationavailable description placeholder empty missing unclear undetermined seeabove asabove ditto".split()
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_WORDS = r"regexp_extract_all(lower(coalesce({x}, '')), '[\p{L}\p{N}]+')"


def _words(x: str) -> str:
    return _WORDS.replace("{x}", x)


P1 = f"""WITH e AS (SELECT event_key, list_distinct({_words("coalesce(summary, '') || ' ' || coalesce(explanation, '')")}) AS w FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY loaded_at) AS n FROM event_extractions WHERE event_key IS NOT NULL) WHERE n = 1),
 x AS (SELECT event_key, len(w) AS size, unnest(w) AS word FROM e), c AS (SELECT a.event_key AS key_a, b.event_key AS key_b, a.size AS sa, b.size AS sb, count(*) AS shared FROM x a JOIN x b ON a.word = b.word AND a.event_key < b.event_key GROUP BY 1, 2, 3, 4)
 SELECT key_a, key_b FROM c WHERE shared::DOUBLE / (sa + sb - shared) >= 0.6 - 1e-9"""

P1_GROUPS = f"""WITH RECURSIVE e AS (SELECT event_key, list_sort(list_distinct({_words("coalesce(summary, '') || ' ' || coalesce(explanation, '')")})) AS w FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY loaded_at) AS n FROM event_extractions WHERE event_key IS NOT NULL) WHERE n = 1),
 r AS (SELECT w, min(event_key) AS rep, count(*) AS copies FROM e WHERE len(w) > 0 GROUP BY 1), x AS (SELECT rep, len(w) AS size, unnest(w) AS word FROM r),
 l AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.word = b.word AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.size, b.size HAVING count(*)::DOUBLE / (a.size + b.size - count(*)) >= 0.6 - 1e-9),
 reach AS (SELECT rep AS a, rep AS b FROM r UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b), c AS (SELECT a AS rep, min(b) AS group_key FROM reach GROUP BY 1), n AS (SELECT a AS rep, count(*) AS links FROM l GROUP BY 1)
 SELECT e.event_key, coalesce(c.group_key, e.event_key) AS group_key, coalesce(n.links, 0) AS links, coalesce(r.copies, 1) AS copies FROM e LEFT JOIN r ON r.w = e.w LEFT JOIN c ON c.rep = r.rep LEFT JOIN n ON n.rep = r.rep"""

_NAME = f"lower(trim(regexp_replace(coalesce(name, ''), '{WS}+', ' ', 'g')))"
_BARE = r"lower(regexp_replace(d, '[^\p{L}\p{N}]', '', 'g'))"
_USABLE = rf"""({_BARE} <> '' AND {_BARE} NOT IN ({", ".join(f"'{p}'" for p in PLACEHOLDERS)})
 AND (regexp_matches(d, '[.!?。！？।؟]["''”’»)\]}}」』›“*_]*$') OR regexp_matches(d, '[)\]”»」』]$')) AND NOT regexp_matches(d, '(\.\.|…)["''”’»)\]}}*_]*$')
 AND NOT regexp_matches(d, '(?i)(^|[^\p{{L}}])(mr|mrs|ms|dr|prof|capt|st|rev|vs|cf|e\.g|i\.e|approx|no|vol|ch|fig|pp)\.$'))"""


def _p4(kind: str, name: str, key: str) -> str:
    return rf"""SELECT '{kind}' AS kind, min(key) AS first_key, arg_max(key, r) FILTER (ok) AS best_key FROM (SELECT *, {_USABLE} AS ok, {{'words': len(list_filter(string_split_regex(coalesce(d, ''), '{WS}+'), lambda w: w <> '')), 'trust': trust, 't': made_at, 'k': -key}} AS r FROM
 (SELECT DISTINCT {key} AS key, book_id, {_NAME} AS norm, regexp_replace(coalesce(description, ''), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}\x{{200b}}\x{{feff}}]+$', '') AS d, coalesce(x.trust, -2147483648) AS trust, coalesce(epoch_us(extracted_at), -4611686018427387904) AS made_at
  FROM {name} t LEFT JOIN extractors x ON x.extractor = t.extractor WHERE {key} IS NOT NULL AND {_NAME} <> '')) GROUP BY book_id, norm HAVING count(DISTINCT key) > 1 AND bool_or(ok)"""


def _p4_sources(kind: str, name: str, key: str) -> str:
    same = "i.book_id IS NOT DISTINCT FROM g.book_id AND i.norm = g.norm"
    return rf"""SELECT g.kind, g.first_key, g.best_key, coalesce(to_json(i.ids)::VARCHAR, '[]') AS source_chunk_ids FROM ({_p4(kind, name, key).replace("SELECT '", "SELECT book_id, norm, '", 1).replace(" AND bool_or(ok)", "")}) g LEFT JOIN
 (SELECT book_id, norm, list_sort(list(DISTINCT id)) AS ids FROM (SELECT book_id, {_NAME} AS norm, unnest(source_chunk_ids) AS id FROM {name} WHERE {key} IS NOT NULL AND {_NAME} <> '') WHERE id IS NOT NULL GROUP BY 1, 2) i ON {same}"""


P4_SOURCES = " UNION ALL ".join(_p4_sources(*x) for x in (("character", "character_extractions", "char_key"), ("location", "location_extractions", "loc_key")))
P4 = _p4("character", "character_extractions", "char_key") + " UNION ALL " + _p4("location", "location_extractions", "loc_key")

P5 = f"""SELECT DISTINCT chunk_key FROM chunks WHERE len(list_filter(string_split_regex(coalesce(text, ''), '{WS}+'), lambda w: w <> '')) > (SELECT limit_value FROM limits WHERE limit_name = 'chunk_max')"""


P5_INVARIANTS = f"""SELECT chunk_key, len(list_filter(string_split_regex(coalesce(text, ''), '{WS}+'), lambda w: w <> '')) AS words, true AS within FROM (SELECT *, row_number() OVER (PARTITION BY chunk_key ORDER BY loaded_at) AS n FROM chunks WHERE chunk_key IS NOT NULL)
 WHERE n = 1 AND len(list_filter(string_split_regex(coalesce(text, ''), '{WS}+'), lambda w: w <> '')) > (SELECT limit_value FROM limits WHERE limit_name = 'chunk_max')"""

P8_INVARIANTS = """SELECT doc_id, tokens, greatest(1, (tokens + c - 1) // c)::BIGINT AS pieces, true AS within FROM (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS tokens FROM documents), (SELECT limit_value AS c FROM limits WHERE limit_name = 'container_capacity')"""
P8_USAGE = "SELECT sum(strlen(coalesce(text, '')) + 1)::BIGINT AS tokens, true AS tight FROM documents"


def _field(name: str) -> str:
    return rf"lower(regexp_replace(coalesce({name}, list_filter(kv, lambda e: lower(e.key) = '{name}')[1].value, ''), '[^\p{{L}}\p{{N}}]', '', 'g'))"


_KEYED = rf"""k AS (SELECT rel_key, book_id, {_field('subject')} AS s, {_field('relation')} AS r, {_field('object')} AS o FROM
 (SELECT *, CASE WHEN raw_record IS NOT NULL AND json_valid(raw_record) THEN list_transform(json_keys(raw_record), lambda x: {{'key': x, 'value': json_extract_string(raw_record, '$."' || x || '"')}}) ELSE [] END AS kv FROM relationship_extractions WHERE rel_key IS NOT NULL))"""
P7 = f"WITH {_KEYED}, m AS (SELECT DISTINCT * FROM k WHERE s <> '' AND r <> '' AND o <> '') SELECT * FROM (SELECT min(rel_key) OVER (PARTITION BY book_id, s, r, o) AS first_key, rel_key AS copy_key FROM m) WHERE first_key < copy_key"
P7_COLLAPSED = f"""WITH {_KEYED}, m AS (SELECT DISTINCT * FROM k) SELECT min(rel_key) AS first_key, count(*) AS copies FROM m WHERE s <> '' AND r <> '' AND o <> '' GROUP BY book_id, s, r, o
 UNION ALL SELECT rel_key, 1 FROM m WHERE s = '' OR r = '' OR o = ''"""


def _grams(x: str) -> str:
    return f"list_transform(range(1, len({x}) - 10), lambda i: array_to_string({x}[i : i + 11], ' '))"


P9 = f"""WITH i AS (SELECT item_id, {_words('passage')} AS w FROM test_items UNION ALL SELECT item_id, {_words('question')} FROM test_items), ig AS (SELECT DISTINCT item_id, unnest({_grams('w')}) AS g FROM i WHERE len(w) >= 12),
 d AS (SELECT doc_id, {_words('text')} AS w FROM documents), dg AS (SELECT doc_id, unnest({_grams('w')}) AS g FROM d WHERE len(w) >= 12) SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""

SQL = {"p1_found": P1, "p1_groups": P1_GROUPS, "p4_sources": P4_SOURCES, "p5_invariants": P5_INVARIANTS, "p8_invariants": P8_INVARIANTS, "p8_usage": P8_USAGE, "p4_found": P4, "p5_found": P5, "p7_found": P7, "p7_collapsed": P7_COLLAPSED, "p9_found": P9}
