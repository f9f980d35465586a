"""Queries of structure, outlines and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..config import Config
from ..functions import predicates as P
from ..functions import text as T
from ..operators import material as M
from ..operators import outline as O
from ..operators import planning as Q
from ..operators import structure as B
from ..sources import tables as t
from . import sql as S
from .registry import query

#: The documents have no numbered headings: a short line is a chapter and one of few words a section.
SHORT = Config(chapter_line="^.{1,24}\\.$", section_line="^.{25,48}\\.$", target_size=600, maximum_size=900)
T_, N, K = t.with_views("topics"), t.with_views("numbered"), t.with_views("chunks")


def doc_pages(spark, d):
    return t.numbered(spark, d).select(F.col("project").alias("doc_id"), (F.col("idx") + 1).alias("page_number"), "text")


PL = """p AS (SELECT project AS doc_id, idx + 1 AS page_number, string_split(text, chr(10)) AS ls FROM numbered),
l AS (SELECT doc_id, page_number, i - 1 AS line_no, trim(ls[i], ' ' || chr(9) || chr(12) || chr(11) || '　') AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM p)),
k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^.{1,24}\\.$') THEN 'chapter' WHEN regexp_matches(line, '^.{25,48}\\.$') THEN 'section' ELSE 'content' END AS kind FROM l),
f AS (SELECT *, (kind <> 'content' OR coalesce(lag(kind) OVER w <> 'content', true) OR lag(page_number) OVER w <> page_number)::INT AS fresh FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, line_no)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page_number, line_no) AS run FROM f),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS block_no, kind, page_number, raw_text FROM (SELECT doc_id, run, any_value(kind) AS kind, min(page_number) AS page_number, string_agg(line, chr(10) ORDER BY line_no) AS raw_text FROM r WHERE kind <> 'blank' GROUP BY doc_id, run))"""


@query(f"{N}, {PL} SELECT doc_id, block_no, kind, page_number, md5(raw_text) AS digest FROM blocks")
def e06_p01_build_blocks(spark, d):
    return B.build_blocks(doc_pages(spark, d), config=SHORT).select("doc_id", "block_no", "kind", "page_number", F.md5("raw_text").alias("digest"))


@query(f"""{N}, {PL}, c AS (SELECT *, sum((kind = 'chapter')::INT) OVER o AS chapter_no, sum((kind <> 'content')::INT) OVER o AS run, last_value(CASE WHEN kind = 'chapter' THEN raw_text END IGNORE NULLS) OVER o AS chapter_title FROM blocks WINDOW o AS (PARTITION BY doc_id ORDER BY block_no))
SELECT doc_id, block_no, run::BIGINT AS run, chapter_title, last_value(CASE WHEN kind = 'section' THEN raw_text END IGNORE NULLS) OVER (PARTITION BY doc_id, chapter_no ORDER BY block_no) AS section_title FROM c""")
def e01_fill_headings(spark, d):
    return B.fill_headings(B.build_blocks(doc_pages(spark, d), config=SHORT)).select("doc_id", "block_no", F.col("run").cast("long").alias("run"), "chapter_title", "section_title")


@query()
def p02_split_chunks(spark, d):
    return B.split_chunks(B.build_blocks(doc_pages(spark, d), config=SHORT), SHORT)


def outline_entries(spark, d):
    first = F.split_part("text", F.lit("."), F.lit(1))
    return t.numbered(spark, d).select(F.col("project").alias("doc_id"), (F.col("idx") % 3).alias("level"), first.alias("title"), (F.floor(F.col("idx") / 2) + 1).cast("long").alias("page_number"), F.col("idx").alias("ord"))


@query(f"""{N}, o AS (SELECT project AS doc_id, idx % 3 AS level, split_part(text, '.', 1) AS title, idx // 2 + 1 AS page_number, idx AS ord FROM numbered)
SELECT doc_id, page_number, max_by(title, ord) AS outline_title FROM (SELECT *, min(level) OVER (PARTITION BY doc_id) AS least FROM o) WHERE level = least GROUP BY 1, 2""")
def c10_outline_join(spark, d):
    return B.outline_titles(outline_entries(spark, d))


@query()
def p01_blocks_with_outline(spark, d):
    return B.build_blocks(doc_pages(spark, d), outline_entries(spark, d), SHORT)


@query(f"{t.with_views('lines')}, k AS (SELECT doc_id, line_no, trim(line) AS line FROM lines WHERE trim(line) <> ''), b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM k) SELECT doc_id, line_no, line FROM b WHERE before IS NULL OR before <> line")
def e08_collapse_repeats(spark, d):
    return B.collapse_repeats(t.lines(spark, d)).select("doc_id", "line_no", "line")


_CH = "coalesce(chapter_title, '')"
_TITLE = S.blank_free(_CH)
_F3 = f"({S.lines('content')})[1:3]"
_CONF = f"page_end - page_start <= 2 AND len(list_filter({_F3}, lambda a_: {S.tkey('a_')} = {S.tkey('title')})) > 0 AND {S.readable('coalesce(array_to_string(list_concat(list_filter(' + _F3 + ', lambda a_: ' + S.tkey('a_') + ' <> ' + S.tkey('title') + '), (' + S.lines('content') + ')[4:]), chr(32)), ' + chr(39) * 2 + ')')} >= 20"
CAND = f"""c0 AS (SELECT *, {_TITLE} AS title FROM chunks), cand AS (SELECT doc, position, page_start, title, {S.tkey('title')} AS key, regexp_extract(title, '^第\\s*(\\d+)\\s*章', 1)::INT AS number FROM c0
 WHERE {S.displayable('title')} AND {_CONF} AND len(list_distinct(list_transform(list_filter({S.lines('content')}, lambda t_: {S.has('t_', C.TOC_LINE)}), lambda t_: {S.tkey('t_')}))) < 2)"""


@query(f"{K}, {CAND} SELECT doc, position, title, number FROM cand")
def p08_chapter_candidates(spark, d):
    return B.chapter_candidates(t.chunks(spark, d)).select("doc", "position", "title", "number")


@query()
def e05_boundary_runs(spark, d):
    return B.boundary_runs(B.chapter_candidates(t.chunks(spark, d)))


@query(f"{K}, {CAND} SELECT c.doc, c.position, b.title AS chapter FROM chunks c ASOF JOIN cand b ON c.doc = b.doc AND c.position >= b.position")
def c09_asof_chapter(spark, d):
    return B.asof_chapter(t.chunks(spark, d), B.chapter_candidates(t.chunks(spark, d)))


@query()
def p08_reliable_chapters(spark, d):
    return B.reliable_chapters(t.chunks(spark, d))


def outlines(spark, d):
    """Each project's outline: its topics as numbered, indented lines under chapter lines."""
    tp = t.topics(spark, d)
    body = F.concat(F.when(F.col("idx") % 10 == 0, F.concat(F.col("chapter"), F.lit("\n"))).otherwise(""), F.when(F.col("idx") % 3 == 1, "    ").otherwise(""), F.when(F.col("idx") % 2 == 0, F.concat((F.col("idx") + 1).cast("string"), F.lit(". "))).otherwise(""), F.col("title"), F.when(F.col("idx") % 6 == 2, "包括").otherwise(""))
    return tp.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", body.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


OL = f"""o AS (SELECT project, string_agg(CASE WHEN idx % 10 = 0 THEN chapter || chr(10) ELSE '' END || CASE WHEN idx % 3 = 1 THEN '    ' ELSE '' END || CASE WHEN idx % 2 = 0 THEN (idx + 1) || '. ' ELSE '' END || title || CASE WHEN idx % 6 = 2 THEN '包括' ELSE '' END, chr(10) ORDER BY idx) AS text FROM topics GROUP BY project),
ol AS (SELECT project, i - 1 AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM o)),
cl AS (SELECT *, {S.clean('line')} AS cleaned FROM ol),
x AS (SELECT project, line_no, cleaned, {S.has('cleaned', C.OUTLINE_CHAPTER)} AS is_chapter, CASE WHEN {S.has('cleaned', C.OUTLINE_NUMBER + '.+$')} THEN {S.clean(S.sub('cleaned', C.OUTLINE_NUMBER))} ELSE cleaned END AS title FROM cl WHERE cleaned <> ''),
tc AS (SELECT *, last_value(CASE WHEN is_chapter THEN cleaned END IGNORE NULLS) OVER (PARTITION BY project ORDER BY line_no) AS chapter FROM x),
fo AS (SELECT * FROM tc WHERE NOT is_chapter AND title <> '' QUALIFY row_number() OVER (PARTITION BY project, {S.casefold(S.sub('title', '[^\\p{L}\\p{N}]+'))} ORDER BY line_no) = 1)"""


@query(f"{T_}, {OL} SELECT project, line_no, chapter, title FROM fo")
def e03_e10_outline_topics(spark, d):
    lines = O.topic_chapter(O.outline_lines(outlines(spark, d))).where("not is_chapter")
    return O.first_occurrence(lines).select("project", "line_no", "chapter", "title")


@query()
def e11_p03_parse_outline(spark, d):
    return O.parse_outline(outlines(spark, d))


@query(f"{T_} SELECT project, {S.qkey('parent_title')} AS parent_key, list(title ORDER BY idx) AS children FROM topics WHERE parent_title IS NOT NULL AND parent_title <> '' GROUP BY 1, 2")
def c02_children(spark, d):
    return Q.children_of(t.topics(spark, d))


@query(f"""{T_}, c AS (SELECT a.project, a.idx, b.title, abs(a.idx - b.idx) AS far, b.idx AS pos FROM topics a JOIN topics b ON a.project = b.project AND a.chapter = b.chapter AND a.idx <> b.idx AND abs(a.idx - b.idx) <= 5 AND regexp_matches(b.title, '{C.RELATED}') AND (NOT contains(a.title, '模型') OR regexp_matches(b.title, '{C.RELATED_MODEL}')) QUALIFY row_number() OVER (PARTITION BY a.project, a.idx ORDER BY abs(a.idx - b.idx), b.idx) <= 4),
g AS (SELECT project, idx, list(title ORDER BY far, pos) AS ts FROM c GROUP BY 1, 2) SELECT t.project, t.idx, CASE WHEN ts IS NULL THEN [] ELSE {S.unique_queries('ts')} END AS related FROM topics t LEFT JOIN g USING (project, idx)""")
def c03_related(spark, d):
    return Q.related_topics(t.topics(spark, d))


def _groups() -> str:
    rows = ", ".join(f"({i}, {j}, {S.lit(a)})" for i, g in enumerate(C.ALIAS_GROUPS) for j, a in enumerate(g))
    return f"names(g, n, alias) AS (VALUES {rows})"


#: Topics as they stand have no vocabulary words, so one is put in front by place.
VOCAB = ["双因素理论", "X理论", "岗位说明书 6w1h", "招募甄选人员配置", "德尔菲与经验判断", "各模块核心考点", "经典核心理论", "plain"]


def worded(spark, d):
    words = F.array(*[F.lit(v) for v in VOCAB])
    return t.topics(spark, d).withColumn("title", F.concat(F.element_at(words, (F.col("idx") % 8 + 1).cast("int")), F.col("title")))


WORDED = "w AS (SELECT project, idx, [" + ", ".join(map(S.lit, VOCAB)) + "][idx % 8 + 1] || title AS title FROM topics)"


@query(f"""{T_}, {WORDED}, {_groups()}, k AS (SELECT *, {S.qkey('title')} AS key FROM w), h AS (SELECT DISTINCT project, idx, g FROM k JOIN names ON key <> '' AND (contains(key, {S.qkey('alias')}) OR contains({S.qkey('alias')}, key))),
q AS (SELECT project, idx, list(alias ORDER BY g, n) AS qs FROM h JOIN names USING (g) GROUP BY 1, 2) SELECT w.project, w.idx, CASE WHEN qs IS NULL THEN [] ELSE {S.unique_queries('qs')} END AS aliases FROM w LEFT JOIN q USING (project, idx)""")
def c04_a06_alias_queries(spark, d):
    return worded(spark, d).select("project", "idx", Q.alias_queries(F.col("title")).alias("aliases"))


_EXPS = "[]"
for _req, _qs in C.EXPANSIONS:
    _hit = " AND ".join(f"contains({S.qkey('title')}, {S.qkey(S.lit(r))})" for r in _req)
    _EXPS = f"list_concat({_EXPS}, CASE WHEN {_hit} THEN [{', '.join(map(S.lit, _qs))}] ELSE [] END)"


@query(f"{T_}, {WORDED}, e AS (SELECT project, idx, {_EXPS} AS xs FROM w) SELECT project, idx, {S.unique_queries('xs')} AS expansions FROM e")
def c05_topic_expansions(spark, d):
    return worded(spark, d).select("project", "idx", Q.topic_expansions(F.col("title")).alias("expansions"))


@query(f"{T_}, {WORDED} SELECT project, idx, CASE WHEN regexp_matches(title, '{C.TASK}') THEN 'TASK' WHEN idx % 3 = 0 OR regexp_matches(title, {S.lit(C.COLLECTION_QUERY)}) THEN 'COLLECTION' WHEN idx % 3 = 1 THEN 'COMPOSITE' ELSE 'KNOWLEDGE' END AS item_type FROM w")
def b11_item_type(spark, d):
    kids = F.when(F.col("idx") % 3 == 0, Q.strings(["a"])).otherwise(Q.strings())
    subs = F.when(F.col("idx") % 3 == 1, Q.strings(["a", "b"])).otherwise(Q.strings())
    return worded(spark, d).select("project", "idx", P.item_type(F.col("title"), kids, subs).alias("item_type"))


@query(f"{T_}, u AS (SELECT project, idx, [title, parent_title, title, upper(title), chapter] AS xs FROM topics) SELECT project, idx, {S.unique_queries('list_filter(xs, lambda n_: n_ IS NOT NULL)')} AS queries FROM u")
def g05_unique_queries(spark, d):
    xs = F.array_compact(F.array("title", "parent_title", "title", F.upper("title"), "chapter"))
    return t.topics(spark, d).select("project", "idx", T.unique_queries(xs).alias("queries"))


@query()
def h06_h07_split_subqueries(spark, d):
    return t.topics(spark, d).select("project", "idx", T.split_subqueries(T.matching_query(F.col("title"))).alias("subqueries"))


@query()
def p04_plan_queries(spark, d):
    return Q.plan_queries(worded(spark, d))


@query(f"{T_}, r AS (SELECT {S.qkey('title')} AS topic_key, [title || '  one', title || ' one', chapter] AS qs FROM topics), r1 AS (SELECT topic_key, min(qs) AS qs FROM r GROUP BY 1), z AS (SELECT topic_key, list_filter(list_transform(qs, lambda b_: {S.blank_free('b_')}), lambda b_: length(b_) <= 80) AS qs FROM r1) SELECT topic_key, len({S.unique('qs', S.ckey)}) AS n FROM z")
def a07_rewrites(spark, d):
    r = t.topics(spark, d).select(T.query_key(F.col("title")).alias("topic_key"), F.array(F.concat("title", F.lit("  one")), F.concat("title", F.lit(" one")), "chapter").alias("queries"))
    return Q.clean_rewrites(r).select("topic_key", F.size("rewrite_queries").cast("long").alias("n"))


@query(f"{N} SELECT project AS doc_id, md5(string_agg('[page ' || (idx + 1) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY idx)) AS digest FROM numbered GROUP BY 1")
def a05_raw_text(spark, d):
    return M.raw_text(doc_pages(spark, d)).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id AS project, md5(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE trim(text) END, ''), 'parsed ' || text)) AS digest FROM documents")
def a04_outline_source(spark, d):
    """Every document as the outline of a project of its own; each third is given blank, so that its parsed text counts."""
    docs = t.documents(spark, d)
    given = docs.select(F.col("doc_id").alias("project"), F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("text")).alias("text"))
    return M.outline_text(given, docs.select(F.col("doc_id").alias("project"), F.concat(F.lit("parsed "), "text").alias("raw_text"))).select("project", F.md5("text").alias("digest"))


@query(f"""{t.with_views('lines')}, k AS (SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN '1. ' WHEN 1 THEN '- ' ELSE '' END || trim(line) AS line FROM (SELECT doc_id, line_no // 2 AS half, line_no, line FROM lines)),
b AS (SELECT doc_id, line_no, CASE WHEN {S.has('line', C.ORDERED_LINE)} THEN 'ordered' WHEN {S.has('line', C.UNORDERED_LINE)} THEN 'unordered' ELSE 'paragraph' END AS kind FROM k WHERE trim(line) <> ''),
n AS (SELECT *, coalesce((lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) <> kind)::INT, 1) AS new FROM b), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM n)
SELECT doc_id, run::BIGINT AS run, any_value(kind) AS kind, count(*) AS n FROM r GROUP BY doc_id, run""")
def b13_classify_blocks(spark, d):
    lead = F.when(F.col("line_no") % 3 == 0, "1. ").when(F.col("line_no") % 3 == 1, "- ").otherwise("")
    return M.content_blocks(t.lines(spark, d).withColumn("line", F.concat(lead, T.unspaced(F.col("line"))))).select("doc_id", F.col("run").cast("long").alias("run"), "kind", F.size("items").cast("long").alias("n"))
