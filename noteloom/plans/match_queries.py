"""Queries of matching and evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching as M
from ..operators import planning as Q
from ..operators import structure as B
from ..sources import tables as t
from ..sources.sinks import scratch, written
from . import sql as S
from .registry import query

K = t.with_views("chunks")


def first_sentence(text):
    return F.split_part(t.first_line(text), F.lit("."), F.lit(1))


def passage_plans(spark, d):
    """A topic for each document, its first sentence (where a text has none of up to 200 characters, its first words), and for each benchmark passage in each project."""
    given = t.numbered(spark, d, first_sentence(F.col("text"))).select("project", "idx", F.col("text").alias("sentence"))
    lines = t.topics(spark, d).join(given, ["project", "idx"]).select("project", "idx", F.when(F.length(F.btrim("sentence")).between(1, 200), F.col("sentence")).otherwise(F.col("title")).alias("title"))
    bench = t.table(spark, d, "benchmark").select(F.lit("*").alias("project"), F.col("item_id").cast("long").alias("idx"), F.col("text").alias("title"))
    none = F.lit(None).cast("string")
    path = f"{scratch(spark)}/plans-{uuid.uuid4().hex}"
    made = Q.plan_queries(lines.unionByName(bench).select("project", "idx", none.alias("chapter"), "title", none.alias("parent_title")))
    made.withColumn("prepared", M.prepared(F.col("queries"))).write.parquet(path)
    plans = spark.read.parquet(path)
    # a stated set of passages against all projects: planned and prepared once, a row for each project and passage
    projects = t.numbered(spark, d).groupBy("project").agg(F.count("*").alias("n"))
    every = plans.where("project = '*'").drop("project").crossJoin(projects).withColumn("idx", F.col("idx") + F.col("n")).select(*plans.columns)
    return plans.where("project != '*'").unionByName(every)


def found(spark, d):
    return M.match_topics(passage_plans(spark, d), t.chunks(spark, d))


@query()
def c06_p05_match_topics(spark, d):
    return found(spark, d).drop("matched_queries")


#: Candidates that SQL can make too: chunks of a project that hold one of two words, scored by place.
CAND = """cand AS (SELECT project, position // 5 AS idx, (position % 3)::INT AS q_no, 'query ' || (position % 3) AS query, chunk_id, round(((position * 7919) % 1000) / 1000.0, 4) AS score, CASE WHEN position % 4 = 3 THEN 2 ELSE 1 END AS stage, page_start, page_end FROM chunks
 UNION ALL SELECT project, position // 5 AS idx, ((position + 1) % 3)::INT AS q_no, 'query ' || ((position + 1) % 3) AS query, chunk_id, round(((position * 104729) % 1000) / 1000.0, 4) AS score, 1 AS stage, page_start, page_end FROM chunks)"""


def candidates(spark, d):
    c = t.chunks(spark, d)

    def part(shift: int, prime: int, stage):
        no = (F.col("position") + shift) % 3
        return c.select("project", F.floor(F.col("position") / 5).alias("idx"), no.cast("int").alias("q_no"), F.concat(F.lit("query "), no.cast("string")).alias("query"), "chunk_id", F.round(((F.col("position") * prime) % 1000) / 1000.0, 4).alias("score"), stage.alias("stage"), "page_start", "page_end")

    return part(0, 7919, F.when(F.col("position") % 4 == 3, 2).otherwise(1)).unionByName(part(1, 104729, F.lit(1)))


TOP = """topc AS (SELECT * FROM (SELECT *, count(*) FILTER (stage = 1) OVER (PARTITION BY project, idx, q_no) AS prim FROM cand) WHERE stage = 1 OR prim < 3 QUALIFY row_number() OVER (PARTITION BY project, idx, q_no ORDER BY score DESC, page_start, chunk_id) <= 3)"""


@query(f"{K}, {CAND}, {TOP} SELECT project, idx, q_no, chunk_id, score, stage, row_number() OVER (PARTITION BY project, idx, q_no ORDER BY score DESC, page_start, chunk_id) AS rank FROM topc")
def f01_g01_top_candidates(spark, d):
    return M.top_candidates(candidates(spark, d), 3).select("project", "idx", "q_no", "chunk_id", "score", "stage", F.col("rank").cast("long").alias("rank"))


FUSED = "fused AS (SELECT project, idx, chunk_id, max(score) AS score, min(stage) AS stage, min(page_start) AS page_start, min(page_end) AS page_end, list(DISTINCT query ORDER BY query) AS qs FROM cand GROUP BY 1, 2, 3)"


@query(f"{K}, {CAND}, {FUSED} SELECT project, idx, chunk_id, score, stage, qs AS queries FROM fused")
def d11_fuse(spark, d):
    return M.fuse(candidates(spark, d)).select("project", "idx", "chunk_id", "score", "stage", F.col("matched_queries").alias("queries"))


@query(f"{K}, {CAND}, s AS (SELECT project, idx, query, max(score) AS best FROM cand GROUP BY 1, 2, 3) SELECT project, idx, max(best) AS top_score, min(best) AS least_score, CASE WHEN max(best) < 0.28 THEN 'below_threshold' ELSE 'insufficient_lexical_evidence' END AS reason FROM s GROUP BY 1, 2")
def d10_top_score(spark, d):
    values = F.map_values("scores")
    top = F.array_max(values)
    return M.top_scores(candidates(spark, d)).select("project", "idx", top.alias("top_score"), F.array_min(values).alias("least_score"), F.when(top < 0.28, "below_threshold").otherwise("insufficient_lexical_evidence").alias("reason"))


ADJ = f"""place AS (SELECT chunk_id, doc, position, {S.qkey('chapter_title')} AS ck FROM chunks), own AS (SELECT DISTINCT project, idx, chunk_id FROM cand WHERE stage = 2),
e AS (SELECT o.project, o.idx, p.doc, p.ck, o.chunk_id AS of_id, p.position + s.s AS position FROM own o JOIN place p USING (chunk_id), (VALUES (-1), (1)) s(s))"""


@query(f"{K}, {CAND}, {ADJ} SELECT e.project, e.idx, of_id AS \"of\", p.chunk_id FROM e JOIN place p ON e.doc = p.doc AND e.position = p.position AND e.ck = p.ck AND e.ck <> '' WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.project = e.project AND o.idx = e.idx AND o.chunk_id = p.chunk_id)")
def c07_adjacent_evidence(spark, d):
    own = candidates(spark, d).where("stage = 2").select("project", "idx", "chunk_id").distinct()
    return M.adjacent_chunks(own, t.chunks(spark, d))


def topic_plans(spark, d):
    """A plan of every topic, with its own children and related topics; written, as most queries read it several times."""
    return written(Q.plan_queries(t.topics(spark, d)), "plans")


def fused_ranked(spark, d):
    rank = F.row_number().over(Window.partitionBy("project", "idx").orderBy(F.desc("score"), "page_start", "chunk_id"))
    return M.fuse(candidates(spark, d)).withColumn("rank", rank.cast("int"))


@query()
def c08_resolve_dependent(spark, d):
    plans = topic_plans(spark, d)
    return M.resolve_dependent(plans, M.match_topics(plans, t.chunks(spark, d))).drop("matched_queries")


@query()
def c08_dependent_matches(spark, d):
    """Every topic with whether it has candidates after taking those of others, and if not, why."""
    plans = topic_plans(spark, d)
    found_ = written(M.match_topics(plans, t.chunks(spark, d)), "matched")
    return M.dependent_matches(plans, found_, M.resolve_dependent(plans, found_))


@query()
def f02_cover_subqueries(spark, d):
    """Greedy cover over the fused candidates of passages."""
    return found(spark, d).select("project", "idx", "rank", "chunk_id", F.size("matched_queries").alias("n_queries"))


@query()
def f03_f07_select_evidence(spark, d):
    plans, chunks = topic_plans(spark, d), written(t.chunks(spark, d), "chunks")
    return M.select_evidence(plans, M.match_topics(plans, chunks), chunks).select("project", "idx", "rank", "chunk_id", "score")


@query(f"""{t.with_views('chunks', 'topics')}, {CAND}, {FUSED}, m AS (SELECT project, idx, count(*) AS n, min(stage) AS stage FROM fused WHERE stage = 1 GROUP BY 1, 2)
SELECT project, idx, n IS NOT NULL AS matched, CASE stage WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' END AS recall_stage, CASE WHEN n IS NULL THEN 'below_threshold' END AS reason FROM topics LEFT JOIN m USING (project, idx)""")
def c06_item_matches(spark, d):
    plans = t.topics(spark, d).select("project", "idx", F.lit("KNOWLEDGE").alias("item_type"), F.array("title").alias("queries"))
    return M.item_matches(plans, M.fuse(candidates(spark, d)).where("stage = 1"))


@query()
def j08_failure_diagnostic(spark, d):
    """Of every topic without candidates, with the best score of each of its queries over all chunks."""
    plans, chunks = topic_plans(spark, d), written(t.chunks(spark, d), "chunks")
    found_ = written(M.match_topics(plans, chunks).select("project", "idx", "stage", "score"), "matched")
    missed = plans.join(found_.select("project", "idx").distinct(), ["project", "idx"], "left_anti")
    scores = written(M.top_scores(M.query_scores(M.retrieval_queries(missed), chunks)), "scores")
    return M.failure_diagnostics(missed, M.item_matches(missed, found_, scores), scores)


def evidence(spark, d):
    ranked = fused_ranked(spark, d).where("rank <= 4")
    return ranked.join(t.chunks(spark, d).select("chunk_id", F.col("content").alias("text")), "chunk_id").select("project", "idx", "rank", "chunk_id", "score", "text")


RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY project, idx ORDER BY score DESC, page_start, chunk_id) AS rank FROM fused), ev AS (SELECT r.project, r.idx, rank, r.chunk_id, content AS text FROM ranked r JOIN chunks USING (chunk_id) WHERE rank <= 4)"


@query(f"{K}, {CAND}, {FUSED}, {RANKED} SELECT project, idx, count(DISTINCT {S.blank_free('text')}) AS n FROM ev GROUP BY 1, 2")
def j09_request_context(spark, d):
    return M.request_context(evidence(spark, d)).select("project", "idx", "n")


@query(f"{K}, {CAND}, {FUSED}, {RANKED} SELECT project, idx, chunk_id, md5(left({S.blank_free('text')}, 800)) AS original, md5(left({S.blank_free('text')}, 400)) AS recitation, array_to_string((string_split({S.blank_free('text')}, ' '))[1:8], '、') AS keywords FROM ev WHERE rank = 1")
def j10_extractive_item(spark, d):
    return M.extractive_item(evidence(spark, d)).select("project", "idx", "chunk_id", F.md5("original").alias("original"), F.md5("recitation").alias("recitation"), "keywords")


def cited(spark, d):
    """Two bullets of each topic, by odd and even pages: each cites its candidates and a chunk and pages beside them."""
    c = M.fuse(candidates(spark, d))
    ids, pages = F.array_sort(F.collect_set("chunk_id")), F.array_sort(F.collect_set("page_start"))
    extra = F.when(F.col("idx") % 3 == 0, F.array(F.lit("none"))).otherwise(Q.strings())
    return c.groupBy("project", "idx", (F.col("page_start") % 2 + 1).alias("bullet")).agg(ids.alias("ids"), pages.alias("ps")).select("project", "idx", "bullet", F.concat("ids", extra).alias("chunk_ids"), F.concat("ps", F.array(F.element_at("ps", -1) + 1, F.lit(900000).cast("long"))).alias("pages"))


CITED = "cited AS (SELECT project, idx, page_start % 2 + 1 AS bullet, list_concat(list(DISTINCT chunk_id ORDER BY chunk_id), CASE WHEN idx % 3 = 0 THEN ['none'] ELSE [] END) AS ids, list_concat(list(DISTINCT page_start ORDER BY page_start), [max(page_start) + 1, 900000]) AS ps FROM fused GROUP BY 1, 2, 3)"


@query(f"""{K}, {CAND}, {FUSED}, {CITED}, bc AS (SELECT project, idx, bullet, count(*) AS n FROM (SELECT project, idx, bullet, unnest(ids) AS chunk_id FROM cited) ANTI JOIN fused USING (project, idx, chunk_id) GROUP BY 1, 2, 3),
bp AS (SELECT project, idx, bullet, count(*) AS n FROM (SELECT project, idx, bullet, unnest(ps) AS page FROM cited) c WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.project = c.project AND f.idx = c.idx AND c.page BETWEEN f.page_start AND f.page_end) GROUP BY 1, 2, 3)
SELECT c.project, c.idx, c.bullet, coalesce(bc.n, 0) AS bad_chunks, coalesce(bp.n, 0) AS bad_pages FROM cited c LEFT JOIN bc USING (project, idx, bullet) LEFT JOIN bp USING (project, idx, bullet)""")
def c15_citation_check(spark, d):
    return M.citation_check(cited(spark, d), M.fuse(candidates(spark, d)))


@query(f"""{K}, {CAND}, {FUSED}, {CITED} SELECT c.project, c.idx, c.bullet, f.chunk_id, coalesce(list_min(list_filter(ps, lambda x: x BETWEEN page_start AND page_end)), page_start) AS page_from, coalesce(list_max(list_filter(ps, lambda x: x BETWEEN page_start AND page_end)), page_end) AS page_to
FROM (SELECT *, unnest(ids) AS chunk_id FROM cited) c JOIN fused f USING (project, idx, chunk_id)""")
def c17_source_links(spark, d):
    return M.source_links(cited(spark, d), M.fuse(candidates(spark, d)))


@query(f"""{K}, {CAND}, {FUSED}, {CITED}, v AS (SELECT c.project, c.idx, f.chunk_id, count(*) AS cites FROM (SELECT *, unnest(ids) AS chunk_id FROM cited) c JOIN fused f USING (project, idx, chunk_id) GROUP BY 1, 2, 3),
w AS (SELECT v.project, v.idx, chapter_title AS chapter, sum(cites) AS votes, max(score) AS best, min(f.page_start) AS page FROM v JOIN fused f USING (project, idx, chunk_id) JOIN chunks k USING (chunk_id) WHERE chapter_title IS NOT NULL GROUP BY 1, 2, 3)
SELECT project, idx, chapter FROM w QUALIFY row_number() OVER (PARTITION BY project, idx ORDER BY votes DESC, best DESC, page, chapter) = 1""")
def d13_vote_chapter(spark, d):
    chapters = t.chunks(spark, d).where("chapter_title is not null").select("chunk_id", F.col("chapter_title").alias("chapter"))
    return M.vote_chapter(cited(spark, d), M.fuse(candidates(spark, d)), chapters)


@query(f"{K}, {CAND}, {FUSED}, {CITED} SELECT a.project, a.idx, CASE WHEN least(len(a.ids), len(b.ids)) > 0 THEN round(len(list_intersect(a.ids, b.ids)) / least(len(a.ids), len(b.ids)), 6) ELSE 0 END AS overlap, list_sort(list_distinct(list_concat(a.ps, b.ps))) AS pages FROM cited a JOIN cited b ON a.project = b.project AND a.idx = b.idx AND a.bullet = 1 AND b.bullet = 2")
def d15_g04_g06_source_sets(spark, d):
    from ..operators.material import source_overlap

    c = cited(spark, d)
    b = c.where("bullet = 2").select("project", "idx", F.col("chunk_ids").alias("ids2"), F.col("pages").alias("pages2"))
    j = c.where("bullet = 1").join(b, ["project", "idx"])
    return j.select("project", "idx", F.round(source_overlap(F.col("chunk_ids"), F.col("ids2")), 6).alias("overlap"), F.array_sort(F.array_distinct(F.concat("pages", "pages2"))).alias("pages"))


@query()
def h11_sequence_ratio(spark, d):
    tp = t.topics(spark, d).where("parent_title is not null")
    return tp.select("project", "idx", F.round(M.sequence_ratio(T.query_key(F.col("title")), T.query_key(F.col("parent_title"))), 6).alias("ratio"))


@query()
def h12_h13_score(spark, d):
    """Scores of every topic's candidates, and the diversity of each beside those ranked before it."""
    plans, chunks = topic_plans(spark, d), written(t.chunks(spark, d).select("*", *M.traits(F.col("content"))), "chunks")
    # what the texts are worth goes along with candidates, not the texts
    j = M.match_topics(plans, chunks).join(chunks.select("chunk_id", "long", "detailed"), "chunk_id")
    before = Window.partitionBy("project", "idx").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    chosen = F.collect_list(F.struct("page_start", "page_end")).over(before)
    worth = M.worth(F.col("score"), F.col("long"), F.col("detailed"))
    return j.withColumn("chosen", chosen).select("project", "idx", "rank", "chunk_id", "score", F.round(M.diversity(worth, F.col("page_start"), F.col("page_end"), F.col("chosen")), 6).alias("diversity"))


@query()
def p06_rematch_with_rewrites(spark, d):
    """Topics without candidates are matched again by the first sentence of the document in their place."""
    plans, chunks = topic_plans(spark, d), t.chunks(spark, d)
    rewrites = plans.select("project", "idx", "title").join(t.numbered(spark, d).select("project", "idx", first_sentence(F.col("text")).alias("sentence")), ["project", "idx"])
    rewrites = rewrites.select(T.query_key(F.col("title")).alias("topic_key"), F.array("sentence").alias("queries"))
    return M.rematch_with_rewrites(plans, M.match_topics(plans, chunks), rewrites, chunks).select("project", "idx", "rank", "chunk_id", "score")


@query()
def s08_batch_form(spark, d):
    """Candidates of passages with the reliable chapter of each chunk: the batch form of matching a stream of chunks."""
    chapters = B.reliable_chapters(t.chunks(spark, d))
    c = t.chunks(spark, d).select("chunk_id", "doc", "position").join(chapters, ["doc", "position"], "left")
    return found(spark, d).join(c, "chunk_id", "left").select("project", "idx", "rank", "chunk_id", "score", "chapter")
