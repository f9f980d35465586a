"""Queries without SQL twin on small tables, against plain Python."""

from __future__ import annotations

import datetime
import json
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from noteloom.functions.keys import key_of
from noteloom.operators import matching as M
from noteloom.operators import material, organize, payloads, reports
from noteloom.operators import structure as B
from noteloom.streaming import flows as W

CHUNK = "project string, doc string, chunk_id string, position long, page_start long, page_end long, chapter_title string, section_title string, content string"
PLAN = "project string, idx long, chapter string, title string, item_type string, queries array<string>, subqueries array<string>, children array<string>, related array<string>"
FOUND = "project string, idx long, rank int, chunk_id string, score double, stage int, page_start long, page_end long, matched_queries array<string>"


def plan(i, title, kind="KNOWLEDGE", queries=None, subs=(), children=(), related=()):
    return ("p", i, None, title, kind, [title] if queries is None else queries, list(subs), list(children), list(related))


def test_dependent_topics_take_candidates(spark):
    plans = [plan(0, "激励"), plan(1, "方法", "COLLECTION", children=["激励", "绩效"]), plan(2, "绩效"), plan(3, "案例分析", "TASK", queries=[], related=["绩效", "激励"]), plan(4, "应用", "TASK", related=["无"]), plan(5, "总论", "COLLECTION", children=["方法"])]
    found = [("p", 0, 1, "a", 0.9, 1, 3, 3, ["激励"]), ("p", 0, 2, "b", 0.5, 2, 1, 1, ["激励"]), ("p", 2, 1, "a", 0.95, 1, 3, 3, ["绩效"]), ("p", 2, 2, "c", 0.4, 2, 7, 8, ["绩效"]), ("p", 1, 1, "d", 0.3, 2, 9, 9, ["方法"])]
    got: dict = {}
    for r in M.resolve_dependent(spark.createDataFrame(plans, PLAN), spark.createDataFrame(found, FOUND)).orderBy("idx", "rank").collect():
        got.setdefault(r.idx, []).append((r.chunk_id, r.score, r.stage))
    merged = [("a", 0.95, 1), ("b", 0.5, 2), ("c", 0.4, 2), ("d", 0.3, 2)]
    assert got[0] == [("a", 0.9, 1), ("b", 0.5, 2)] and got[1] == merged and got[3] == merged[:3] and 4 not in got and got[5] == merged


def test_runs_of_boundaries(spark):
    rows = [("d", 0, 1, "第1章 甲", "甲", 1, 50), ("d", 4, 5, "第2章 乙", "乙", 2, 50), ("d", 8, 9, "第1章 丙", "丙", 1, 50), ("d", 9, 10, "第2章 乙", "乙", 2, 50), ("d", 12, 13, "第3章 丁", "丁", 3, 50), ("e", 0, 1, "绪论", "绪论", None, 10), ("e", 3, 4, "绪论", "绪论", None, 90)]
    c = spark.createDataFrame(rows, "doc string, position long, page_start long, title string, key string, number int, characters int")
    got = {(r.doc, r.position) for r in B.boundary_runs(c).collect()}
    assert got == {("d", 8), ("d", 9), ("d", 12), ("e", 3)}


def test_reliable_chapters(spark):
    body = "绩效管理的内容是组织目标与员工目标的统一，包括计划、实施、考核和反馈四个环节。"
    heads = ["第一章 绪论", "第二章 绩效", "第三章 薪酬"]
    rows = [("p", "d", str(i), i, i + 1, i + 1, heads[i // 3] if i % 3 == 0 else "目录", None, (heads[i // 3] + "\n" if i % 3 == 0 else "") + body) for i in range(9)]
    got = {r.position: r.chapter for r in B.reliable_chapters(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got == {i: heads[i // 3] for i in range(9)}


def test_split_text_table_function(spark):
    f = B.split_text()
    df = spark.createDataFrame([(1, "一二三。四五六。" * 10), (2, ""), (3, None)], "id long, text string")
    spark.udtf.register("split_text", f)
    df.createOrReplaceTempView("texts_to_split")
    got = spark.sql("SELECT id, s.position, s.part FROM texts_to_split, LATERAL split_text(text, 20, 30) s ORDER BY 1, 2").collect()
    assert {r.id for r in got} == {1} and [r.part for r in got] == B.cut_oversized("一二三。四五六。" * 10, 20, 30) and [r.position for r in got] == list(range(len(got)))


def test_rewrites_reach_unmatched_topics(spark):
    chunks = [("p", "d", "a", 0, 1, 1, None, None, "绩效考核的步骤与方法" * 9), ("p", "d", "b", 1, 2, 2, None, None, "薪酬结构的设计原理" * 9)]
    plans = spark.createDataFrame([plan(0, "绩效考核"), plan(1, "zzqq")], PLAN)
    chunks = spark.createDataFrame(chunks, CHUNK)
    first = M.match_topics(plans, chunks)
    rewrites = spark.createDataFrame([("zzqq", ["薪酬结构", "薪酬  结构", "x" * 99]), ("绩效考核", ["薪酬结构"])], "topic_key string, queries array<string>")
    got = {(r.idx, r.chunk_id) for r in M.rematch_with_rewrites(plans, first, rewrites, chunks).collect()}
    assert {r.idx for r in first.collect()} == {0} and got == {(0, "a"), (1, "b")}


def test_diagnostics(spark):
    chunks = spark.createDataFrame([("p", "d", str(i), i, 1, 1, None, None, t) for i, t in enumerate(["abcdefgh" * 20, "薪酬结构" * 30])], CHUNK)
    plans = spark.createDataFrame([plan(0, "abxyqrst"), plan(1, "案例", "TASK", queries=[])], PLAN)
    scores = M.top_scores(M.query_scores(M.retrieval_queries(plans), chunks))
    matches = M.item_matches(plans, spark.createDataFrame([], FOUND), scores)
    got = {r.idx: json.loads(r.diagnostic.removeprefix("unmatched: ")) for r in M.failure_diagnostics(plans, matches, scores).collect()}
    key = "abxyqrst"
    best = max(0.72 * max(SequenceMatcher(None, key, b[:160]).ratio() for b in ("abcdefgh" * 20, "薪酬结构" * 30)), 0.68 * sum(g in "abcdefgh" * 2 for g in {key[i : i + 2] for i in range(7)}) / 7)
    assert got[0] == {"item_type": "KNOWLEDGE", "queries": [key], "top_scores": {key: round(best, 4)}, "reason_category": "below_threshold" if best < 0.28 else "insufficient_lexical_evidence", "used_ai_fallback": False}
    assert got[1]["reason_category"] == "related_theory_pending" and got[1]["top_scores"] == {}


def test_evidence_takes_recalled_neighbours(spark):
    say = lambda w: f"{w}的定义与步骤，" + w * 30
    texts = [say("绩效考核"), "绩效考核" + "反馈面谈与改进" * 30, say("薪酬"), say("招聘"), say("招聘") + "。"]
    chunks = spark.createDataFrame([("p", "d", str(i), i, i + 1, i + 1, "第一章 人力" if i < 3 else "第二章 招聘", None, t) for i, t in enumerate(texts)], CHUNK)
    plans = spark.createDataFrame([plan(0, "绩效考核"), plan(1, "招聘")], PLAN)
    found = spark.createDataFrame([("p", 0, 1, "0", 0.9, 1, 1, 1, ["绩效考核"]), ("p", 1, 1, "3", 0.9, 1, 4, 4, ["招聘"])], FOUND)
    got: dict = {}
    for r in M.select_evidence(plans, found, chunks).collect():
        got.setdefault(r.idx, {})[r.chunk_id] = r.score
    # chunk 1 is recalled, chunk 2 isn't a neighbour, chunk 4 is recalled with a higher score and chunk 3 its near duplicate
    assert got == {0: {"0": 0.9, "1": 0.8}, 1: {"4": 0.92}}
    assert not M.near_duplicate({"text": texts[0], "page_start": 1, "page_end": 1}, {"text": texts[1], "page_start": 2, "page_end": 2})


def test_sequence_ratio(spark):
    rnd = random.Random(1)
    rows = [("".join(rnd.choice("ab考试") for _ in range(rnd.randint(0, 30))), "".join(rnd.choice("ab考试") for _ in range(rnd.randint(0, 30)))) for _ in range(50)] + [(None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", M.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all((r.r is None) if r.a is None else abs(r.r - SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12 for r in got)


def test_format_warnings(spark):
    bullet = lambda t, o, r, k, ids, pages: {"title": t, "original": {"title": t, "content": o}, "recitation": {"title": t, "content": r}, "keywords": {"title": t, "content": k}, "source_chunk_ids": ids, "source_pages": pages}
    body = lambda *b: json.dumps({"knowledge_point_title": "绩效", "bullet_points": list(b)}, ensure_ascii=False)
    raw = [(1, body(bullet("概念", "甲乙丙丁", "甲乙", "考核、结果、反馈", ["c"], [1]))), (2, body(bullet("绩效", "甲乙" * 500, "甲乙" * 300, "考核", [], []), bullet("长" * 26, "同文", "同文", "a、b、c", ["c"], [1])))]
    n = payloads.normalize_payloads(spark.createDataFrame([(i, 1, x, "t") for i, x in raw], "item_id long, attempt int, raw string, fallback_title string"))
    got = {r.item_id: set(r.w) for r in n.select("item_id", payloads.format_warnings(F.col("payload")).alias("w")).collect()}
    assert got == {1: set(), 2: {"title_of_parent", "sources", "original_over_800", "recitation_over_400", "keywords_3_to_8", "title_over_25", "equal_versions"}}


def test_stream_match_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    words = "绩效 考核 薪酬 招聘 the of ing".split()
    rows = [("p", str(i), None, None, "".join(rnd.choice(words) for _ in range(40)), i, i) for i in range(30)]
    ddl = "project string, chunk_id string, chapter_title string, section_title string, content string, page_start long, page_end long"
    source, sink = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    chunks = spark.createDataFrame(rows, ddl)
    chunks.repartition(3).write.parquet(source)
    plans = spark.createDataFrame([plan(i, w) for i, w in enumerate(("绩效考核", "薪酬招聘", "the of"))], PLAN)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
    table, batches = W.match_batches(plans, sink)
    W.drain(stream, batches=batches, path=sink)
    scored = table.read()
    key = lambda df: sorted((r.idx, r.q_no, r.chunk_id, r.score, r.stage) for r in df.collect())
    assert key(M.top_candidates(scored)) == key(M.match_queries(M.retrieval_queries(plans), chunks)) != []


def test_lease_runs_out_without_news(spark, tmp_path):
    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)
    ddl = "doc_id long, event_id long, status string, ts timestamp"
    path = f"file://{tmp_path}/log"
    for part in ([(1, 1, "processing", at(0)), (2, 2, "processing", at(1)), (2, 3, "completed", at(2))], [(3, 4, "processing", at(600))], [(3, 5, "completed", at(601))]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    got = {(r.doc_id, r.status) for r in W.drain(W.status_changes(stream, lease="30 minutes"), "update").collect()}
    assert got == {(1, "processing"), (1, "failed"), (2, "processing"), (2, "completed"), (3, "processing"), (3, "completed")}


def test_deletion_in_two_steps(spark):
    jobs = spark.createDataFrame([(1, "running"), (1, "done"), (2, "running")], "project long, status string")
    gone = spark.createDataFrame([(1,)], "project long")
    stopped = material.stop_work(jobs, gone, ("running",), "failed", "project_deleted")
    assert {(r.project, r.status, r.stopped) for r in stopped.collect()} == {(1, "failed", "project_deleted"), (1, "done", None), (2, "running", None)}
    assert [(r.project, r.status) for r in material.delete_projects({"jobs": stopped}, gone)["jobs"].collect()] == [(2, "running")]


def test_states_of_projects(spark):
    t = datetime.datetime(2026, 1, 1)
    uploads = spark.createDataFrame([(i, k, s, t, i) for i, (k, s) in enumerate([("course_material", "queued"), ("course_material", "failed"), ("course_material", "queued"), ("course_material", "completed"), ("outline", "failed")])], "project_id long, kind string, status string, accepted_at timestamp, doc_id long")
    own = spark.createDataFrame([(0, "not_uploaded"), (1, "processing"), (2, "completed"), (3, "not_uploaded"), (4, "not_uploaded")], "project_id long, status string")
    done = spark.createDataFrame([], "project_id long")
    assert {r.project_id: r.project_status for r in reports.project_status(own, uploads, done).collect()} == {0: "processing", 1: "failed", 2: "completed", 3: "not_uploaded"}


def test_votes_make_chapters(spark):
    b = lambda *ids: [(f"t{i}", "x", "y", "z", [c], []) for i, c in enumerate(ids)]
    records = spark.createDataFrame([("p", "c", 0, "t", "t", None, b("a", "b", "b"), []), ("p", "c", 1, "u", "u", None, b("z"), []), ("p", "c", 2, "v", "v", None, b("a"), [])], organize.RECORD)
    candidates = spark.createDataFrame([("p", i, c, 0.5, 1, 2) for i in (0, 1, 2) for c in ("a", "b")], "project string, idx long, chunk_id string, score double, page_start long, page_end long")
    chapters = spark.createDataFrame([("a", "A"), ("b", "B"), ("z", "Z")], "chunk_id string, chapter string")
    built, links = organize.compose_material(records, candidates, chapters)
    assert {(r.record, r.chapter, r.chapter_position) for r in built.collect()} == {(0, "B", 0), (1, "__unresolved_chapter__", 1), (2, "A", 2)}
    assert links.count() == 4 and key_of("Ａ") == "a"


def test_rectangle_without_accepted_pairs(spark):
    """Queries of which no chunk has anything: no rows, and the other projects' rows stay."""
    plans = spark.createDataFrame([("p", 0, "zq xw", ["zq xw"]), ("q", 0, "绩效考核指标", ["绩效考核指标"])], "project string, idx long, title string, queries array<string>")
    plans = plans.select("project", "idx", F.lit(None).cast("string").alias("chapter"), "title", "queries", F.array().cast("array<string>").alias("subqueries"), F.lit("KNOWLEDGE").alias("item_type"))
    row = lambda p, text: (p, "d", f"{p}1", 0, 1, 1, None, None, text)
    kind = "project string, doc string, chunk_id string, position long, page_start long, page_end long, chapter_title string, section_title string, content string"
    chunks = spark.createDataFrame([row("p", "绩效"), row("q", "绩效考核指标的内容")], kind)
    assert [(r.project, r.chunk_id) for r in M.match_topics(plans, chunks).collect()] == [("q", "q1")]
    none = plans.where("project = 'p'")
    found = M.match_topics(none, chunks)
    assert found.collect() == []
    rewrites = spark.createDataFrame([("zqxw", ["绩效"]), ("other", ["x"])], "topic_key string, queries array<string>")
    again = M.rematch_with_rewrites(none.withColumn("item_type", F.lit("KNOWLEDGE")), found, rewrites, chunks)
    assert [(r.project, r.chunk_id) for r in again.collect()] == [("p", "p1")]
