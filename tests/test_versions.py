"""Replacement of all or nothing, streams merged by key, running candidates, chains of dependent topics."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from noteloom.functions.keys import key_of
from noteloom.operators import matching as M
from noteloom.operators import material
from noteloom.operators import reports as R
from noteloom.sources.versions import Conflict, VersionedTable
from noteloom.streaming import flows as W

ROW = "project string, chapter string, point long, bullet long, kind string, title string, content string"


def rows(*pairs):
    return [(p, "c", 1, 0, "original", "t", text) for p, text in pairs]


def contents(table, version=None):
    return sorted((r.project, r.content) for r in table.read(version).collect())


def test_a_failure_between_partitions_leaves_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    table = material.material_table(spark, path)
    assert table.read() is None and table.version() == 0
    material.replace_material(spark.createDataFrame(rows(("p1", "a"), ("p2", "b"), ("p3", "c")), ROW), path)
    bad = F.udf(lambda p: 1 // (p != "p2") and "new", "string")
    half = spark.createDataFrame(rows(("p1", "x"), ("p2", "x"), ("p3", "x")), ROW).repartition(3, "project").withColumn("content", bad("project"))
    with pytest.raises(Exception, match="ZeroDivision"):
        material.replace_material(half, path)
    assert contents(table) == [("p1", "a"), ("p2", "b"), ("p3", "c")] and table.version() == 1
    with pytest.raises(ValueError, match="without title"):
        material.replace_material(spark.createDataFrame(rows(("p1", None)), ROW), path)
    assert contents(table) == [("p1", "a"), ("p2", "b"), ("p3", "c")] and len(table.stale()) >= 1
    material.replace_material(spark.createDataFrame(rows(("p2", "new"), ("p4", "d")), ROW), path, gone=spark.createDataFrame([("p3",)], "project string"))
    assert contents(table) == [("p1", "a"), ("p2", "new"), ("p4", "d")] and contents(table, 1) == [("p1", "a"), ("p2", "b"), ("p3", "c")]
    assert table.vacuum() >= 1 and contents(table) == [("p1", "a"), ("p2", "new"), ("p4", "d")]


def test_of_two_writers_the_second_is_told(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "project")
    df = lambda text: spark.createDataFrame(rows(("p", text)), ROW)
    assert table.replace(df("one"), ledger={"by": 1, "at": 7}) == 1
    at = table.version()
    assert table.replace(df("two"), expected=at, ledger={"by": 2}) == 2
    with pytest.raises(Conflict):
        table.replace(df("three"), expected=at)
    assert contents(table) == [("p", "two")] and table.ledger() == {"by": 2, "at": 7}
    assert table.read(parts=spark.createDataFrame([("none",)], "project string")).collect() == []


LOG = "doc_id long, page_number long, attempt_id long, status string, method string, text string, ts timestamp, event_id long"


def test_pages_merge_by_batches(spark, tmp_path):
    rnd = random.Random(4)
    log = [(rnd.randrange(5), rnd.randrange(4), 0, rnd.choice(("failed", "completed", "processing")), "text", str(i), f"2026-01-{rnd.randint(1, 28):02d} 00:00:00", i) for i in range(90)]
    df = spark.createDataFrame(log, LOG.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    table, keep = W.page_batches(spark, f"file://{tmp_path}/pages", buckets=3)
    key = lambda x: sorted((r.doc_id, r.page_number, r.event_id, r.status, r.retry_count) for r in x.collect())
    for n in range(3):  # no order in time between batches
        part = df.where(F.col("event_id") % 3 == n)
        keep(part, n)
        assert key(table.read()) == key(R.upsert_pages(df.where(F.col("event_id") % 3 <= n)))
        version = table.version()
        keep(part, n)  # comes again after a failure
        assert table.version() == version and key(table.read()) == key(R.upsert_pages(df.where(F.col("event_id") % 3 <= n)))


def test_running_candidates_after_every_batch(spark, tmp_path):
    rnd = random.Random(2)
    words = "绩效 考核 薪酬 招聘 the of ing".split()
    chunks = spark.createDataFrame([("p", str(i), None, None, "".join(rnd.choice(words) for _ in range(rnd.choice((4, 9, 40)))), i, i) for i in range(60)], "project string, chunk_id string, chapter_title string, section_title string, content string, page_start long, page_end long")
    plans = spark.createDataFrame([("p", i, None, w, "KNOWLEDGE", [w], [], [], []) for i, w in enumerate(("绩效考核", "薪酬招聘的基本内容与方法", "the of", "none of this"))], "project string, idx long, chapter string, title string, item_type string, queries array<string>, subqueries array<string>, children array<string>, related array<string>")
    table, keep = W.match_batches(plans, f"file://{tmp_path}/c", buckets=2)
    key = lambda df: sorted((r.idx, r.q_no, r.chunk_id, r.score, r.stage) for r in df.collect())
    for n in range(3):
        keep(chunks.where(F.col("page_start") % 3 == n), n)
        assert key(M.top_candidates(table.read())) == key(M.match_queries(M.retrieval_queries(plans), chunks.where(F.col("page_start") % 3 <= n))) != []
    assert max(r["count"] for r in table.read().groupBy("idx", "q_no", "stage").count().collect()) <= 6


PLAN = "project string, idx long, title string, item_type string, children array<string>, related array<string>, subqueries array<string>, queries array<string>"
FOUND = "project string, idx long, rank int, chunk_id string, score double, stage int, page_start long, page_end long, matched_queries array<string>"


def in_order(plans, found, most=6):
    """The same by one pass over a project's topics."""
    at = {key_of(p[2]): i for i, p in enumerate(plans)}
    rows = {i: sorted((f for f in found if f["idx"] == i), key=lambda f: f["rank"]) for i in range(len(plans))}
    for i, (_, _, _, kind, kids, near, subs, _) in enumerate(plans):
        if kind == "COLLECTION" and kids:
            sources = [i] + [s for t in kids if (s := at.get(key_of(t))) is not None and s != i]
        elif kind == "TASK" and not rows[i]:
            sources = [s for t in near if (s := at.get(key_of(t))) is not None]
        else:
            continue
        rows[i] = M.taken_over([{"source_title": plans[s][2], "rows": rows[s]} for s in dict.fromkeys(sources) if rows[s]], subs, most)
    return sorted((i, r["rank"], r["chunk_id"], r["score"], tuple(r["matched_queries"])) for i, own in rows.items() for r in own)


def test_chains_of_dependent_topics(spark):
    rnd = random.Random(9)
    titles = [f"题目{i}" for i in range(40)]
    plans = [("p", i, t, rnd.choice(("KNOWLEDGE", "COLLECTION", "TASK")), [titles[max(0, i - 1)], *rnd.sample(titles, 2)], [titles[max(0, i - 1)], *rnd.sample(titles, 1)], [], []) for i, t in enumerate(titles)]
    plans[20:28] = [("p", i, titles[i], "COLLECTION", [titles[i - 1]], [], [], []) for i in range(20, 28)]  # a chain of eight
    plans[39] = ("p", 39, titles[3], "KNOWLEDGE", [], [], [], [])  # a title that comes twice
    found = [{"project": "p", "idx": i, "rank": r, "chunk_id": f"c{rnd.randrange(30)}-{r}", "score": round(rnd.random(), 4), "stage": rnd.choice((1, 2)), "page_start": rnd.randrange(9), "page_end": 9, "matched_queries": [titles[i]]} for i in range(40) if rnd.random() < 0.4 for r in (1, 2, 3)]
    p = spark.createDataFrame(plans, PLAN)
    f = spark.createDataFrame([tuple(x.values()) for x in found], FOUND)
    got = sorted((r.idx, r["rank"], r.chunk_id, r.score, tuple(r.matched_queries)) for r in M.resolve_dependent(p, f).collect())
    assert got == in_order(plans, found)
    plan = M.resolve_dependent(p, f)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_reasons_of_dependent_topics(spark):
    plans = [("p", 0, "甲", "KNOWLEDGE", [], [], [], ["甲"]), ("p", 1, "乙", "COLLECTION", ["丙"], [], [], ["乙"]), ("p", 2, "丙", "KNOWLEDGE", [], [], [], ["丙"]), ("p", 3, "丁", "TASK", [], ["丙"], [], []), ("p", 4, "戊", "TASK", [], ["甲"], [], []), ("p", 5, "己", "COLLECTION", ["甲"], [], [], ["己"]), ("p", 6, "庚", "COLLECTION", [], [], [], ["庚"])]
    found = spark.createDataFrame([("p", 0, 1, "c", 0.9, 1, 1, 1, ["甲"])], FOUND)
    p = spark.createDataFrame(plans, PLAN)
    got = {r.idx: (r.matched, r.recall_stage, r.reason) for r in M.dependent_matches(p, found, M.resolve_dependent(p, found)).collect()}
    yes = (True, "primary", None)
    assert got == {0: yes, 1: (False, None, "no_child_evidence"), 2: (False, None, "below_threshold"), 3: (False, None, "no_related_theory_evidence"), 4: yes, 5: yes, 6: (False, None, "below_threshold")}
