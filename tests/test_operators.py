"""Operators on small tables."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from noteloom.config import CONFIG, Config
from noteloom.functions.keys import key_of
from noteloom.operators import matching as M
from noteloom.operators import material, organize, outline, payloads, planning, prefix, reports
from noteloom.operators import structure as B


def test_blocks_and_outline(spark):
    pages = spark.createDataFrame([("d", 1, "第一章 绪论\n正文一\n正文二\n\n第二段"), ("d", 2, "1.1 小节\n内容")], "doc_id string, page_number int, text string")
    kinds = [(r.kind, r.raw_text) for r in B.build_blocks(pages).orderBy("block_no").collect()]
    assert kinds == [("chapter", "第一章 绪论"), ("content", "正文一\n正文二"), ("content", "第二段"), ("section", "1.1 小节"), ("content", "内容")]
    marks = spark.createDataFrame([("d", 1, "绪论篇", 1, 0), ("d", 2, "ignored", 2, 1)], "doc_id string, level int, title string, page_number int, ord int")
    got = [(r.kind, r.raw_text) for r in B.build_blocks(pages, marks).orderBy("block_no").collect()]
    assert got[0] == ("chapter", "绪论篇") and got[1] == ("content", "第一章 绪论\n正文一\n正文二")


def test_chunks_keep_all_text(spark):
    random.seed(5)
    text = "。".join("字" * random.randint(5, 90) for _ in range(60)) + "。"
    rows = [("d", 0, "chapter", 1, "第一章 a"), ("d", 1, "content", 1, text), ("d", 2, "section", 2, "1.1 b"), ("d", 3, "content", 3, "x " * 700), ("d", 4, "content", 4, "tail")]
    blocks = spark.createDataFrame(rows, "doc_id string, block_no int, kind string, page_number int, raw_text string")
    got = B.split_chunks(blocks, Config(target_size=300, maximum_size=400)).orderBy("position").collect()
    assert "".join("".join(r.content.split()) for r in got) == "".join("".join(r[4].split()) for r in rows)
    assert all(len(r.content) <= 420 for r in got) and [r.position for r in got] == list(range(len(got)))
    assert {r.section_title for r in got} == {None, "1.1 b"} and got[-1].page_end == 4


def test_pages_of_one_chapter_make_one_chunk(spark):
    blocks = spark.createDataFrame([("d", i, "content", p, f"page {p}") for i, p in enumerate((1, 137, 138, 200))], "doc_id string, block_no int, kind string, page_number int, raw_text string")
    (row,) = B.split_chunks(blocks).collect()
    assert (row.page_start, row.page_end) == (1, 200)


def test_outline_parents(spark):
    text = "第一章 基础\n1. 主要特征包括\n   (1) 能动性\n   (2) 时效性\n2. 概念\n2. 概念\n---\n第二章 方法\n• 招聘方法"
    got = [(r.chapter, r.title, r.parent_title) for r in outline.parse_outline(spark.createDataFrame([("p", text)], "project string, text string")).orderBy("idx").collect()]
    parent = "主要特征包括"
    assert got == [("第一章 基础", parent, None), ("第一章 基础", "能动性", parent), ("第一章 基础", "时效性", parent), ("第一章 基础", "概念", None), ("第二章 方法", "招聘方法", None)]


def plain_score(key: str, chapter: str, chunk: dict) -> float:
    """The score by the definitions, over plain strings."""
    own = [key_of(x) for x in (chunk["chapter_title"], chunk["section_title"]) if x]
    body = key_of(chunk["content"])
    grams = {key[i : i + 2] for i in range(len(key) - 1)} if len(key) >= 4 else set(key)
    near = max(SequenceMatcher(None, key, t).ratio() for t in [*own, body[: max(6 * len(key), 160)]])
    options = [0.72 * near, 0.68 * sum(g in body for g in grams) / len(grams)]
    options += [0.8] * (key in body) + [0.92] * any(t and (key in t or t in key) for t in own) + [1.0] * (key in own)
    value = max(options)
    if chapter and chunk["chapter_title"]:
        value += 0.08 * SequenceMatcher(None, key_of(chapter), key_of(chunk["chapter_title"])).ratio()
    value = min(1.0, value)
    titles = "".join(own)
    structural = len(body) < 50 and ((titles and (body in titles or titles in body)) or "目录" in body or len(re.sub("^(?:第?[一二三四五六七八九十百0-9]+[章节篇部、.]?)+", "", body)) <= 16)
    if value < 0.9:
        value *= (0.55 if structural else 1) * (0.75 if re.search("https?://", chunk["content"]) else 1)
    return value


def recalled(core: str, words: list[str], texts) -> bool:
    hay = key_of(" ".join(t for t in texts if t))
    return (core != "" and key_of(core) in hay) or sum(key_of(w) in hay for w in set(words)) > 1


def brute(queries, chunks):
    """Best candidates and the best score of all, every query with every chunk."""
    out, top = {}, {}
    for n, chapter, core, words, matching in queries:
        key, found = key_of(matching), []
        grams = {key[i : i + 2] for i in range(len(key) - 1)} if len(key) >= 4 else set(key)
        top[n] = 0.0
        for c in chunks:
            if not key or (len(key) <= 4 and not recalled(core, words, (c["section_title"], c["content"]))):
                continue
            s = plain_score(key, chapter, c)
            top[n] = max(top[n], round(s, 4))
            hay = key_of(" ".join(c[k] for k in ("chapter_title", "section_title", "content") if c[k]))
            if s >= 0.35 and (s >= 0.8 or sum(g in hay for g in grams) / len(grams) >= 0.6):
                found.append((round(s, 4), 1, c["chunk_id"]))
            elif s >= 0.28 and recalled(core, words, (c["chapter_title"], c["section_title"], c["content"])):
                found.append((round(s, 4), 2, c["chunk_id"]))
        first = [x for x in found if x[1] == 1]
        out[n] = sorted((-s, i) for s, _, i in (found if len(first) < CONFIG.candidates else first))[: CONFIG.candidates]
    return out, top


def test_match_equals_brute_force(spark, monkeypatch):
    random.seed(11)
    words = "招聘 甄选 绩效 薪酬 培训 人力 资源 规划 理论 the of and tion ing".split()
    say = lambda n: "".join(random.choice(words) for _ in range(n))
    chunks = [{"project": "p", "chunk_id": f"{i:03}", "chapter_title": say(2) if i % 3 else None, "section_title": say(1) if i % 2 else None, "content": say(random.randint(0, 60)) + (" https://x" if i % 7 == 0 else ""), "page_start": 1, "page_end": 1} for i in range(90)]
    queries = [(i, say(2) if i % 4 == 0 else None, q[: random.randint(1, 9)], random.sample(words, i % 4), q) for i in range(60) for q in [say(random.randint(1, 6))]] + [(60, None, "", [], " 、"), (61, None, "xyzzy", [], "xyzzyq")]
    ready = spark.createDataFrame([("p", i, ch, 0, m, c, w, m) for i, ch, c, w, m in queries], "project string, idx long, chapter string, q_no int, query string, core string, words array<string>, matching string")
    table = spark.createDataFrame(chunks, "project string, chunk_id string, chapter_title string, section_title string, content string, page_start long, page_end long")
    expected, top = brute(queries, chunks)
    for config, size in ((CONFIG, 256), (Config(broadcast_bytes=0), 16)):
        monkeypatch.setattr(M, "PACKED_CHUNKS", size)
        monkeypatch.setattr(M, "PACKED_QUERIES", size)
        for form in ("matrix", "grams"):
            got: dict = {}
            for r in M.match_queries(ready, table, config, form).collect():
                got.setdefault(r.idx, []).append((-r.score, r.chunk_id))
            assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in expected.items() if x}, form
        assert {r.idx: r.best for r in M.query_scores(ready, table, config).collect()} == top


def test_rare_grams_leave_few_pairs(spark, monkeypatch):
    """In a text of many characters few pairs share rare grams, and all pairs that match are among them; the form is chosen by that."""
    rnd = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    say = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    texts = [say(rnd.randint(20, 200)) for _ in range(120)]
    asked = [(f"{say(2)}{t[5:13]}", say(3)) if i % 2 else (say(9), t[2:6]) for i, t in enumerate(texts[:40])]
    ready = spark.createDataFrame([("p", i, None, 0, m, c, [], m) for i, (m, c) in enumerate(asked)], "project string, idx long, chapter string, q_no int, query string, core string, words array<string>, matching string")
    table = spark.createDataFrame([("p", f"{i:03}", say(4), asked[i][0][:2] if i % 9 == 0 and i < 40 else None, t, 1, 1) for i, t in enumerate(texts)], "project string, chunk_id string, chapter_title string, section_title string, content string, page_start long, page_end long")
    key = lambda form: sorted((r.idx, r.chunk_id, r.score, r.stage) for r in M.match_queries(ready, table, form=form).collect())
    assert key("grams") == key("matrix") and len(key("grams")) >= 20
    pairs = {(r.idx, r.chunk_id) for r in prefix.candidate_pairs(ready, table).collect()}
    assert {(i, c) for i, c, _, _ in key("matrix")} <= pairs and len(pairs) < 40 * 120 / 10
    monkeypatch.setattr(prefix, "LOOKED_AT", 1)
    assert prefix.worth_looking(ready) and prefix.expected_share(ready, table) <= CONFIG.few_pairs
    assert sorted((r.idx, r.chunk_id, r.score, r.stage) for r in M.match_queries(ready, table).collect()) == key("grams")
    same = ready.withColumns({"matching": F.lit("the the the"), "core": F.lit("the")})
    assert not prefix.worth_looking(same) and prefix.expected_share(same, table.withColumn("content", F.lit("then there the"))) > 0.5


def test_cover():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(0, 6)
        rows = [{"matched_queries": rnd.sample("abcdef", rnd.randint(0, 3)), "rank": i} for i in range(n)]
        wanted, most = set(rnd.sample("abcdef", rnd.randint(0, 4))), rnd.randint(1, 6)
        order, open_ = [], set(wanted)
        while open_ and len(order) < most:
            left = [r["rank"] for r in rows if r["rank"] not in order and open_ & set(rows[r["rank"]]["matched_queries"])]
            if not left:
                break
            order.append(max(left, key=lambda i: (len(open_ & set(rows[i]["matched_queries"])), -i)))
            open_ -= set(rows[order[-1]]["matched_queries"])
        order = (order + [i for i in range(n) if i not in order])[:most]
        assert [r["rank"] for r in M.cover(rows, sorted(wanted), most)] == order


def test_evidence():
    rows = [{"chunk_id": str(i), "worth": 0.9 - i / 10, "page_start": i, "page_end": i, "text": f"定义 passage {i} " + "xyz"[i % 3] * 60, "matched_queries": q} for i, q in enumerate((["a"], ["a"], ["b"], ["c"]))]
    assert [r["chunk_id"] for r in M.choose_evidence([*rows, rows[0] | {"chunk_id": "9"}], [])] == ["0", "1", "2"]
    assert [r["chunk_id"] for r in M.choose_evidence([*rows[:3], rows[3] | {"text": "定义 " + "w" * 70}], ["c"])] == ["0", "1", "3"]
    assert [r["chunk_id"] for r in M.choose_evidence([rows[0], rows[1] | {"page_start": 0}, rows[2]], [])] == ["0", "2", "1"]
    assert len(M.choose_evidence([r | {"text": "q" * 7000 + r["chunk_id"] * 40} for r in rows], [])) == 1


def test_diversity_and_utility(spark):
    rows = [("a", 0.5, "定义" + "x" * 50, 3, 4, [(5, 6)]), ("b", 0.5, "short", 3, 4, [(4, 9)]), ("c", 0.5, "x" * 50, 3, 4, [])]
    df = spark.createDataFrame(rows, "id string, score double, text string, page_start long, page_end long, chosen array<struct<page_start:long,page_end:long>>")
    got = {r.id: round(r.v, 6) for r in df.select("id", M.diversity(M.utility(df["score"], df["text"]), df["page_start"], df["page_end"], df["chosen"]).alias("v")).collect()}
    assert got == {"a": 0.69, "b": 0.3, "c": 0.55}


def test_fold_and_collisions(spark):
    b = lambda *xs: [(t, f"text {t}", "x", "y", [c], [1]) for t, c in xs]
    rows = [
        ("p", "c", 0, "人力资源特征", "特征", None, b(("能动性", "1"), ("时效性", "2")), ["1", "2", "3"]),
        ("p", "c", 1, "能动性", "能动性", None, b(("含义", "1")), ["1", "2"]),
        ("p", "c", 2, "独立", "独立", "特征", b(("说明", "9")), ["9"]),
        ("p", "c", 3, "别的", "别的", None, b(("内容", "5")), ["5"]),
        ("p", "c", 4, "1、别的", "别的2", None, b(("新", "6")), ["6"]),
    ]
    got = {r.record: r for r in organize.organize_records(spark.createDataFrame(rows, organize.RECORD)).collect()}
    assert set(got) == {0, 3} and [x.title for x in got[0].bullets] == ["能动性", "时效性", "独立"]
    assert [x.title for x in got[3].bullets] == ["内容", "新"] and set(got[0].candidates) == {"1", "2", "3", "9"}


def test_payloads(spark):
    good = '{"knowledge_point_title":"绩效","bullet_points":[{"title":"绩效概念","original":{"title":"绩效概念","content":"内容一二"},"recitation":{"title":"绩效概念","content":"背诵一二"},"keywords":{"title":"绩效概念","content":"考核、结果"},"source_chunk_ids":["c1"],"source_pages":[1]}]}'
    drift = '{"original":["一二","三四"],"recitation":"背诵 内容","keywords":["甲乙","丙丁"],"source_chunk_ids":"c1","source_pages":["2"]}'
    broken = '{"bullet_points":[{"original":{"title":"t","content":"内容一二"},"recitation":"背诵内容'
    raw = spark.createDataFrame([(1, 1, f"```json\n{good}\n```", "t"), (2, 1, drift, "标题"), (3, 1, broken, "t"), (4, 1, "no", "t"), (5, 1, good.replace('"背诵一二"', '""').replace('["c1"]', '["c1","zz"]'), "t")], "item_id long, attempt int, raw string, fallback_title string")
    n = payloads.normalize_payloads(raw)
    v = {r.item_id: r.faults for r in payloads.validate_payloads(n).collect()}
    assert v[1] == [] and v[2] == [] and v[3] == ["no_json"] and v[4] == ["no_json"] and v[5] == ["recitation_noise"]
    ev = spark.createDataFrame([(i, ["c1"], [1, 2]) for i in range(1, 6)], "item_id long, chunk_ids array<string>, pages array<int>")
    s = {r.item_id: r for r in payloads.salvage(n, ev).collect()}
    assert s[5].bullets[0].recitation.content == "内容一二" and s[5].bullets[0].source_chunk_ids == ["c1"] and set(s[5].warnings) == {"version_filled", "citation_dropped"}
    assert [(r.item_id, r.original, r.recitation) for r in payloads.recover_broken(raw).collect()] == [(3, "内容一二", "")]  # what isn't behind a content key doesn't count
    assert 3 not in s and 4 not in s  # one letter isn't a readable title


def test_reports(spark):
    log = spark.createDataFrame([("d", 1, "failed", "2026-01-01 00:00:00", 1), ("d", 1, "completed", "2026-01-01 00:01:00", 2), ("d", 1, "completed", "2026-01-01 00:02:00", 3)], "doc_id string, page_number int, status string, ts string, event_id int")
    (row,) = reports.upsert_pages(log).collect()
    assert (row.event_id, row.retry_count) == (2, 1)
    up = spark.createDataFrame([("d", 300)], "doc_id string, total_pages long")
    done = spark.createDataFrame([("d", i, "completed") for i in range(1, 138)], "doc_id string, page_number long, status string")
    (row,) = reports.missing_pages(up, done).collect()
    assert (row.missing, row.resume_at) == (163, 138)


def test_replace_keeps_old_on_failure(spark, tmp_path):
    rows = [("p1", "c", 1, 0, "original", "t", "x"), ("p2", "c", 2, 0, "original", "t", "y")]
    ddl = "project string, chapter string, point long, bullet long, kind string, title string, content string"
    path = f"file://{tmp_path}/m"
    material.replace_material(spark.createDataFrame(rows, ddl), path)
    try:
        material.replace_material(spark.createDataFrame([("p1", "c", 1, 0, "original", None, "z")], ddl), path)
        raise AssertionError("must fail")
    except ValueError:
        pass
    assert sorted(r.content for r in material.material_table(spark, path).read().collect()) == ["x", "y"]
    material.replace_material(spark.createDataFrame([("p1", "c", 1, 0, "original", "t", "new")], ddl), path)
    assert sorted(r.content for r in material.material_table(spark, path).read().collect()) == ["new", "y"]


def test_plan_types(spark):
    topics = spark.createDataFrame([("p", 0, "c", "激励理论", None), ("p", 1, "c", "案例分析", None), ("p", 2, "c", "主要方法", None), ("p", 3, "c", "问卷法", "主要方法")], "project string, idx long, chapter string, title string, parent_title string")
    got = {r.idx: r for r in planning.plan_queries(topics).collect()}
    assert [got[i].item_type for i in range(4)] == ["KNOWLEDGE", "TASK", "COLLECTION", "KNOWLEDGE"]
    assert got[1].queries == [] and got[1].related[0] == "激励理论" and got[2].subqueries == ["问卷法"] and "问卷调查法" in got[3].queries


def test_missing_pages_are_counted_not_made(spark):
    up = spark.createDataFrame([("d", 3_000_000_000), ("e", 2), ("f", 3), ("g", 0)], "doc_id string, total_pages long")
    done = spark.createDataFrame([("d", 1, "completed"), ("d", 1, "completed"), ("d", 3, "completed"), ("e", 1, "completed"), ("e", 2, "completed"), ("f", 3, "completed"), ("f", 9, "completed"), ("f", 1, "failed")], "doc_id string, page_number long, status string")
    got = {r.doc_id: (r.missing, r.resume_at) for r in reports.missing_pages(up, done).collect()}
    assert got == {"d": (2_999_999_998, 2), "f": (2, 1)}


def test_rectangles_are_dealt_by_the_size_of_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "TASK_CHARACTERS", 100)
    chunks = spark.createDataFrame([(f"p{i % 5}", f"c{i}", None, None, "word " * 20, i, i) for i in range(40)], "project string, chunk_id string, chapter_title string, section_title string, content string, page_start long, page_end long")
    plans = spark.createDataFrame([(f"p{i}", i, None, ["word"]) for i in range(5)], "project string, idx long, chapter string, queries array<string>")
    for config in (CONFIG, Config(broadcast_bytes=0)):
        dealt = M.rectangles(M.retrieval_queries(plans), chunks, config)
        assert dealt.rdd.getNumPartitions() == 40 and sorted((r.project, len(r.queries), len(r.chunks)) for r in dealt.collect()) == [(f"p{i}", 1, 8) for i in range(5)]


def test_texts_behind_their_titles_hold_what_whole_texts_hold():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab甲乙") for _ in range(rng.randint(0, n)))
    for _ in range(50):
        n = M.Needles([word(5) for _ in range(12)])
        heads, texts = [word(4) for _ in range(9)], [word(12) for _ in range(9)]
        held = n.held(texts)
        whole = [h + t for h, t in zip(heads, texts, strict=True)]
        both = n.held_with(heads, texts, held)
        assert (both == n.held(whole)).all()
        found = n.found_with(heads, texts, both, n.found(texts, held))
        assert found.tolist() == [[bool(x) and x in t for t in whole] for x in n.needles]
