"""Generated JSON: regular shape against plain Python, texts out of broken output, salvage."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from noteloom import config as C
from noteloom.operators import payloads as J
from noteloom.operators import recovery

KINDS = J.KINDS
RAW = "item_id long, attempt int, raw string, fallback_title string"


def plain_text(value, keywords=False):
    if isinstance(value, dict):
        value = value.get("content")
    if isinstance(value, list):
        parts = [str(x).lower() if isinstance(x, bool) else str(x).strip() for x in value if isinstance(x, str | int | float) and str(x).strip()]
        return ("、" if keywords else "\n\n").join(parts)
    if not isinstance(value, str):
        return ""
    if keywords:
        return "、".join(x for x in map(str.strip, re.split(C.KEYWORD_ITEMS, value)) if x)
    return re.sub(r"[ \t]+", " ", value.strip())


def different(values, number=False):
    values = values if isinstance(values, list) else [] if values is None else [values]
    if number:
        values = [int(v) for v in values if (isinstance(v, int) and not isinstance(v, bool)) or (isinstance(v, str) and re.fullmatch("[0-9]+", v.strip()))]
    else:
        values = [v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for v in values]
    return list(dict.fromkeys(values))


def regular(body, fallback):
    try:
        p = json.loads(body)
    except ValueError:
        return None
    if not isinstance(p, dict):
        return None
    lone = "bullet_points" not in p and any(k in p for k in (*KINDS, "source_chunk_ids", "source_pages"))
    title = p.get("knowledge_point_title")
    title = (title if isinstance(title, str) and title.strip() else fallback or "").strip()
    bullets = [p] if lone else p.get("bullet_points")
    bullets = [bullets] if isinstance(bullets, dict) else bullets if isinstance(bullets, list) else []
    out = []
    for b in (x for x in bullets if isinstance(x, dict)):
        inner = [v["title"] for v in map(b.get, KINDS) if isinstance(v, dict) and isinstance(v.get("title"), str) and v["title"].strip()]
        own = b.get("title") if isinstance(b.get("title"), str) and not lone else None
        t = (own or (inner[0] if inner else None) or fallback or "").strip()
        out.append((t, *((t, plain_text(b.get(k), k == "keywords")) for k in KINDS), different(b.get("source_chunk_ids")), different(b.get("source_pages"), True)))
    return title, out


def as_plain(p):
    return p and (p.knowledge_point_title, [(b.title, *((b[k].title, b[k].content) for k in KINDS), list(b.source_chunk_ids), list(b.source_pages)) for b in p.bullet_points])


def random_value(rnd, deep=0):
    pick = rnd.randrange(9 if deep < 2 else 6)
    if pick < 3:
        return rnd.choice(["绩效 管理", " a  b\t c ", "", "  ", "x、y；z|w", "12", " 7 ", "line\n\nline", "ß Ü　"])
    if pick < 6:
        return rnd.choice([None, True, 3, 12345, 2.5, 0])
    if pick == 6:
        return [random_value(rnd, deep + 1) for _ in range(rnd.randint(0, 3))]
    return {rnd.choice(["content", "title", "other"]): random_value(rnd, deep + 1) for _ in range(rnd.randint(0, 3))}


def random_payload(rnd):
    bullet = lambda: {k: random_value(rnd) for k in ("title", *KINDS, "source_chunk_ids", "source_pages", "more") if rnd.random() < 0.7}
    p = bullet() if rnd.random() < 0.2 else {"bullet_points": rnd.choice([[bullet() for _ in range(rnd.randint(0, 3))], bullet(), "x", None, [bullet(), 5, "s", None]])}
    if rnd.random() < 0.8:
        p["knowledge_point_title"] = random_value(rnd)
    return p


def test_regular_shape_is_that_of_plain_python(spark):
    rnd = random.Random(6)
    bodies = [json.dumps(random_payload(rnd), ensure_ascii=rnd.random() < 0.5) for _ in range(400)] + ["[1]", "{}", '"x"', "null", "{bad", '{"bullet_points": [{}]}']
    rows = [(i, 1, b, rnd.choice(["题", None, " t "])) for i, b in enumerate(bodies)]
    got = {r.item_id: as_plain(r.p) for r in spark.createDataFrame(rows, RAW).select("item_id", J.regular(F.col("raw"), F.col("fallback_title")).alias("p")).collect()}
    for i, _, body, fallback in rows:
        assert got[i] == regular(body, fallback), body


def test_no_python_in_the_regular_shape(spark):
    df = J.validate_payloads(J.normalize_payloads(spark.createDataFrame([(1, 1, "{}", "t")], RAW)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(("raw", "found"), [
    ('{"original":{"title":"t","content":"一二"},"recitation":{"content":"三四', [("original", "一二"), ("recitation", "三四")]),
    ("{'original': {'title': 'x', 'content': 'it\\'s 一二'}, keywords: {content: ['甲', \"乙\"]}}", [("original", "it's 一二"), ("keywords", "甲、乙")]),
    ('Original: {Content: bare words, title: "t"}\nRECITATION : {"CONTENT" : "r"}', [("original", "bare words"), ("recitation", "r")]),
    ('"original":{"content":"a \\"q\\" \\n b"}, "keywords":{"content":["k1","k2', [("original", 'a "q" \n b'), ("keywords", "k1")]),
    ('"original":"direct text is not behind a key","keywords":["x"]', []),
    ('"original":{"content":""},"original":{"content":"","content":"second"}', [("original", "second")]),
    ('"original":{"content":"ends in a slash\\', [("original", "ends in a slash")]),
    ("no braces at all", []), ("", []), (None, []),
])
def test_scanner(raw, found):
    assert list(recovery.scanned(raw)) == found


def test_scanner_is_linear_in_long_output():
    text = '{"original":{"content":"' + "长\\n文" * 200_000
    assert [(k, len(v)) for k, v in recovery.scanned(text)] == [("original", 600_000)]


def bullet(title="绩效管理", original="绩效管理包括目标设定。", recitation="绩效管理包括目标设定。", keywords="目标、反馈", ids=("c1",), pages=(12,)):
    version = lambda x: x if isinstance(x, list | dict) else {"title": title, "content": x}
    return {"title": title, "original": version(original), "recitation": version(recitation), "keywords": version(keywords), "source_chunk_ids": list(ids), "source_pages": list(pages)}


def dump(*bullets, title="绩效管理"):
    return json.dumps({"knowledge_point_title": title, "bullet_points": list(bullets)}, ensure_ascii=False)


BROKEN = """
```json
{
  "knowledge_point_title": "胜任素质模型",
  "bullet_points": [{
    "title": "胜任素质模型",
    "original": {"title": "胜任素质模型", "content": "胜任素质模型用于描述产生优秀绩效所需要的知识。"},
    "recitation": {"title": "胜任素质模型", "content": "概括优秀绩效所需的知识。"},
    "keywords": {"title": "胜任素质模型", "content": "知识、技能、行为特征"}
```
"""


def test_salvage(spark):
    rows = [
        (1, 1, dump(bullet()), "绩效管理"),  # equal versions are kept
        (2, 1, dump({"title": "招聘", "original": {"content": "招聘需要依据岗位要求。"}, "keywords": ["岗位要求", "筛选"], "source_chunk_ids": ["other"], "source_pages": [999], "unexpected": 1}), "招聘"),
        (3, 1, dump({"title": "损坏", "original": "-", "recitation": "", "keywords": ""}, bullet("基本流程")), "绩效管理"),
        (4, 1, BROKEN, "胜任素质模型"),
        (5, 1, '{"knowledge_point_title":"绩效管理","bullet_points":[{"title":"损坏"', "绩效管理"),
        (6, 1, dump({"title": "损坏", "original": "-", "recitation": "", "keywords": ""}), "绩效管理"),
        (7, 1, dump(bullet("第一章 第二章 两个编号")), "绩效管理"),
        (8, 1, dump(bullet(keywords="、".join(f"词{i:02d}" for i in range(60)), original="长" * 9000)), "绩效管理"),
        (9, 1, dump(bullet()), "绩效管理"), (9, 2, BROKEN, "后来"),
        (10, 1, "{'original': {'content': '第一条内容'}, 'original': {'content': '第二条内容'}", "题目"),
        (11, 1, dump(bullet("", "有内容的原文。", "有内容的背诵。", "")), "绩效管理"),
        (12, 1, dump(bullet(), title=""), "-"),
    ]
    evidence = spark.createDataFrame([(i, ["c1"], [12, 13]) for i in range(1, 13)], "item_id long, chunk_ids array<string>, pages array<int>")
    n = J.normalize_payloads(spark.createDataFrame(rows, RAW))
    s = {r.item_id: r for r in J.salvage(n, evidence).collect()}
    assert set(s) == {1, 2, 3, 4, 7, 8, 9, 10, 11}  # 12: no title can be read
    assert s[1].bullets[0].original == s[1].bullets[0].recitation and s[1].warnings == []
    b = s[2].bullets[0]
    assert b.recitation.content == b.original.content and list(b.source_chunk_ids) == [] == list(b.source_pages) and {"version_filled", "citation_dropped", "sources_unverified"} <= set(s[2].warnings)
    assert [x.title for x in s[3].bullets] == ["基本流程"] and "bullet_dropped" in s[3].warnings
    b = s[4].bullets[0]
    assert "优秀绩效" in b.original.content and b.keywords.content == "知识、技能、行为特征" and b.title == "胜任素质模型" and {"recovered", "sources_unverified"} <= set(s[4].warnings)
    assert s[7].bullets[0].title == "要点 1" and "title_filled" in s[7].warnings
    assert len(s[8].bullets[0].original.content) == 8000 and s[8].bullets[0].keywords.content.count("、") == 49 and {"text_cut", "keywords_cut"} <= set(s[8].warnings)
    assert s[9].attempt == 2 and s[9].title == "后来" and "recovered" in s[9].warnings  # a later attempt goes first
    assert [(x.title, x.original.content) for x in s[10].bullets] == [("要点 1", "第一条内容"), ("要点 2", "第二条内容")]
    assert s[11].bullets[0].keywords.content == s[11].bullets[0].title == "绩效管理"
    valid = J.validate_payloads(n)
    out = {r.item_id: r.outcome for r in J.attempt_outcomes(valid, J.salvage(n, evidence)).collect()}
    assert (out[1], out[4], out[5], out[6], out[10]) == ("valid", "salvaged", "failed", "failed", "salvaged")


def test_texts_are_judged_as_they_were_written(spark):
    """Bars and slashes split keywords only when they are tidied, and tidied texts are shorter."""
    made = lambda keywords, original="足够长的原文": json.dumps({"knowledge_point_title": "绩效管理", "bullet_points": [{"title": "绩效管理", "original": original, "recitation": "足够长的背诵", "keywords": keywords, "source_chunk_ids": ["c1"], "source_pages": [1]}]}, ensure_ascii=False)
    rows = [(1, 1, made(" | ".join(f"word{i}" for i in range(60))), "t"), (2, 1, made("、".join(f"word{i}" for i in range(60))), "t"), (3, 1, made("甲、乙", "文字" + " " * 8000 + "文字"), "t"), (4, 1, made("http://a.b"), "t")]
    n = J.normalize_payloads(spark.createDataFrame(rows, RAW))
    got = {r.item_id: list(r.faults) for r in J.validate_payloads(n).collect()}
    assert got == {1: [], 2: ["keyword_count"], 3: ["original_length"], 4: ["keywords_noise"]}
    evidence = spark.createDataFrame([(i, ["c1"], [1]) for i in range(1, 5)], "item_id long, chunk_ids array<string>, pages array<int>")
    out = {r.item_id: r.outcome for r in J.attempt_outcomes(J.validate_payloads(n), J.salvage(n, evidence)).collect()}
    assert out[1] == "valid" and out[2] == "salvaged"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blank_characters_are_those_of_blanks(spark):
    every = spark.range(0x110000).where("id not between 55296 and 57343 and id != 65279").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert every.where(F.col("c").rlike(f"\\A{C.BLANKS}\\z") != F.lit(C.BLANK_CHARACTERS).contains(F.col("c"))).count() == 0


def test_salvage_works_a_text_out_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(J, "written", lambda df, name: made.append(df) or df)
    n = spark.createDataFrame([], f"{RAW}, payload {J.PAYLOAD}")
    J.salvage(n, spark.createDataFrame([], "item_id long, chunk_ids array<string>, pages array<int>"))
    # two titles of the item, title and three texts of a bullet, texts of broken output and a filter on them
    assert plan_of(made[0]).count("mininunversity") <= 8


def test_recovery_works_a_text_out_once(spark):
    plan = plan_of(J.recover_broken(spark.createDataFrame([], RAW)))
    assert plan.count("mininunversity") <= 1 and "Filter isnull" not in plan and plan.count("scan") <= 1


def test_outputs_and_their_objects_are_made_once(spark):
    from noteloom.plans import content_queries as Q

    n = plan_of(spark.createDataFrame([], RAW).select(J._with_given(F.col("raw"), F.col("fallback_title")).alias("x")))
    assert n.count("StringType,VariantType") <= 13
    assert plan_of(Q.raw_outputs(spark, "/root/testdata/sf0.001")).count("x1f]") <= 6
