"""Colliding bullets: what goes, what is merged into its target first, in which order."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.operators import organize

KINDS = ("original", "recitation", "keywords")
VERSIONS = "project long, chapter long, point long, point_title string, bullet long, kind string, title string, content string, sources array<string>, note string"


def bullet(title, original="一二", recitation="三四", keywords="甲、乙", ids=("c1",), pages=(1,)):
    return title, original, recitation, keywords, list(ids), list(pages)


def organized(spark, rows):
    df = spark.createDataFrame([(p, c, n, t, t, parent, bs, cand) for n, (p, c, t, parent, bs, cand) in enumerate(rows)], organize.RECORD)
    return {r.title: r for r in organize.organize_records(df).collect()}


def material(points, project=1, chapter=1):
    """points: [(title, [bullet])]"""
    return [
        (project, chapter, p, title, n, kind, b[0], text, b[4], f"{p}-{n}-{kind}")
        for p, (title, bullets) in enumerate(points) for n, b in enumerate(bullets) for kind, text in zip(KINDS, b[1:4], strict=True)
    ]


def tree(df):
    out = defaultdict(lambda: defaultdict(dict))
    for r in df.collect():
        out[r.point_title][r.bullet][r.kind] = r
    return out


def test_children_fold_into_their_collection(spark):
    titles = ["能动性", "可再生性", "增值性", "时效性", "社会性"]
    rows = [("p", "第一章", "人力资源的特征", None, [bullet(t, ids=["all"]) for t in titles], ["all"])]
    rows += [("p", "第一章", t, "人力资源的特征", [bullet("核心说明", ids=[t])], [t]) for t in titles]
    got = organized(spark, rows)
    assert set(got) == {"人力资源的特征"} and [b.title for b in got["人力资源的特征"].bullets] == titles
    assert all(b.title in b.chunk_ids and "all" in b.chunk_ids for b in got["人力资源的特征"].bullets)


def test_what_stays_apart_and_what_folds_by_evidence(spark):
    assert len(organized(spark, [("p", "一", "管理方法", None, [bullet("目标管理", ids=["a"])], ["a"]), ("p", "一", "管理方法论", None, [bullet("理论基础", ids=["b"])], ["b"])])) == 2
    got = organized(spark, [("p", "一", "人力资源的特征", None, [bullet("能动性", ids=["s"])], ["s"]), ("p", "一", "能动性", None, [bullet("核心说明", ids=["s"])], ["s"])])
    assert [[b.title for b in r.bullets] for r in got.values()] == [["能动性"]]


def test_collision_keeps_the_complete_point_and_other_bullets(spark):
    titles = ["能动性", "可再生性", "增值性"]
    broad = ("p", "一", "人力资源基础概念", None, [bullet("人力资源的特征"), bullet("人力资源的含义")], ["c1"])
    got = organized(spark, [broad, ("p", "一", "人力资源的特征", None, [bullet(t) for t in titles], ["c1"])])
    assert [b.title for b in got["人力资源基础概念"].bullets] == ["人力资源的含义"] and [b.title for b in got["人力资源的特征"].bullets] == titles
    apart = organized(spark, [("p", "一", "宽泛概念", None, [bullet("共同标题")], []), ("p", "二", "共同标题", None, [bullet("具体内容")], [])])
    assert len(apart) == 2 and apart["宽泛概念"].bullets[0].title == "共同标题"


RICH = bullet("目标知识点", "共享正文\n\n更完整的原文补充内容。", "共享背诵\n\n更完整的背诵补充内容。", "共享、关键词、记忆、完整补充", ["c2"], [7, 2])
POOR = bullet("简述", "共享正文", "共享背诵", "共享、关键词、记忆", ["c1"], [5])


def test_richer_bullet_is_merged_before_it_goes(spark):
    got = organized(spark, [("p", "一", "宽泛知识点", None, [RICH, bullet("其他内容")], ["c2", "c1"]), ("p", "一", "目标知识点", None, [POOR], ["c1"])])
    b = got["目标知识点"].bullets[0]
    assert (b.title, b.original, b.recitation, b.keywords) == ("简述", "共享正文\n\n更完整的原文补充内容。", "共享背诵\n\n更完整的背诵补充内容。", "共享、关键词、记忆、完整补充")
    assert b.chunk_ids == ["c1", "c2"] and b.pages == [2, 5, 7] and got["目标知识点"].candidates == ["c1", "c2"]
    assert [x.title for x in got["宽泛知识点"].bullets] == ["其他内容"]


def test_several_merges_meet_what_earlier_ones_left(spark):
    """The first two go to one target in order; the target's own bullet then goes on, as it has become, to a third record."""
    one = bullet("乙", "alpha beta\n\nfirst addition of some length", "r one r one r one", "k1、k2、k3", ["a"])
    two = bullet("乙", "ALPHA BETA\n\nsecond addition of some length", "r two r two r two", "k2、k4、k5", ["b"])
    onward = bullet("丙", "alpha beta", "r", "k1", ["t"])
    rows = [("p", "一", "甲", None, [one, bullet("其一")], ["a"]), ("p", "一", "另", None, [two, bullet("其二")], ["b"]), ("p", "一", "乙", None, [onward], ["t"]), ("p", "一", "丙", None, [bullet("末", "x", "y", "z", ["u"])], ["u"])]
    got = organized(spark, rows)
    last = got["丙"].bullets[0]
    assert "乙" not in got  # its only bullet went on
    assert last.original == "x\n\nalpha beta\n\nfirst addition of some length\n\nsecond addition of some length"
    assert last.keywords == "z、k1、k2、k3、k4、k5" and last.chunk_ids == ["u", "t", "a", "b"]
    assert [b.title for b in got["甲"].bullets] == ["其一"] and [b.title for b in got["另"].bullets] == ["其二"]


def test_points_that_name_each_others_bullets_vanish(spark):
    assert organized(spark, [("p", "一", "甲", None, [bullet("乙")], []), ("p", "一", "乙", None, [bullet("甲")], [])]) == {}


def test_the_closest_bullet_takes_the_merge(spark):
    rich = bullet("题", "gamma delta\n\nmuch more of it here", "r" * 30, "k" * 30)
    got = organized(spark, [("p", "一", "广", None, [rich, bullet("余")], []), ("p", "一", "题", None, [bullet("近", "gamma", "", "")], [])])
    assert got["题"].bullets[0].original == "gamma\n\ngamma delta\n\nmuch more of it here"
    bullets = [{"original": t, "recitation": "", "keywords": "", "chunk_ids": [], "pages": []} for t in ("none", "beta gamma", "gamma beta")]
    organize.move_record_bullet(bullets, {"original": "Beta gamma new", "recitation": "r", "keywords": "k", "chunk_ids": ["c"], "pages": [1]})
    assert [b["chunk_ids"] for b in bullets] == [[], ["c"], []]  # the first of equals


def test_material_merges_on_reading(spark):
    rows = material([("宽泛", [RICH, bullet("其他内容")]), ("目标知识点", [POOR]), ("旁", [bullet("无关")])])
    rows = [r for r in rows if not (r[2] == 1 and r[5] == "recitation")]  # a version that only the incoming bullet has
    got = tree(organize.canonical_material(spark.createDataFrame(rows, VERSIONS)))
    own = got["目标知识点"][0]
    assert own["original"].content == "共享正文\n\n更完整的原文补充内容。" and own["recitation"].content == RICH[2] and own["keywords"].content.endswith("完整补充")
    assert own["recitation"].title == "目标知识点" and own["recitation"].point_title == "目标知识点" and {tuple(v.sources) for v in own.values()} == {("c1", "c2")}
    assert list(got["宽泛"]) == [1] and set(got) == {"宽泛", "目标知识点", "旁"} and own["original"].note == "1-0-original"


def test_material_without_richer_bullets_only_loses_collisions(spark):
    df = spark.createDataFrame(material([("甲", [bullet("乙"), bullet("x")]), ("乙", [bullet("y"), bullet("z")])]), VERSIONS)
    got = tree(organize.canonical_material(df))
    assert {p: sorted(b) for p, b in got.items()} == {"甲": [1], "乙": [0, 1]} and got["乙"][0]["original"].content == "一二"
    assert organize.canonical_material(df.limit(0)).collect() == []


@pytest.mark.parametrize("kind", KINDS)
def test_merged_content_is_that_of_columns(spark, kind):
    pairs = [("a、B，a", "b; c\nD"), ("p one\n\nP  ONE", "two\n \n three"), ("", "x"), ("Straße", "STRASSE、q"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.m for r in df.select(T.merge_content(F.lit(kind), F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [organize.merged_content(kind, *p) for p in pairs]


def test_a_bullet_that_takes_several_has_its_versions_once_for_each(spark):
    other = bullet("目标知识点", "共享正文\n\n另一处补充的内容更加完整一些。", "另一份背诵内容也更加完整一些", "甲、丁、戊己", ["c3"])
    df = spark.createDataFrame(material([("宽泛", [RICH, bullet("其他内容")]), ("又一", [other, bullet("别的")]), ("目标知识点", [POOR])]), VERSIONS)
    own = [r for r in organize.merged_one_by_one(df).collect() if r.point == 2]
    texts = sorted(r.content for r in own if r.kind == "original")
    assert len(own) == 6 and texts == sorted(organize.merged_content("original", POOR[1], b[1]) for b in (RICH, other))
    assert len([r for r in organize.canonical_material(df).collect() if r.point == 2]) == 3


def test_collisions_are_sought_under_whole_titles_in_growing_projects(spark, tmp_path):
    from noteloom.plans import content_queries

    turns = [(0, 0, "alpha one"), (40, 0, "beta two"), (40, 3, "alpha three"), (80, 0, "alphabet four")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").selectExpr("conv_id", "turn", "'user' AS role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = content_queries.c11_collisions(spark, str(tmp_path)).collect()
    assert (row.project, row.point, row.bullet, row.target) == (0, 40, 1, 0)
