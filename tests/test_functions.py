"""Column functions on single values, with the cases of Chinese headings and outlines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from noteloom.functions import predicates as P
from noteloom.functions import text as T
from noteloom.functions.keys import key_of
from noteloom.operators import planning as Q


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()] or [F.lit(0)])
    return row.select(column.alias("out")).first()["out"]


def test_keys(spark):
    for text in ("Ｘ－Ｙ 理论", "Straße_1", "（双因素）理论", "A — B", "", "６W１H"):
        assert value(spark, T.query_key(F.col("x")), x=text) == key_of(text)
    assert value(spark, T.title_key(F.col("x")), x="1、绩效管理：概念") == value(spark, T.title_key(F.col("x")), x="（2）绩效管理:概念")
    assert value(spark, T.compare_title(F.col("x")), x="第三章 绩效 管理") == "绩效管理"
    assert value(spark, T.display_title(F.col("x")), x="第一章 1. 绩效") == "绩效"


def test_prepare(spark):
    x = "人力资本：概念，特点；需掌握计算，其他"
    assert value(spark, T.matching_query(F.col("x")), x=x) == "人力资本：概念、特点"
    assert value(spark, T.prepared_core(F.col("x")), x=x) == "人力资本"
    assert value(spark, T.expanded_keywords(F.col("x")), x=x) == ["舒尔茨", "贝克尔", "知识技能", "能力资本"]
    assert value(spark, T.matching_query(F.col("x")), x="plain") == "plain"


def test_subqueries(spark):
    split = lambda x: value(spark, T.split_subqueries(F.col("x")), x=x)
    assert split("扩张性、紧缩性财政政策") == ["扩张性财政政策", "紧缩性财政政策"]
    assert split("招聘与甄选的区别") == ["招聘", "甄选"]
    assert split("绩效管理") == []


@pytest.mark.parametrize(("title", "number"), [("第三章 a", 3), ("第十章", 10), ("第十二章 b", 12), ("第二十章", 20), ("第二十一章", 21), ("第一百零五章", 105), ("第15章 c", 15), ("附录", None)])
def test_chapter_number(spark, title, number):
    # 一百零五: what follows 百 is read as digits
    assert value(spark, T.chapter_number(F.col("x")), x=title) == number


@pytest.mark.parametrize(
    ("title", "shown"),
    [("第一章 绪论", True), ("第一章", False), ("目录", False), ("__hidden", False), ("绪论 / 25", False), ("第12-15页", False), ("book.pdf · 12", False), ("1.2.3", False), ("", False), (None, False), ("Motivation", True)],
)
def test_displayable(spark, title, shown):
    assert value(spark, P.is_displayable_chapter(F.col("x").cast("string")), x=title) is shown


def test_content(spark):
    assert value(spark, T.merge_content(F.lit("keywords"), F.col("a"), F.col("b")), a="a、B", b="b，c") == "a、B、c"
    assert value(spark, T.keyword_list(F.col("x")), x="1. 招聘、招聘；培训/绩效") == "1. 招聘、培训、绩效"
    assert value(spark, T.redact(F.col("x")), x="bad token=abc123 end") == "bad [敏感信息已隐藏] end"
    assert value(spark, T.excerpt(F.col("x"), F.lit("Q")), x="a" * 40 + "q" + "b" * 60) == "…" + "a" * 28 + "q" + "b" * 42 + "…"
    assert value(spark, T.reduce_title(F.col("x")), x="考点：" + "长" * 30) == "考点"


def test_vocabulary(spark):
    assert value(spark, Q.alias_queries(F.col("x")), x="双因素理论的应用")[0] == "赫茨伯格双因素理论"
    assert value(spark, Q.alias_queries(F.col("x")), x="完全无关") == []
    assert value(spark, Q.topic_expansions(F.col("x")), x="德尔菲与经验判断") == ["德尔菲法 专家预测法", "经验判断法 主观判断法"]
    kinds = [("案例分析", [], [], "TASK"), ("主要方法", [], [], "COLLECTION"), ("a", ["b"], [], "COLLECTION"), ("a", [], ["b", "c"], "COMPOSITE"), ("a", [], ["b"], "KNOWLEDGE")]
    for title, kids, subs, kind in kinds:
        assert value(spark, P.item_type(F.col("x"), Q.strings(kids), Q.strings(subs)), x=title) == kind


def test_query_key_is_one_rule(spark):
    """Columns and single strings agree on every assigned code point, alone and beside others, and on random strings."""
    import random
    import unicodedata

    from noteloom.functions.keys import folded

    rnd = random.Random(3)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    rare = [c for c in points if unicodedata.normalize("NFKC", c) != c or c.casefold() != c or unicodedata.combining(c)]
    lists = [points[i : i + 40] for i in range(0, len(points), 40)] + [[rnd.choice(rnd.choice((rare, points))) for _ in range(rnd.randint(1, 12))] for _ in range(4000)]
    texts = ["-".join(x) for x in lists[:-4000]] + ["".join(x) for x in lists[-4000:]] + ["", "ＡＢ－Ｃ", "ﬁÅ①㎏", "Straße ΣΑΣ İ"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "x string").repartition(4)
    got = {r.x: r.k for r in df.select("x", T.query_key(F.col("x")).alias("k")).collect()}
    assert got.pop(None) is None
    assert [t for t in set(texts) if got[t] != key_of(t)] == []
    assert [t for t in ("Straße", "ÄÖ Ü", "x") if value(spark, T.casefold(F.lit(t))) != folded(t)] == []
