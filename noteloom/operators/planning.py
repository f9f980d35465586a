"""Retrieval query plans of topics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import CONFIG, Config
from ..functions import predicates as P
from ..functions import text as T
from ..functions.keys import key_of



def strings(values=()) -> Column:
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"cast(array({quoted}) as array<string>)")  # one call, as vocabularies have hundreds of words


def children_of(topics: DataFrame) -> DataFrame:
    """project, parent_key, children: child titles in order."""
    kids = topics.where("parent_title is not null and parent_title != ''").withColumn("parent_key", T.query_key(F.col("parent_title"))).groupBy("project", "parent_key")
    return kids.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "title"))), lambda x: x["title"]).alias("children"))


def related_topics(topics: DataFrame, reach: int = 5, most: int = 4) -> DataFrame:
    """project, idx, related: titles of theories and methods in the same chapter at up to ``reach`` places, the nearest first."""
    near = Window.partitionBy("project", "chapter").orderBy("idx").rangeBetween(-reach, reach)
    around = F.collect_list(F.struct("idx", "title")).over(near)

    def fits(x: Column) -> Column:
        wanted = F.when(F.col("title").contains("模型"), x["title"].rlike(C.RELATED_MODEL)).otherwise(True)
        return (x["idx"] != F.col("idx")) & wanted & x["title"].rlike(C.RELATED)

    ranked = F.array_sort(F.transform(F.filter("around", fits), lambda x: F.struct(F.abs(x["idx"] - F.col("idx")).alias("far"), x["idx"].alias("at"), x["title"].alias("title"))))
    return topics.withColumn("around", around).select("project", "idx", T.unique_queries(F.transform(F.slice(ranked, 1, most), lambda x: x["title"])).alias("related"))


def alias_queries(x: Column, config: Config = CONFIG) -> Column:
    """All names of each group that has a name within the query or around it."""

    def named(key: Column) -> Column:
        parts = []
        for group in config.alias_groups:
            names = [key_of(a) for a in group]
            hit = key.rlike("|".join(re.escape(n) for n in names)) | F.exists(strings(names), lambda n: F.contains(n, key))
            parts.append(F.when((key != "") & hit, strings(group)).otherwise(strings()))
        # few phrases hold a name or lie in one, so one pattern and one search decide first
        names = [key_of(a) for group in config.alias_groups for a in group]
        near = (key != "") & (key.rlike("|".join(re.escape(n) for n in names)) | F.contains(F.lit("\n".join(names)), key))
        return F.when(near, F.concat(*parts)).otherwise(strings())

    return T.let(T.let(T.query_key(x), named), lambda q: F.when(F.size(q) > 0, T.unique_queries(q)).otherwise(q))


def topic_expansions(x: Column, config: Config = CONFIG) -> Column:
    """Queries of each rule whose required terms all occur."""

    def expanded(key: Column) -> Column:
        hits = [F.forall(strings([key_of(t) for t in required]), lambda t: F.contains(key, t)) for required, _ in config.expansions]
        every = F.concat(*[F.when(h, strings(queries)).otherwise(strings()) for h, (_, queries) in zip(hits, config.expansions, strict=True)])
        return F.when(key.rlike("|".join(re.escape(key_of(required[0])) for required, _ in config.expansions)), every).otherwise(strings())

    return T.let(T.let(T.query_key(x), expanded), lambda q: F.when(F.size(q) > 0, T.unique_queries(q)).otherwise(q))


def plan_queries(topics: DataFrame, config: Config = CONFIG) -> DataFrame:
    """project, idx, chapter, parent_title, title, item_type, queries, subqueries, children, related."""
    keyed = topics.withColumn("title", F.btrim("title")).withColumn("parent_key", T.query_key(F.col("title")))
    j = keyed.join(children_of(topics), ["project", "parent_key"], "left").join(related_topics(topics), ["project", "idx"], "left")
    # small rows that take long: dealt by number, not by size, and large projects too
    j = j.repartition(4 * topics.sparkSession.sparkContext.defaultParallelism, "project", "idx")
    j = j.withColumn("children", F.coalesce("children", strings())).withColumn("matching", T.matching_query(F.col("title"))).withColumn("configured", topic_expansions(F.col("title"), config))
    j = j.withColumn("subs", F.when(F.size("configured") > 0, F.col("configured")).otherwise(T.split_subqueries(F.col("matching")))).withColumn("item_type", P.item_type(F.col("title"), F.col("children"), F.col("subs")))
    differs = T.query_key(F.col("matching")) != T.query_key(F.col("title"))
    each = F.flatten(F.transform("subs", lambda q: F.concat(F.array(q), alias_queries(q, config))))
    plain = F.concat(F.array("title"), F.when(differs, F.array("matching")).otherwise(strings()), alias_queries(F.col("title"), config), each)
    bare_task = (F.col("item_type") == "TASK") & (F.size("configured") == 0)
    parent = (F.col("item_type") == "COLLECTION") & (F.size("children") > 0)
    family = F.concat("configured", "children")
    queries = F.when(bare_task, strings()).when(parent, F.concat(F.array("title"), family)).otherwise(plain)
    subqueries = F.when(bare_task, strings()).when(parent, family).otherwise(F.col("subs"))
    return j.select("project", "idx", "chapter", "parent_title", "title", "item_type", T.unique_queries(queries).alias("queries"), T.unique_queries(subqueries).alias("subqueries"), "children", F.coalesce("related", strings()).alias("related"))


def clean_rewrites(rewrites: DataFrame) -> DataFrame:
    """topic_key, queries: short, different phrases; one row for each key, the least of several."""
    tidy = F.filter(F.transform("queries", lambda q: T.blank_free(q)), lambda q: F.length(q) <= 80)
    return rewrites.groupBy("topic_key").agg(F.min("queries").alias("queries")).select("topic_key", F.slice(T.unique_by(tidy, T.compare_title), 1, 5).alias("rewrite_queries"))


def with_rewrites(plans: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Adds the looked-up queries to plans of plain knowledge topics."""
    j = plans.withColumn("topic_key", T.query_key(F.col("title"))).join(clean_rewrites(rewrites), "topic_key", "left")
    more = F.when((F.col("item_type") == "KNOWLEDGE") & F.col("rewrite_queries").isNotNull(), F.col("rewrite_queries")).otherwise(strings())
    return j.withColumn("queries", T.unique_queries(F.concat("queries", more))).drop("topic_key", "rewrite_queries", "prepared")
