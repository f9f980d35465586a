"""Candidate pairs of the similarity join by rare grams, as ordinary joins.

A pair can only be accepted if the chunk holds three fifths of the query's grams, a title of the chunk lies inside the
query, or the query's core phrase or one of its keywords occurs in the chunk.  The first needs one of the query's rarest
grams (all but as many as the chunk may lack, and one more), the last two the rarest gram of the phrase or word, and a
title's rarest gram is among the query's.  So postings of grams are joined with a few rare grams of each query, and only
pairs that come out of these joins are scored.  Which order counts as rare decides how many pairs come out, not whether
any is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..sources.sinks import written

QUERY = ["project", "idx", "q_no"]
#: One in so many queries and chunks is looked at to choose between the forms; no result rests on it.
LOOKED_AT = 16
#: Different characters of queries from which on grams can be rare enough to ask for that share.
LETTERS = 256


def pieces(key: Column, size: Column) -> Column:
    """Distinct grams of a size that a key has."""
    spots = F.when(F.length(key) >= size, F.sequence(F.lit(1), F.length(key) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substr(key, i, size)))


def own_size(key: Column) -> Column:
    return F.when(F.length(key) > 1, 2).otherwise(1)


def query_parts(queries: DataFrame) -> DataFrame:
    """project, idx, q_no, part, grams, least: the whole query (part 0), its core phrase and its keywords, with how many grams a chunk must hold."""
    keyed = queries.select(*QUERY, T.query_key(F.col("matching")).alias("key"), T.query_key(F.col("core")).alias("core"), F.transform("words", T.query_key).alias("words"))
    whole = T.let(F.col("key"), lambda k: pieces(k, F.when(F.length(k) >= 4, 2).otherwise(1)))
    held = F.concat(F.array("core"), "words")
    inner = F.transform(F.filter(held, lambda p: p != ""), lambda p: pieces(p, own_size(p)))
    parts = F.concat(F.array(F.struct(whole.alias("grams"), F.lit(True).alias("share"))), F.transform(inner, lambda g: F.struct(g.alias("grams"), F.lit(False).alias("share"))))
    each = keyed.select(*QUERY, F.posexplode(parts).alias("part", "p")).select(*QUERY, "part", "p.grams", "p.share").where("size(grams) > 0")
    n = F.size("grams")
    # a share of three fifths in whole numbers; phrases and words must be there whole
    return each.select(*QUERY, "part", "grams", F.when(F.col("share"), F.ceil(n * int(10 * C.GRAM_GATE) / 10)).otherwise(n).cast("int").alias("least"))


def chunk_keys(chunks: DataFrame) -> DataFrame:
    part = lambda c: T.query_key(F.coalesce(c, F.lit("")))
    return chunks.select("project", "chunk_id", part("chapter_title").alias("chapter"), part("section_title").alias("section"), part("content").alias("body"))


def postings(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """project, gram, chunk_id for the grams in ``vocabulary``, by characters and pairs."""
    whole = chunk_keys(chunks).select("project", "chunk_id", F.concat("chapter", "section", "body").alias("all"))
    grams = F.explode(F.concat(pieces(F.col("all"), F.lit(1)), pieces(F.col("all"), F.lit(2))))
    return whole.select("project", "chunk_id", grams.alias("gram")).join(vocabulary, ["project", "gram"], "left_semi")


def rare_grams(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """project, idx, q_no, part, gram, n: of each part the rarest grams, one more than a chunk may lack; n chunks have it."""
    each = parts.select(*QUERY, "part", (F.size("grams") - F.col("least") + 1).alias("most"), F.explode("grams").alias("gram")).join(counts, ["project", "gram"], "left")
    rank = F.row_number().over(Window.partitionBy(*QUERY, "part").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    return each.withColumn("rank", rank).where("rank <= most and n is not null").select(*QUERY, "part", "gram", "n")


def title_pairs(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """project, idx, q_no, chunk_id where a title of the chunk lies inside the query."""
    keys = chunk_keys(chunks).select("project", "chunk_id", F.explode(F.array_distinct(F.array("chapter", "section"))).alias("title")).where("title != ''")
    titles = keys.select("project", "title").distinct().withColumn("gram", F.substr("title", F.lit(1), F.least(F.length("title"), F.lit(2))))
    asked = queries.select(*QUERY, T.query_key(F.col("matching")).alias("key"))
    asked = asked.select("*", F.explode(F.concat(pieces(F.col("key"), F.lit(1)), pieces(F.col("key"), F.lit(2)))).alias("gram"))
    inside = asked.join(titles, ["project", "gram"]).where(F.contains("key", "title")).select(*QUERY, "title")
    return inside.join(keys, ["project", "title"]).select(*QUERY, "chunk_id")


def candidate_pairs(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """project, idx, q_no, chunk_id: every pair that can be accepted, and some others."""
    parts = written(query_parts(queries), "parts")
    posted = written(postings(chunks, parts.select("project", F.explode("grams").alias("gram")).distinct()), "postings")
    rare = rare_grams(parts, posted.groupBy("project", "gram").agg(F.count("*").alias("n")))
    met = rare.select(*QUERY, "gram").distinct().join(posted, ["project", "gram"]).select(*QUERY, "chunk_id")
    return met.unionByName(title_pairs(queries, chunks)).distinct()


def worth_looking(queries: DataFrame) -> bool:
    """Whether the queries are written in a script of many characters: in others every gram is in most chunks."""
    letters = queries.select(F.explode(F.array_distinct(F.split("matching", ""))).alias("letter")).agg(F.count_distinct("letter").alias("n"))
    return letters.first()["n"] >= LETTERS


def expected_share(queries: DataFrame, chunks: DataFrame) -> float:
    """About which share of all pairs the joins of grams would make (over one if most pairs come out many times), by one in LOOKED_AT of queries and chunks."""
    picked = lambda *c: F.pmod(F.xxhash64(*c), F.lit(LOOKED_AT)) == 0
    queries, some = queries.where(picked("idx", "q_no")), chunks.where(picked("chunk_id"))
    parts = query_parts(queries)
    posted = postings(some, parts.select("project", F.explode("grams").alias("gram")).distinct())
    rare = rare_grams(parts, posted.groupBy("project", "gram").agg(F.count("*").alias("n")))
    made = rare.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("made")).first()["made"]
    sizes = queries.groupBy("project").agg(F.count("*").alias("q")).join(some.groupBy("project").agg(F.count("*").alias("c")), "project")
    every = sizes.agg(F.coalesce(F.sum(F.col("q") * F.col("c")), F.lit(0)).alias("every")).first()["every"]
    return made / every if every else 1.0


def scored_by_grams(queries: DataFrame, chunks: DataFrame, run, columns: list[str], chunk_columns: list[str], schema: str, most: int) -> DataFrame:
    """``run`` over rows of a project with one chunk and up to about ``most`` of its candidate queries."""
    pairs = candidate_pairs(queries, chunks)
    dealt = pairs.join(queries, QUERY).withColumn("part", F.pmod(F.xxhash64("idx", "q_no"), F.ceil(F.count("*").over(Window.partitionBy("project", "chunk_id")) / most)))
    asked = dealt.groupBy("project", "chunk_id", "part").agg(F.collect_list(F.struct(*columns)).alias("queries"))
    own = chunks.select("project", F.col("chunk_id").alias("of"), F.array(F.struct(*chunk_columns)).alias("chunks"))
    met = asked.join(own, (asked["project"] == own["project"]) & (asked["chunk_id"] == own["of"])).select(asked["project"], "queries", "chunks")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held += [x for x in run(iter([b])) if len(x)]
            if held:
                yield pd.concat(held)
                held = []

    return met.mapInPandas(each, schema)
