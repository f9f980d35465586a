"""Outlines: text to topics with chapters and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import predicates as P
from ..functions import text as T


def outline_lines(outlines: DataFrame) -> DataFrame:
    """project, line_no, cleaned, is_chapter, title, indent, depth of the lines with content; outlines: project, text."""
    raw = outlines.select("project", F.posexplode(F.split("text", "\\r\\n|\\r|\\n", -1)).alias("line_no", "line"))
    c = raw.withColumn("cleaned", T.clean_line(F.col("line"))).where("cleaned != ''")
    return c.select(
        "project", F.col("line_no").cast("long").alias("line_no"), "cleaned", F.col("cleaned").rlike(C.OUTLINE_CHAPTER).alias("is_chapter"), T.outline_title(F.col("cleaned")).alias("title"),
        T.indent_width(F.col("line")).alias("indent"), T.number_depth(F.col("cleaned")).alias("depth"),
    )


def first_occurrence(lines: DataFrame) -> DataFrame:
    """The first line of each dedupe key in the whole outline."""
    rank = F.row_number().over(Window.partitionBy("project", "key").orderBy("line_no"))
    return lines.withColumn("key", T.dedupe_key(F.col("title"))).where("title != ''").withColumn("rank", rank).where("rank = 1").drop("rank", "key")


def topic_chapter(lines: DataFrame) -> DataFrame:
    """Carries the last chapter line down."""
    order = Window.partitionBy("project").orderBy("line_no")
    return lines.withColumn("chapter", F.last(F.when(F.col("is_chapter"), F.col("cleaned")), ignorenulls=True).over(order))


def topic_parents(topics: DataFrame) -> DataFrame:
    """parent_title by a fold over each chapter run: a collection line opens a parent, which lasts while lines are nested in it."""
    one = "struct<line_no:bigint,title:string,indent:int,depth:int,opens:boolean>"
    collected = topics.withColumn("opens", P.is_collection_title(F.col("title"))).groupBy("project", "chapter").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "title", F.col("indent").cast("int").alias("indent"), F.col("depth").cast("int").alias("depth"), "opens"))).alias("xs")
    )
    start = F.struct(F.lit(None).cast(one).alias("parent"), F.array().cast("array<struct<line_no:bigint,title:string,parent_title:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        p = s["parent"]
        numbered, parent_numbered = x["depth"] > 0, p["depth"] > 0
        inside = p.isNotNull() & ((x["indent"] > p["indent"]) | (parent_numbered & numbered & (x["depth"] > p["depth"])) | (~parent_numbered & numbered))
        parent = F.when(x["opens"], x.cast(one)).when(inside, p)
        row = F.struct(x["line_no"].alias("line_no"), x["title"].alias("title"), F.when(inside, p["title"]).alias("parent_title"))
        return F.struct(parent.alias("parent"), F.concat(s["out"], F.array(row)).alias("out"))

    return collected.select("project", "chapter", F.explode(F.aggregate("xs", start, step, lambda s: s["out"])).alias("t")).select("project", "chapter", "t.*")


def parse_outline(outlines: DataFrame) -> DataFrame:
    """project, idx, chapter, title, parent_title of every topic."""
    lines = topic_chapter(outline_lines(outlines)).where("not is_chapter")
    topics = topic_parents(first_occurrence(lines))
    idx = F.row_number().over(Window.partitionBy("project").orderBy("line_no")) - 1
    return topics.select("project", idx.alias("idx"), "chapter", "title", "parent_title")
