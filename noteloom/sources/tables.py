"""Inputs of the operators, read from the driver's tables; each has its SQL twin in VIEWS for the oracles.

documents serve as pages, chunks and topics of projects (a range of ids in a source, so that a project stays as small as
a course however large a source is), orders as uploaded documents of workspaces,
lineitem as job items, events as page and status logs, conversations as material.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


#: Ids of a source that make one project.
PROJECT_IDS = 4000


def first_line(text: Column | str) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def numbered(spark: SparkSession, sf_dir: str, text: Column | str = "text") -> DataFrame:
    """documents with their project and idx, their place in it from 0; ``text`` is what is needed of their texts, which numbering moves."""
    project = F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / PROJECT_IDS).cast("string"))
    docs = documents(spark, sf_dir).select("doc_id", project.alias("project"), "lang", (F.col(text) if isinstance(text, str) else text).alias("text"))
    return docs.withColumn("idx", (F.row_number().over(Window.partitionBy("project").orderBy("doc_id")) - 1).cast("long"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, idx, chapter, title, parent_title: one outline topic for each document, worded from its first words."""
    words = F.split("text", " ")
    w = [F.coalesce(F.get(words, F.lit(i)), F.lit("x")) for i in range(4)]
    kind = F.col("doc_id") % 6
    title = (
        F.when(kind == 0, F.concat(w[0], F.lit("性、"), w[1], F.lit("性"), w[2], w[3]))
        .when(kind == 1, F.concat(w[0], F.lit("与"), w[1], F.lit("的区别")))
        .when(kind == 2, F.concat(F.lit("主要"), w[0], F.lit("方法")))
        .when(kind == 3, F.concat(w[0], F.lit(" 理论："), w[1], F.lit("，"), w[2], F.lit("；需掌握"), w[3]))
        .when(kind == 4, F.concat(w[0], F.lit("案例分析")))
        .otherwise(F.concat(F.lit("1."), (F.col("doc_id") % 9).cast("string"), F.lit(" "), w[0], F.lit(" "), w[1], F.lit(" Ａ－Ｂ")))
    )
    t = numbered(spark, sf_dir, first_line("text")).select("project", "idx", F.concat(F.lit("第"), (F.floor(F.col("idx") / 10) + 1).cast("string"), F.lit("章 "), "project").alias("chapter"), title.alias("title"))
    head = F.first("title").over(Window.partitionBy("project", F.floor(F.col("idx") / 5)).orderBy("idx"))
    return t.select("project", "idx", "chapter", "title", F.when((F.col("idx") % 5).isin(1, 2), head).alias("parent_title"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, doc, chunk_id, position, page_start, page_end, chapter_title, section_title, content."""
    word = F.split_part(first_line("text"), F.lit(" "), F.lit(1))
    chapter = F.concat(F.lit("第"), (F.floor(F.col("idx") / 5) % 12 + 1).cast("string"), F.lit("章 "), word)
    heading = F.col("idx") % 5 == 0
    return numbered(spark, sf_dir).select(
        "project", F.col("project").alias("doc"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("idx").alias("position"), (F.col("idx") + 1).alias("page_start"),
        (F.col("idx") + 1 + F.when(F.col("doc_id") % 4 == 3, 1).otherwise(0)).alias("page_end"), F.when(F.col("doc_id") % 7 != 6, chapter).alias("chapter_title"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("section_title"), F.when(heading, F.concat(chapter, F.lit("\n"), F.col("text"))).otherwise(F.col("text")).alias("content"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded documents of workspaces: orders by customer."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderkey") % 3 == 0, "failed").when(F.col("o_orderkey") % 3 == 1, "completed").otherwise("interrupted")
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), (F.col("o_custkey") % 40).alias("workspace_id"), (F.col("o_custkey") % 200).alias("project_id"), F.when(F.col("o_custkey") % 10 == 0, "owner").otherwise("public").alias("role"),
        F.when(k % 5 == 0, "outline").otherwise("course_material").alias("kind"), status.alias("status"), (F.floor(F.col("o_totalprice")) % 400 + 1).cast("long").alias("total_pages"),
        F.when(k % 4 == 0, 0).otherwise(F.floor(F.col("o_totalprice")) % 400 + 1).cast("long").alias("quota_pages"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("queue_priority"), F.col("o_orderdate").alias("accepted_at"),
        F.when(k % 11 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("quota_released_at"), (k % 13).cast("long").alias("processed_pages"), F.when(k % 7 != 0, k).alias("object_key"),
        F.when(k % 2 == 0, F.col("o_orderdate") + F.expr("INTERVAL 10 MINUTES")).alias("lease_expires_at"), F.when(k % 2 == 0, k % 17).alias("lease_owner"), F.concat(F.lit("file"), k.cast("string"), F.when(k % 6 == 0, ".PDF").when(k % 6 == 1, ".docx").otherwise(".pdf")).alias("name"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job items: lineitem by order."""
    kind = F.when(F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "A", "failed").otherwise("pending")).otherwise("succeeded")
    failure = F.when(F.col("l_returnflag") == "A", F.element_at(F.array(*[F.lit(x) for x in ("unmatched", "schema_validation", "generation_error", "format_warning")]), (F.col("l_partkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")).cast("long").alias("position"), (F.col("l_orderkey") % 200).alias("project_id"),
        F.concat(F.lit("topic "), F.col("l_partkey").cast("string")).alias("item"), F.concat(F.lit("chapter "), (F.col("l_suppkey") % 9).cast("string")).alias("chapter"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("topic "), F.col("l_suppkey").cast("string"))).alias("parent_item"),
        kind.alias("status"), failure.alias("failure_type"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("reason token="), F.col("l_suppkey").cast("string"), F.lit(" tail"))).alias("reason"), F.col("l_shipdate").alias("updated_at"),
    )


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page log: events of a user as attempts at the pages of one document."""
    return as_page_events(table(spark, sf_dir, "events"))


def as_page_events(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "processing").otherwise("completed")
    return events.select(
        F.col("user_id").alias("doc_id"), (F.col("event_id") % 40 + 1).alias("page_number"), (F.col("event_id") % 3).alias("attempt_id"), status.alias("status"), F.when(F.col("event_type") == "view", "ocr").otherwise("text").alias("method"), F.col("props").alias("text"), "ts", "event_id",
    )


def material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of bullets: project, chapter, point, bullet, kind, title, content; a conversation is a point, three turns a
    bullet, forty conversations a project and ten a chapter, so that both stay small however many there are.  A title is
    the first letters of a turn: short enough that bullets and points of a chapter share some."""
    text = F.col("text")
    c = table(spark, sf_dir, "conversations").withColumn("bullet", F.floor(F.col("turn") / 3).cast("long"))
    title = F.left(F.split_part(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(" "), F.lit(1)), F.lit(TITLE_LETTERS))
    kind = F.element_at(F.array(F.lit("original"), F.lit("recitation"), F.lit("keywords")), (F.col("turn") % 3 + 1).cast("int"))
    return c.select(
        F.floor(F.col("conv_id") / 40).alias("project"), (F.floor(F.col("conv_id") / 10) % 4).alias("chapter"), F.col("conv_id").alias("point"), "bullet",
        kind.alias("kind"), title.alias("title"), text.alias("content"), "turn", "role",
    )


TITLE_LETTERS = 3


def whole_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """material with the whole first word of a turn as title, and ten projects that grow with the conversations."""
    word = F.split_part(F.split_part("content", F.lit("\n"), F.lit(1)), F.lit(" "), F.lit(1))
    return material(spark, sf_dir).withColumns({"project": F.col("point") % 10, "title": word})


_WORD = "string_split(string_split(text, chr(10))[1], ' ')"
_W = [f"coalesce({_WORD}[{i}], 'x')" for i in range(1, 5)]
#: SQL twins, to stand in a WITH clause.
VIEWS = {
    "lines": "lines AS (SELECT doc_id, source, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)))",
    "numbered": f"numbered AS (SELECT doc_id, source || ':' || (doc_id // {PROJECT_IDS}) AS project, lang, text, row_number() OVER (PARTITION BY source, doc_id // {PROJECT_IDS} ORDER BY doc_id) - 1 AS idx FROM documents)",
    "topics": f"""topics AS (SELECT project, idx, chapter, title, CASE WHEN idx % 5 IN (1, 2) THEN first_value(title) OVER (PARTITION BY project, idx // 5 ORDER BY idx) END AS parent_title FROM (
 SELECT project, idx, '第' || (idx // 10 + 1) || '章 ' || project AS chapter,
 CASE doc_id % 6 WHEN 0 THEN {_W[0]} || '性、' || {_W[1]} || '性' || {_W[2]} || {_W[3]} WHEN 1 THEN {_W[0]} || '与' || {_W[1]} || '的区别' WHEN 2 THEN '主要' || {_W[0]} || '方法'
 WHEN 3 THEN {_W[0]} || ' 理论：' || {_W[1]} || '，' || {_W[2]} || '；需掌握' || {_W[3]} WHEN 4 THEN {_W[0]} || '案例分析' ELSE '1.' || (doc_id % 9) || ' ' || {_W[0]} || ' ' || {_W[1]} || ' Ａ－Ｂ' END AS title FROM numbered))""",
    "chunks": f"""chunks AS (SELECT project, project AS doc, doc_id::VARCHAR AS chunk_id, idx AS position, idx + 1 AS page_start, idx + 1 + CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 0 END AS page_end,
 CASE WHEN doc_id % 7 <> 6 THEN head END AS chapter_title, CASE WHEN doc_id % 3 = 0 THEN lang END AS section_title, CASE WHEN idx % 5 = 0 THEN head || chr(10) || text ELSE text END AS content
 FROM (SELECT *, '第' || ((idx // 5) % 12 + 1) || '章 ' || {_WORD}[1] AS head FROM numbered))""",
    "uploads": """uploads AS (SELECT o_orderkey AS doc_id, o_custkey % 40 AS workspace_id, o_custkey % 200 AS project_id, CASE WHEN o_custkey % 10 = 0 THEN 'owner' ELSE 'public' END AS role,
 CASE WHEN o_orderkey % 5 = 0 THEN 'outline' ELSE 'course_material' END AS kind, CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 3 = 1 THEN 'completed' ELSE 'interrupted' END AS status,
 floor(o_totalprice)::BIGINT % 400 + 1 AS total_pages, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT % 400 + 1 END AS quota_pages, left(o_orderpriority, 1)::INT AS queue_priority, o_orderdate AS accepted_at,
 CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS quota_released_at, o_orderkey % 13 AS processed_pages, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS object_key,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 10 MINUTE END AS lease_expires_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 17 END AS lease_owner,
 'file' || o_orderkey || CASE o_orderkey % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' ELSE '.pdf' END AS name FROM orders)""",
    "items": """items AS (SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS position, l_orderkey % 200 AS project_id, 'topic ' || l_partkey AS item, 'chapter ' || (l_suppkey % 9) AS chapter,
 CASE WHEN l_suppkey % 3 = 0 THEN 'topic ' || l_suppkey END AS parent_item, CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'A' THEN 'failed' ELSE 'pending' END ELSE 'succeeded' END AS status,
 CASE WHEN l_returnflag = 'A' THEN ['unmatched', 'schema_validation', 'generation_error', 'format_warning'][l_partkey % 4 + 1] END AS failure_type, CASE WHEN l_returnflag = 'A' THEN 'reason token=' || l_suppkey || ' tail' END AS reason, l_shipdate AS updated_at FROM lineitem)""",
    "page_events": """page_events AS (SELECT user_id AS doc_id, event_id % 40 + 1 AS page_number, event_id % 3 AS attempt_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'processing' ELSE 'completed' END AS status,
 CASE event_type WHEN 'view' THEN 'ocr' ELSE 'text' END AS method, props AS text, ts, event_id FROM events)""",
    "material": f"""material AS (SELECT conv_id // 40 AS project, (conv_id // 10) % 4 AS chapter, conv_id AS point, turn // 3 AS bullet, ['original', 'recitation', 'keywords'][turn % 3 + 1] AS kind,
 left(string_split(string_split(text, chr(10))[1], ' ')[1], {TITLE_LETTERS}) AS title, text AS content, turn, role FROM conversations)""",
    "whole_material": """material AS (SELECT conv_id % 10 AS project, (conv_id // 10) % 4 AS chapter, conv_id AS point, turn // 3 AS bullet, ['original', 'recitation', 'keywords'][turn % 3 + 1] AS kind,
 string_split(string_split(text, chr(10))[1], ' ')[1] AS title, text AS content, turn, role FROM conversations)""",
}
_NEEDS = {"chunks": ["numbered"], "topics": ["numbered"]}


def with_views(*names: str) -> str:
    out: list[str] = []
    for n in names:
        for x in (*_NEEDS.get(n, ()), n):
            if VIEWS[x] not in out:
                out.append(VIEWS[x])
    return "WITH " + ", ".join(out)
