"""Queries that run the streaming forms over the whole log and return what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import reports as R
from ..sources import tables as t
from ..sources.sinks import scratch
from ..streaming import flows as W
from .match_queries import passage_plans
from .registry import query

L = t.with_views("page_events")


def log(spark, d):
    return W.page_log(spark, f"{d}/events.parquet")


@query(f"{L} SELECT DISTINCT doc_id, page_number FROM page_events WHERE status = 'completed'")
def s01_stream_page_results(spark, d):
    return W.drain(W.page_results(log(spark, d), late="60 days")).select("doc_id", "page_number")


@query(f"{L} SELECT doc_id, page_number, arg_min(event_id, (status <> 'completed', ts, event_id)) AS event_id, bool_or(status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS retry_count FROM page_events GROUP BY 1, 2")
def a09_s01_stream_upsert_pages(spark, d):
    """Batches of the log are merged by page into a table, of which the first completed row wins however late it comes."""
    path = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    table, batches = W.page_batches(spark, path)
    W.drain(log(spark, d), batches=batches, path=path)
    return table.read().select("doc_id", "page_number", "event_id", (F.col("status") == "completed").alias("completed"), "retry_count")


@query(f"{L} SELECT doc_id, count(*) FILTER (status = 'completed') AS processed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'completed' AND method = 'ocr') AS ocr FROM page_events GROUP BY 1")
def s02_stream_progress(spark, d):
    return W.drain(W.progress(log(spark, d)), "complete")


@query(f"{L} SELECT doc_id, date_trunc('hour', ts) - to_hours(k) AS start, count(*) AS pages FROM page_events, (SELECT unnest(range(0, 24)) AS k) GROUP BY 1, 2")
def s03_stream_quota(spark, d):
    return W.drain(W.quota(log(spark, d)), "complete")


@query(f"{L} SELECT doc_id, date_trunc('day', ts) AS start, count(*) AS pages FROM page_events GROUP BY 1, 2")
def s03_stream_quota_tumbling(spark, d):
    return W.drain(W.quota(log(spark, d), slide=None), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""{L}, g AS (SELECT *, (lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1200000000)::INT AS new FROM page_events WINDOW w AS (PARTITION BY doc_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS n FROM g) SELECT doc_id, min(ts) AS start, count(*) AS events FROM s GROUP BY doc_id, n""")
def s04_stream_sessions(spark, d):
    return W.drain(W.sessions(log(spark, d)), "complete")


@query(f"{t.with_views('uploads', 'page_events')} SELECT event_id, p.doc_id, page_number, CASE WHEN lease_owner IS NULL THEN 'no_lease' WHEN attempt_id <> lease_owner THEN 'stale_attempt' WHEN p.status = 'processing' THEN 'wrong_status' ELSE 'accepted' END AS verdict FROM page_events p LEFT JOIN (SELECT doc_id, lease_owner % 3 AS lease_owner FROM uploads) u USING (doc_id)")
def s05_stream_attempt_filter(spark, d):
    owners = t.uploads(spark, d).select("doc_id", (F.col("lease_owner") % 3).alias("lease_owner"))
    return W.drain(W.attempt_verdicts(log(spark, d), owners))


@query(f"{L}, c AS (SELECT *, lag(status) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS before FROM page_events) SELECT doc_id, status, count(*) AS n FROM c WHERE before IS NULL OR before <> status GROUP BY 1, 2")
def s06_stream_status_history(spark, d):
    return W.drain(W.status_changes(log(spark, d), lease="60 days"), "update").groupBy("doc_id", "status").agg(F.count("*").alias("n"))


@query(f"{L} SELECT doc_id, min(page_number) AS resume_at FROM (SELECT doc_id, unnest(range(1, 41)) AS page_number FROM (SELECT DISTINCT doc_id FROM page_events) ) ANTI JOIN (SELECT doc_id, page_number FROM page_events WHERE status = 'completed') USING (doc_id, page_number) GROUP BY 1")
def s07_resume_point(spark, d):
    """From the pages that a stream has written, where each document goes on."""
    done = W.drain(W.page_results(log(spark, d), late="60 days")).withColumn("status", F.lit("completed"))
    docs = t.page_events(spark, d).select("doc_id").distinct().withColumn("total_pages", F.lit(40).cast("long"))
    return R.missing_pages(docs, done).select("doc_id", "resume_at")


@query()
def s08_stream_match(spark, d):
    """Documents arrive as a stream of chunks and meet the plans of topics and benchmark passages."""
    path = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    stream = W.parquet_stream(spark, f"{d}/documents.parquet")
    no = F.lit(None).cast("string")
    chunks = stream.select(F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / t.PROJECT_IDS).cast("string")).alias("project"), F.col("doc_id").cast("string").alias("chunk_id"), no.alias("chapter_title"), no.alias("section_title"), F.col("text").alias("content"), F.col("doc_id").alias("page_start"), F.col("doc_id").alias("page_end"))
    table, batches = W.match_batches(passage_plans(spark, d), path)
    W.drain(chunks, batches=batches, path=path)
    return M.top_candidates(table.read()).select("project", "idx", "q_no", "chunk_id", "score", "stage")
