"""Queries of operational reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import reports as R
from ..sources import tables as t
from .registry import query

U, I, L = t.with_views("uploads"), t.with_views("items"), t.with_views("page_events")
NOW_SQL = "TIMESTAMP '1999-06-01'"
JOBS_SQL = "jobs AS (SELECT doc_id AS job_id, project_id, status, accepted_at AS started_at FROM uploads)"


def now():
    return F.to_timestamp(F.lit("1999-06-01"))


def jobs(spark, d):
    return t.uploads(spark, d).select(F.col("doc_id").alias("job_id"), "project_id", "status", F.col("accepted_at").alias("started_at"))


@query(f"{L} SELECT doc_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed' AND method = 'ocr') AS ocr_completed FROM page_events GROUP BY doc_id")
def d01_page_counts(spark, d):
    return R.page_counts(t.page_events(spark, d))


@query(f"{U} SELECT workspace_id, count(*) AS active FROM uploads WHERE status IN ('queued', 'processing') GROUP BY 1")
def d02_active_documents(spark, d):
    return R.active_documents(t.uploads(spark, d))


@query(f"{U} SELECT workspace_id, coalesce(sum(quota_pages) FILTER (role = 'public' AND accepted_at >= {NOW_SQL} - INTERVAL 24 HOUR AND quota_released_at IS NULL), 0)::BIGINT AS pages FROM uploads GROUP BY ROLLUP (workspace_id)")
def d03_rolling_pages(spark, d):
    return R.rolling_pages(t.uploads(spark, d), now() - F.expr("INTERVAL 24 HOURS"))


@query(f"{I} SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('succeeded', 'failed')) AS processed, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, least(95, 20 + floor(75 * count(*) FILTER (status IN ('succeeded', 'failed')) / greatest(count(*), 1)))::BIGINT AS progress FROM items GROUP BY job_id")
def d04_job_progress(spark, d):
    return R.job_progress(t.items(spark, d))


@query(f"{I}, c AS (SELECT job_id, failure_type, count(*) AS n FROM items WHERE status = 'failed' GROUP BY 1, 2), s AS (SELECT job_id, string_agg(failure_type || '=' || n, ', ' ORDER BY failure_type || '=' || n) AS s FROM c GROUP BY 1) SELECT i.job_id, coalesce(s, 'none') AS summary FROM (SELECT DISTINCT job_id FROM items) i LEFT JOIN s USING (job_id)")
def d05_failure_summary(spark, d):
    return R.failure_summary(t.items(spark, d))


@query(f"{I} SELECT job_id, coalesce(list(position || ':' || item || ':' || failure_type ORDER BY position) FILTER (failure_type <> 'format_warning'), []) AS failures, coalesce(list(position || ':' || item || ':' || failure_type ORDER BY position) FILTER (failure_type = 'format_warning'), []) AS warnings FROM items GROUP BY job_id")
def d06_failure_arrays(spark, d):
    flat = lambda c: F.transform(c, lambda x: F.concat_ws(":", x["position"].cast("string"), x["item"], x["failure_type"]))
    return R.failures_and_warnings(t.items(spark, d)).select("job_id", flat("failures").alias("failures"), flat("warnings").alias("warnings"))


@query(f"{I} SELECT job_id, CASE WHEN count(*) FILTER (status NOT IN ('succeeded', 'failed')) > 0 THEN NULL WHEN count(*) FILTER (status = 'succeeded') = 0 THEN 'failed' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial_failed' ELSE 'completed' END AS final_status FROM items GROUP BY job_id")
def d07_final_status(spark, d):
    return R.final_status(t.items(spark, d))


@query(f"{I} SELECT job_id, count(*) FILTER (failure_type = 'unmatched') AS unmatched, count(*) FILTER (failure_type = 'schema_validation') AS schema_validation, count(*) FILTER (failure_type = 'generation_error') AS generation_error, count(*) FILTER (failure_type = 'format_warning') AS format_warning, greatest(0, count(*) - count(*) FILTER (failure_type <> 'format_warning')) AS successful FROM items GROUP BY job_id")
def d08_failure_counts(spark, d):
    return R.failure_counts(t.items(spark, d), P.failure_kind(F.col("failure_type"), F.col("reason")))


@query(f"{L} SELECT doc_id, count(*) AS page_count, count(*) FILTER (method = 'ocr') AS ocr_page_count, count(*) FILTER (method = 'ocr') > 0 AS ocr_executed, count(*) FILTER (method = 'ocr') = count(*) AS is_scanned, CASE WHEN count(*) FILTER (method = 'ocr') = count(*) THEN 'ocr' WHEN count(*) FILTER (method = 'ocr') > 0 THEN 'mixed' ELSE 'text' END AS parser FROM page_events WHERE status = 'completed' GROUP BY doc_id")
def d09_parse_summary(spark, d):
    return R.parse_summary(t.page_events(spark, d))


REPORT = f"""n AS (SELECT *, coalesce(status = 'succeeded' OR failure_type = 'format_warning', false) AS content, chapter <> 'chapter 0' AS resolved, coalesce(failure_type NOT IN ('schema_validation', 'generation_error', 'unmatched'), true) AND status = 'succeeded' AS ok FROM items)"""


@query(f"{t.with_views('items')}, {REPORT} SELECT job_id, count(*) AS total, count(*) FILTER (content) AS content_matched, count(*) FILTER (NOT content) AS content_unmatched, count(*) FILTER (resolved) AS chapter_resolved, count(*) FILTER (NOT resolved) AS chapter_unresolved, count(*) FILTER (ok) AS generation_valid, count(*) FILTER (failure_type = 'schema_validation') AS schema_failures, coalesce(list(item ORDER BY position) FILTER (contains(item, 'topic 1')), []) AS focus_topic_1, coalesce(list(item ORDER BY position) FILTER (contains(item, '99')), []) AS focus_99 FROM n GROUP BY 1")
def d16_run_report(spark, d):
    """Of every job: what matched, resolved and is valid, and the items of two topics in focus."""
    i = t.items(spark, d)
    states = i.select("job_id", "position", "item", "failure_type", ((F.col("status") == "succeeded") | F.coalesce(F.col("failure_type") == "format_warning", F.lit(False))).alias("content_matched"), (F.col("chapter") != "chapter 0").alias("chapter_resolved"),
        ((F.col("status") == "succeeded") & F.coalesce(~F.col("failure_type").isin("schema_validation", "generation_error", "unmatched"), F.lit(True))).alias("generation_valid"))
    return R.run_report(states, {"focus_topic_1": "topic 1", "focus_99": "99"})


ACTIVITY = f"{t.with_views('uploads', 'items')}, {JOBS_SQL}, a AS (SELECT j.job_id, greatest(started_at, item_at) AS active_at FROM jobs j LEFT JOIN (SELECT job_id, max(updated_at) AS item_at FROM items GROUP BY 1) USING (job_id))"


@query(f"{ACTIVITY} SELECT job_id, active_at FROM a")
def d17_latest_activity(spark, d):
    return R.latest_activity(jobs(spark, d), t.items(spark, d))


@query(f"{ACTIVITY} SELECT job_id, coalesce(epoch({NOW_SQL}) - epoch(active_at) >= 1200, false) AS stale FROM a")
def b18_stale_jobs(spark, d):
    return R.stale_jobs(R.latest_activity(jobs(spark, d), t.items(spark, d)), now())


@query(f"{U} SELECT doc_id, row_number() OVER (ORDER BY queue_priority, accepted_at, doc_id) AS position FROM uploads WHERE status = 'queued'")
def e02_queue_position(spark, d):
    return R.queue_positions(t.uploads(spark, d))


@query(f"{U} SELECT doc_id, workspace_id, sum(quota_pages) OVER w::BIGINT AS day_pages, sum(quota_pages) OVER w > 1200 AS over_limit FROM uploads WHERE role = 'public' AND quota_released_at IS NULL WINDOW w AS (PARTITION BY workspace_id ORDER BY accepted_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)")
def e04_rolling_day_pages(spark, d):
    return R.rolling_day_pages(t.uploads(spark, d))


@query(f"{U}, k AS (SELECT doc_id, accepted_at + to_minutes((doc_id * 37) % 1440) AS accepted_at, quota_pages FROM uploads WHERE role = 'public' AND quota_released_at IS NULL) SELECT doc_id, sum(quota_pages) OVER w::BIGINT AS day_pages, sum(quota_pages) OVER w > 3000 AS over_limit FROM k WINDOW w AS (ORDER BY accepted_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)")
def e04_total_day_pages(spark, d):
    """Acceptances are dates here, so each gets a minute of its own."""
    u = t.uploads(spark, d)
    return R.total_day_pages(u.withColumn("accepted_at", F.col("accepted_at") + F.make_dt_interval(mins=((F.col("doc_id") * 37) % 1440).cast("int"))))


@query(f"{L}, c AS (SELECT *, lag(status) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS before FROM page_events) SELECT doc_id, list(status ORDER BY ts, event_id) AS history FROM c WHERE before IS NULL OR before <> status GROUP BY doc_id")
def e07_status_history(spark, d):
    return R.status_history(t.page_events(spark, d))


@query(f"{U} SELECT project_id, kind, doc_id, status FROM uploads QUALIFY row_number() OVER (PARTITION BY project_id, kind ORDER BY accepted_at DESC, doc_id DESC) = 1")
def e09_latest_per_group(spark, d):
    return R.latest(t.uploads(spark, d), ["project_id", "kind"], F.desc("accepted_at"), F.desc("doc_id")).select("project_id", "kind", "doc_id", "status")


@query(f"{U}, {JOBS_SQL} SELECT job_id, project_id FROM jobs WHERE status IN ('queued', 'processing') QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, job_id DESC) > 1")
def e12_superseded_jobs(spark, d):
    return R.superseded_jobs(jobs(spark, d)).select("job_id", "project_id")


@query(f"{U} SELECT workspace_id, doc_id FROM uploads WHERE status IN ('queued', 'processing') QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY accepted_at, doc_id) = 1")
def e12_active_document(spark, d):
    active = t.uploads(spark, d).where(F.col("status").isin(*R.ACTIVE))
    return R.first_by(active, ["workspace_id"], F.col("accepted_at"), F.col("doc_id")).select("workspace_id", "doc_id")


@query(f"{U} SELECT doc_id, queue_priority, accepted_at FROM uploads WHERE status = 'queued' AND object_key IS NOT NULL ORDER BY queue_priority, accepted_at, doc_id LIMIT 25")
def f04_next_in_queue(spark, d):
    return R.next_in_queue(t.uploads(spark, d), 25).select("doc_id", "queue_priority", "accepted_at")


@query(f"{U} SELECT doc_id FROM uploads WHERE status IN ('queued', 'processing') ORDER BY accepted_at, doc_id LIMIT 1")
def f05_next_incomplete_job(spark, d):
    return t.uploads(spark, d).where(F.col("status").isin(*R.ACTIVE)).orderBy("accepted_at", "doc_id").limit(1).select("doc_id")


@query(f"{U} SELECT project_id, max(accepted_at) AS updated_at, count(*) AS documents FROM uploads GROUP BY 1 ORDER BY 2 DESC")
def f06_list_projects(spark, d):
    return t.uploads(spark, d).groupBy("project_id").agg(F.max("accepted_at").alias("updated_at"), F.count("*").alias("documents")).orderBy(F.desc("updated_at"))


STATUS = "s AS (SELECT project_id, status FROM uploads WHERE kind = 'course_material' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY accepted_at DESC, doc_id DESC) = 1)"


@query(f"{t.with_views('uploads', 'items')}, {STATUS}, c AS (SELECT DISTINCT project_id FROM items WHERE status = 'succeeded' AND job_id % 5 = 0), z AS (SELECT project_id, CASE WHEN c.project_id IS NOT NULL THEN project_id % 4 WHEN status = 'failed' THEN 5 WHEN project_id % 4 = 0 AND status IN ('uploaded', 'queued', 'processing', 'parsing', 'interrupted', 'parsed') THEN 6 ELSE project_id % 4 END AS code FROM s LEFT JOIN c USING (project_id)) SELECT project_id, ['not_uploaded', 'processing', 'completed', 'failed', NULL, 'failed', 'processing'][code + 1] AS project_status FROM z")
def b20_project_status(spark, d):
    done = t.items(spark, d).where("status = 'succeeded' and job_id % 5 = 0").select("project_id").distinct()
    own = t.uploads(spark, d).select("project_id").distinct().withColumn("status", F.element_at(F.array(*[F.lit(x) for x in ("not_uploaded", "processing", "completed", "failed")]), (F.col("project_id") % 4 + 1).cast("int")))
    return R.project_status(own, t.uploads(spark, d), done)


@query(f"{U}, b AS (SELECT workspace_id, count(*) AS active FROM uploads WHERE status IN ('queued', 'processing') AND workspace_id % 2 = 0 GROUP BY 1), p AS (SELECT workspace_id, coalesce(sum(quota_pages) FILTER (role = 'public' AND accepted_at >= {NOW_SQL} - INTERVAL 24 HOUR AND quota_released_at IS NULL), 0) AS pages FROM uploads GROUP BY 1) SELECT doc_id, CASE WHEN object_key IS NULL THEN 'no_object' WHEN coalesce(active, 0) > 0 THEN 'busy' WHEN NOT (role = 'owner' OR quota_released_at IS NULL OR coalesce(pages, 0) + quota_pages <= 1200) THEN 'quota' ELSE 'ok' END AS reason FROM uploads u LEFT JOIN b USING (workspace_id) LEFT JOIN p USING (workspace_id) WHERE status IN ('failed', 'interrupted')")
def b22_resumable(spark, d):
    """All uploads; those that are under way in odd workspaces count as completed, as else every workspace would be busy."""
    done = (F.col("workspace_id") % 2 == 1) & F.col("status").isin(*R.ACTIVE)
    return R.resumable(t.uploads(spark, d).withColumn("status", F.when(done, "completed").otherwise(F.col("status"))), now())


@query(f"{t.with_views('uploads', 'items')} SELECT job_id, position FROM items WHERE project_id IN (SELECT project_id FROM uploads WHERE workspace_id = 3)")
def c01_scope_to_workspace(spark, d):
    return R.scope_to_workspace(t.items(spark, d), t.uploads(spark, d), 3).select("job_id", "position")


@query(f"{I}, n AS (SELECT * REPLACE (CASE WHEN job_id % 5 = 0 AND position = 2 THEN 'changed' ELSE item END AS item) FROM items WHERE NOT (job_id % 7 = 0 AND position = 1)), j AS (SELECT coalesce(a.job_id, b.job_id) AS job_id, a.job_id IS NOT NULL AND b.job_id IS NOT NULL AND a.item IS NOT DISTINCT FROM b.item AND a.chapter IS NOT DISTINCT FROM b.chapter AND a.parent_item IS NOT DISTINCT FROM b.parent_item AS same, a.status FROM items a FULL JOIN n b ON a.job_id = b.job_id AND a.position = b.position) SELECT job_id, bool_and(same) AS reusable, count(*) FILTER (status = 'succeeded') AS results FROM j GROUP BY 1")
def c13_reuse_checkpoints(spark, d):
    before = t.items(spark, d)
    now = before.where("not (job_id % 7 = 0 and position = 1)").withColumn("item", F.when((F.col("job_id") % 5 == 0) & (F.col("position") == 2), "changed").otherwise(F.col("item")))
    return R.reuse_checkpoints(before, now)


@query(f"{t.with_views('uploads', 'page_events')}, w AS (SELECT doc_id, unnest(range(1, total_pages + 1)) AS page_number FROM uploads), m AS (SELECT * FROM w ANTI JOIN (SELECT * FROM page_events WHERE status = 'completed') USING (doc_id, page_number)) SELECT doc_id, count(*) AS missing, min(page_number) AS resume_at FROM m GROUP BY 1")
def c14_missing_pages(spark, d):
    return R.missing_pages(t.uploads(spark, d), t.page_events(spark, d))


@query(f"{t.with_views('uploads', 'page_events')} SELECT event_id, p.doc_id, page_number, CASE WHEN lease_owner IS NULL THEN 'no_lease' WHEN attempt_id <> lease_owner THEN 'stale_attempt' WHEN p.status = 'processing' THEN 'wrong_status' ELSE 'accepted' END AS verdict FROM page_events p LEFT JOIN (SELECT doc_id, lease_owner % 3 AS lease_owner FROM uploads) u USING (doc_id)")
def c16_current_attempts(spark, d):
    return R.current_attempts(t.page_events(spark, d), t.uploads(spark, d).select("doc_id", (F.col("lease_owner") % 3).alias("lease_owner")))


@query(f"{L} SELECT doc_id, page_number, event_id, status, count(*) FILTER (status = 'failed') OVER (PARTITION BY doc_id, page_number) AS retry_count FROM page_events QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY status = 'completed' DESC, ts, event_id) = 1")
def a09_upsert_pages(spark, d):
    return R.upsert_pages(t.page_events(spark, d)).select("doc_id", "page_number", "event_id", "status", "retry_count")


@query(f"{L} SELECT doc_id, page_number, text FROM page_events WHERE status = 'completed'")
def a01_scan_pages(spark, d):
    return t.page_events(spark, d).where("status = 'completed'").select("doc_id", "page_number", "text")


@query(f"{t.with_views('chunks', 'uploads')} SELECT c.project, chunk_id, page_start, position FROM chunks c WHERE split_part(c.project, ':', 1) IN (SELECT 'src' || (project_id % 20) FROM uploads WHERE kind = 'course_material')")
def a02_scan_chunks(spark, d):
    course = t.uploads(spark, d).where("kind = 'course_material'").select(F.concat(F.lit("src"), (F.col("project_id") % 20).cast("string")).alias("course")).distinct()
    return t.chunks(spark, d).withColumn("course", F.split_part("project", F.lit(":"), F.lit(1))).join(course, "course", "left_semi").select("project", "chunk_id", "page_start", "position")


FAILS = "SELECT project_id, position, left(item, 160) AS title, left(regexp_replace(coalesce(reason, '未提供失败原因'), '(?i)(?:sk-[A-Za-z0-9_-]{8,}|(?:password|secret|token|api[_ -]?key)\\s*[:=]\\s*\\S+)', '[敏感信息已隐藏]', 'g'), 500) AS reason"


@query(f"{t.with_views('uploads', 'items')}, {JOBS_SQL}, l AS (SELECT job_id FROM jobs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, job_id DESC) = 1) {FAILS} FROM items WHERE job_id IN (SELECT job_id FROM l) AND failure_type IS NOT NULL AND failure_type <> 'format_warning'")
def a11_failure_appendix(spark, d):
    from ..operators.material import failure_appendix

    return failure_appendix(jobs(spark, d), t.items(spark, d))
