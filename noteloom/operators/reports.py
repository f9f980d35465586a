"""Operational reports over jobs, items, uploads and page logs, for all projects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Config

TERMINAL = ("succeeded", "failed")
ACTIVE = ("queued", "processing")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("rank__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank__ = 1").drop("rank__")


def page_counts(pages: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return pages.groupBy("doc_id").agg(
        is_("completed").alias("completed"), is_("failed").alias("failed"), is_("processing").alias("processing"), F.count_if((F.col("status") == "completed") & (F.col("method") == "ocr")).alias("ocr_completed")
    )


def active_documents(uploads: DataFrame) -> DataFrame:
    return uploads.where(F.col("status").isin(*ACTIVE)).groupBy("workspace_id").agg(F.count("*").alias("active"))


def rolling_pages(uploads: DataFrame, cutoff: Column) -> DataFrame:
    """Pages of public documents accepted since the cutoff and not released, of each workspace and of all (null)."""
    counted = (F.col("role") == "public") & (F.col("accepted_at") >= cutoff) & F.col("quota_released_at").isNull()
    pages = F.coalesce(F.sum(F.when(counted, F.col("quota_pages"))), F.lit(0)).cast("long").alias("pages")
    return uploads.rollup("workspace_id").agg(pages)


def job_progress(items: DataFrame) -> DataFrame:
    done, total = F.count_if(F.col("status").isin(*TERMINAL)), F.count("*")
    return items.groupBy("job_id").agg(
        total.alias("total"), done.alias("processed"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.least(F.lit(95), 20 + F.floor(75 * done / F.greatest(total, F.lit(1)))).alias("progress"),
    )


def failure_summary(items: DataFrame) -> DataFrame:
    counts = items.where("status = 'failed'").groupBy("job_id", "failure_type").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws("=", "failure_type", F.col("n").cast("string"))))
    return items.select("job_id").distinct().join(counts.groupBy("job_id").agg(F.array_join(parts, ", ").alias("s")), "job_id", "left").select("job_id", F.coalesce("s", F.lit("none")).alias("summary"))


def failures_and_warnings(items: DataFrame) -> DataFrame:
    """Arrays of positions and items in order: blocking failures, and warnings."""
    one = F.struct("position", "item", "failure_type")
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, one)))
    warning = F.col("failure_type") == "format_warning"
    return items.groupBy("job_id").agg(pick(F.col("failure_type").isNotNull() & ~warning).alias("failures"), pick(warning).alias("warnings"))


def final_status(items: DataFrame) -> DataFrame:
    """Null while an item is open."""
    ok, bad = F.count_if(F.col("status") == "succeeded"), F.count_if(F.col("status") == "failed")
    open_ = F.count_if(~F.col("status").isin(*TERMINAL))
    return items.groupBy("job_id").agg(F.when(open_ > 0, None).when(ok == 0, "failed").when(bad > 0, "partial_failed").otherwise("completed").alias("final_status"))


def failure_counts(items: DataFrame, kind: Column) -> DataFrame:
    kinds = ("unmatched", "schema_validation", "generation_error", "format_warning")
    failing = F.col("failure_type").isNotNull()
    n = [F.count_if(failing & (kind == k)).alias(k) for k in kinds]
    blocking = F.count_if(failing & (kind != "format_warning"))
    return items.groupBy("job_id").agg(*n, F.greatest(F.lit(0), F.count("*") - blocking).alias("successful"))


def parse_summary(pages: DataFrame) -> DataFrame:
    done = pages.where("status = 'completed'")
    ocr = F.count_if(F.col("method") == "ocr")
    return done.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), ocr.alias("ocr_page_count"), (ocr > 0).alias("ocr_executed"), (ocr == F.count("*")).alias("is_scanned"),
        F.when(ocr == F.count("*"), "ocr").when(ocr > 0, "mixed").otherwise("text").alias("parser"),
    )


def latest_activity(jobs: DataFrame, items: DataFrame) -> DataFrame:
    last = items.groupBy("job_id").agg(F.max("updated_at").alias("item_at"))
    return jobs.join(last, "job_id", "left").select("job_id", F.greatest("started_at", "item_at").alias("active_at"))


def stale_jobs(activity: DataFrame, now: Column, config: Config = CONFIG) -> DataFrame:
    age = now.cast("long") - F.col("active_at").cast("timestamp").cast("long")
    return activity.select("job_id", F.coalesce(age >= config.stale_seconds, F.lit(False)).alias("stale"))


def run_report(states: DataFrame, focus: dict[str, str]) -> DataFrame:
    """One row for each job: how many items matched, found a chapter and are valid, and those whose title holds a focus term.

    states: job_id, position, item, failure_type, content_matched, chapter_resolved, generation_valid.
    """
    from ..functions import text as T

    counts = [
        F.count("*").alias("total"), F.count_if("content_matched").alias("content_matched"), F.count_if(~F.col("content_matched")).alias("content_unmatched"), F.count_if("chapter_resolved").alias("chapter_resolved"),
        F.count_if(~F.col("chapter_resolved")).alias("chapter_unresolved"), F.count_if("generation_valid").alias("generation_valid"), F.count_if(F.col("failure_type") == "schema_validation").alias("schema_failures"),
    ]
    named = lambda term: F.contains(T.title_key(F.col("item")), T.title_key(F.lit(term)))
    found = [F.transform(F.array_sort(F.collect_list(F.when(named(term), F.struct("position", "item")))), lambda x: x["item"]).alias(name) for name, term in focus.items()]
    return states.groupBy("job_id").agg(*counts, *found)


def queue_positions(uploads: DataFrame) -> DataFrame:
    """Places are counted in steps: totals of priority and day first, so that no task ranks the whole queue."""
    queued = uploads.where("status = 'queued'").withColumn("day", F.to_date("accepted_at"))
    sizes = queued.groupBy("queue_priority", "day").agg(F.count("*").alias("n"))
    before = Window.partitionBy("queue_priority").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    priorities = queued.groupBy("queue_priority").agg(F.count("*").alias("all"))
    lower = priorities.alias("a").join(priorities.alias("b"), F.col("b.queue_priority") < F.col("a.queue_priority"), "left").groupBy(F.col("a.queue_priority").alias("p")).agg(F.coalesce(F.sum("b.all"), F.lit(0)).alias("lower"))
    starts = sizes.select(F.col("queue_priority").alias("p"), F.col("day").alias("d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")).join(lower, "p")
    within = F.row_number().over(Window.partitionBy("queue_priority", "day").orderBy("accepted_at", "doc_id"))
    ranked = queued.withColumn("rank", within)
    return ranked.join(starts, (ranked["queue_priority"] == starts["p"]) & (ranked["day"] == starts["d"])).select("doc_id", (F.col("rank") + F.col("begin") + F.col("lower")).alias("position"))


def next_in_queue(uploads: DataFrame, n: int) -> DataFrame:
    eligible = uploads.where((F.col("status") == "queued") & F.col("object_key").isNotNull())
    return eligible.orderBy("queue_priority", "accepted_at", "doc_id").limit(n)


def rolling_day_pages(uploads: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Pages accepted in the 24 hours up to each acceptance, of its workspace, and whether that is over the limit."""
    counted = uploads.where((F.col("role") == "public") & F.col("quota_released_at").isNull())
    day = Window.partitionBy("workspace_id").orderBy(F.col("accepted_at").cast("timestamp").cast("long")).rangeBetween(-86400, 0)
    return counted.select("doc_id", "workspace_id", F.sum("quota_pages").over(day).alias("day_pages")).withColumn("over_limit", F.col("day_pages") > config.workspace_pages)


def total_day_pages(uploads: DataFrame, config: Config = CONFIG) -> DataFrame:
    """The same over all workspaces, exactly: whole hours in between as sums, and rank sums inside the two hours at the ends.

    Every window holds the acceptances of one hour, so no task orders the whole log.
    """
    counted = uploads.where((F.col("role") == "public") & F.col("quota_released_at").isNull())
    at = F.col("accepted_at").cast("timestamp").cast("long")
    rows = counted.select("doc_id", at.alias("at"), F.col("quota_pages").alias("pages"))
    hour = F.floor(F.col("at") / 3600)
    events = rows.select("doc_id", "at", "pages", hour.alias("hour"), F.lit(False).alias("begin"))
    begins = rows.select("doc_id", (F.col("at") - 86400).alias("at"), F.lit(0).alias("pages"), (hour - 24).alias("hour"), F.lit(True).alias("begin"))
    own = Window.partitionBy("hour").orderBy("at")
    both = events.unionByName(begins).withColumn("upto", F.sum("pages").over(own.rangeBetween(Window.unboundedPreceding, 0))).withColumn("from", F.sum("pages").over(own.rangeBetween(0, Window.unboundedFollowing)))
    ends = both.groupBy("doc_id").agg(F.sum(F.when(F.col("begin"), F.col("from")).otherwise(F.col("upto"))).alias("ends"), F.max("hour").alias("hour"))
    hours = events.groupBy("hour").agg(F.sum("pages").alias("pages"))
    between = hours.select(F.explode(F.sequence(F.col("hour") + 1, F.col("hour") + 23)).alias("hour"), "pages").groupBy("hour").agg(F.sum("pages").alias("between"))
    total = F.col("ends") + F.coalesce("between", F.lit(0))
    return ends.join(between, "hour", "left").select("doc_id", total.alias("day_pages"), (total > config.total_pages).alias("over_limit"))


def status_history(log: DataFrame) -> DataFrame:
    """Statuses of each document in order, without repeats in a row."""
    order = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    changed = log.withColumn("before", F.lag("status").over(order)).where("before is null or before != status")
    one = F.array_sort(F.collect_list(F.struct("ts", "event_id", "status")))
    return changed.groupBy("doc_id").agg(F.transform(one, lambda x: x["status"]).alias("history"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return first_by(df, keys, *order)


#: States of a document that set a project without uploads to processing.
UNDER_WAY = ("uploaded", "queued", "processing", "parsing", "interrupted", "parsed")


def project_status(projects: DataFrame, uploads: DataFrame, with_chapters: DataFrame) -> DataFrame:
    """project_status of each project with course material: its own, unless it has no chapters and its latest material failed or is the first under way."""
    course = latest(uploads.where("kind = 'course_material'"), ["project_id"], F.desc("accepted_at"), F.desc("doc_id")).select("project_id", F.col("status").alias("document"))
    j = projects.select("project_id", "status").join(course, "project_id").join(with_chapters.select("project_id", F.lit(True).alias("has")), "project_id", "left")
    begins = (F.col("status") == "not_uploaded") & F.col("document").isin(*UNDER_WAY)
    status = F.when(F.col("has"), F.col("status")).when(F.col("document") == "failed", "failed").when(begins, "processing").otherwise(F.col("status"))
    return j.select("project_id", status.alias("project_status"))


def resumable(uploads: DataFrame, now: Column, config: Config = CONFIG) -> DataFrame:
    """Failed and interrupted documents with the reason that keeps them from resuming, or ok."""
    busy = active_documents(uploads)
    used = rolling_pages(uploads, now - F.expr("INTERVAL 24 HOURS")).where("workspace_id is not null")
    j = uploads.where(F.col("status").isin("failed", "interrupted")).join(busy, "workspace_id", "left").join(used, "workspace_id", "left")
    fits = (F.col("role") == "owner") | F.col("quota_released_at").isNull() | (F.coalesce("pages", F.lit(0)) + F.col("quota_pages") <= config.workspace_pages)
    return j.select("doc_id", F.when(F.col("object_key").isNull(), "no_object").when(F.coalesce("active", F.lit(0)) > 0, "busy").when(~fits, "quota").otherwise("ok").alias("reason"))


def missing_pages(uploads: DataFrame, log: DataFrame) -> DataFrame:
    """Pages of each document without a completed row, and the first of them.

    Only the different completed pages of a document meet its number of pages; the missing ones are counted, not made.
    """
    done = log.where("status = 'completed' and page_number >= 1").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("page_number").cast("long"))).alias("done"))
    own = F.filter(F.coalesce("done", F.array().cast("array<long>")), lambda p: p <= F.col("total_pages"))
    each = uploads.select("doc_id", "total_pages").join(done, "doc_id", "left").select("doc_id", "total_pages", own.alias("own"))
    # in a sorted array of different pages, those before the first missing one stand at their own place
    gap = F.size(F.filter("own", lambda p, i: p == i + 1)).cast("long") + 1
    missing = each.select("doc_id", (F.col("total_pages") - F.size("own")).cast("long").alias("missing"), gap.alias("resume_at")).where("missing > 0")
    return missing.groupBy("doc_id").agg(F.sum("missing").alias("missing"), F.min("resume_at").alias("resume_at"))


def current_attempts(results: DataFrame, owners: DataFrame) -> DataFrame:
    """Every result with accepted, or the reason for which it is refused."""
    j = results.join(owners, "doc_id", "left")
    reason = F.when(F.col("lease_owner").isNull(), "no_lease").when(F.col("attempt_id") != F.col("lease_owner"), "stale_attempt").when(F.col("status") == "processing", "wrong_status").otherwise("accepted")
    return j.select("event_id", "doc_id", "page_number", reason.alias("verdict"))


def reuse_checkpoints(before: DataFrame, now: DataFrame) -> DataFrame:
    """Jobs whose list of (position, item, chapter, parent) is unchanged, with how many results are reused."""
    keys = ["position", "item", "chapter", "parent_item"]
    a, b = before.select("job_id", *keys, F.col("status").alias("old_status")).alias("a"), now.select("job_id", *keys).alias("b")
    on = (F.col("a.job_id") == F.col("b.job_id")) & (F.col("a.position") == F.col("b.position"))
    j = a.join(b, on, "full")
    same = F.col("a.job_id").isNotNull() & F.col("b.job_id").isNotNull()
    for k in keys[1:]:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return j.groupBy(F.coalesce("a.job_id", "b.job_id").alias("job_id")).agg(F.bool_and(same).alias("reusable"), F.count_if(F.col("old_status") == "succeeded").alias("results"))


def scope_to_workspace(items: DataFrame, uploads: DataFrame, workspace: int) -> DataFrame:
    projects = uploads.where(F.col("workspace_id") == workspace).select("project_id").distinct()
    return items.join(projects, "project_id", "left_semi")


def upsert_pages(log: DataFrame) -> DataFrame:
    """One row for each page: the first completed one, else the first; replays change nothing."""
    order = (F.desc(F.col("status") == "completed"), F.col("ts"), F.col("event_id"))
    tries = F.count_if(F.col("status") == "failed").over(Window.partitionBy("doc_id", "page_number"))
    return first_by(log.withColumn("retry_count", tries), ["doc_id", "page_number"], *order)


def superseded_jobs(jobs: DataFrame) -> DataFrame:
    """Active jobs of a project but the newest."""
    w = Window.partitionBy("project_id").orderBy(F.desc("started_at"), F.desc("job_id"))
    return jobs.where(F.col("status").isin(*ACTIVE)).withColumn("n", F.row_number().over(w)).where("n > 1").drop("n")
