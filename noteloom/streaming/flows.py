"""Structured Streaming forms of the page and job flows.

Each function takes and returns streaming DataFrames (page logs have doc_id, page_number, attempt_id, status, method,
ts).  Late rows are dropped behind the watermark.  Queries resume from their checkpoint after a failure.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import CONFIG, Config
from ..operators import matching
from ..sources import tables
from ..sources.sinks import scratch, written
from ..sources.versions import VersionedTable

LATE = "1 hour"


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of ``path``, a folder or a single file: as a pattern, since a plain path must be a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def page_log(spark: SparkSession, path: str) -> DataFrame:
    raw = parquet_stream(spark, path)
    return tables.as_page_events(raw).withColumn("ts", F.col("ts").cast("timestamp"))


def page_results(log: DataFrame, late: str = LATE) -> DataFrame:
    """One completed result for each page; replays within the watermark are ignored."""
    return log.where("status = 'completed'").withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id", "page_number"])


def progress(log: DataFrame) -> DataFrame:
    """Running counts of each document; update or complete mode."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return log.groupBy("doc_id").agg(is_("completed").alias("processed"), is_("failed").alias("failed"), F.count_if((F.col("status") == "completed") & (F.col("method") == "ocr")).alias("ocr"))


def quota(log: DataFrame, slide: str | None = "1 hour", late: str = LATE) -> DataFrame:
    """Pages of each document's owner in windows of a day."""
    day = F.window("ts", "24 hours", slide) if slide else F.window("ts", "24 hours")
    return log.withWatermark("ts", late).groupBy("doc_id", day).agg(F.count("*").alias("pages")).select("doc_id", F.col("window.start").alias("start"), "pages")


def sessions(log: DataFrame, config: Config = CONFIG, late: str = LATE) -> DataFrame:
    """Runs of activity that end after a gap of stale_seconds."""
    run = F.session_window("ts", f"{config.stale_seconds} seconds")
    return log.withWatermark("ts", late).groupBy("doc_id", run).agg(F.count("*").alias("events")).select("doc_id", F.col("session_window.start").alias("start"), "events")


def attempt_verdicts(log: DataFrame, owners: DataFrame) -> DataFrame:
    """Each row with accepted or the reason for refusing it; owners: doc_id, lease_owner (static, reread for each batch)."""
    from ..operators.reports import current_attempts

    return current_attempts(log, owners)


def status_changes(log: DataFrame, lease: str = LATE) -> DataFrame:
    """doc_id, status, ts whenever a document's status changes; failed once its lease runs out without news."""
    lease_ms = int(pd.Timedelta(lease).total_seconds() * 1000)

    def changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if last == "processing":
                yield pd.DataFrame({"doc_id": [key[0]], "status": ["failed"], "ts": [pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        before = rows["status"].shift(1, fill_value=last if last is not None else "")
        state.update((rows["status"].iloc[-1],))
        end = int(rows["ts"].iloc[-1].timestamp() * 1000) + lease_ms
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[rows["status"] != before, ["doc_id", "status", "ts"]]

    grouped = log.withWatermark("ts", LATE).groupBy("doc_id")
    return grouped.applyInPandasWithState(changes, "doc_id long, status string, ts timestamp", "status string", "update", GroupStateTimeout.EventTimeTimeout)


BUCKETS = 16


def merge_batches(table: VersionedTable, merge: Callable[[DataFrame | None, DataFrame], DataFrame], keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: ``merge`` of the rows that the table has in the buckets of the batch's keys, and the batch, replaces them.

    The table's part is ``bucket``.  The batch's number is in the ledger of the version that it makes, so a batch that comes
    again after a failure changes nothing, and a failure before the version stands leaves the table as it was.
    """

    def run(batch: DataFrame, number: int) -> None:
        version = table.version()
        if table.ledger(version).get("batch", -1) >= number:
            return
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            old = table.read(version, new.select("bucket"))
            table.replace(merge(old, new), ledger={"batch": number}, expected=version)
        finally:
            new.unpersist()

    return run


def page_batches(spark: SparkSession, path: str, buckets: int = BUCKETS) -> tuple[VersionedTable, Callable[[DataFrame, int], None]]:
    """A table with one row for each page, the first completed one whenever it came, without a bound in time; and what keeps it by batches.

    Rows are those of upsert_pages over the whole log so far; retry_count adds up.
    """
    table = VersionedTable(spark, path, "bucket")

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = new.withColumn("tries", (F.col("status") == "failed").cast("long"))
        if old is not None:
            rows = old.withColumnRenamed("retry_count", "tries").unionByName(rows)
        page = Window.partitionBy("doc_id", "page_number")
        order = page.orderBy(F.desc(F.col("status") == "completed"), "ts", "event_id")
        return rows.withColumns({"retry_count": F.sum("tries").over(page), "n": F.row_number().over(order)}).where("n = 1").drop("n", "tries")

    return table, merge_batches(table, merge, ["doc_id"], buckets)


def match_batches(plans: DataFrame, path: str, config: Config = CONFIG, buckets: int = BUCKETS, form: str = "matrix") -> tuple[VersionedTable, Callable[[DataFrame, int], None]]:
    """A table of running candidates, and what keeps it by batches of new chunks.

    Of each query and stage it holds the best ``candidates`` so far, which is what any later choice among all of them can
    need: top_candidates of it is the batch form over the chunks so far.
    """
    queries = written(matching.retrieval_queries(plans), "queries")
    table = VersionedTable(plans.sparkSession, path, "bucket")
    columns = [c.split()[0] for c in matching.CANDIDATE.split(", ")]

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = new if old is None else old.unionByName(new)
        n = F.row_number().over(Window.partitionBy("project", "idx", "q_no", "stage").orderBy(F.desc("score"), "page_start", "chunk_id"))
        return rows.withColumn("n", n).where(F.col("n") <= config.candidates).drop("n")

    keep = merge_batches(table, merge, ["project", "idx", "q_no"], buckets)

    def run(chunks: DataFrame, number: int) -> None:
        keep(matching.scored_pairs(queries, chunks, config, form).select(*columns), number)

    return table, run


def drain(stream: DataFrame, mode: str = "append", batches: Callable[[DataFrame, int], None] | None = None, path: str | None = None) -> DataFrame | None:
    """Runs the stream over what there is and returns the sink's rows; the checkpoint lies beside it.  ``batches`` keep tables of their own."""
    spark = stream.sparkSession
    path = path or f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    write = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-state")
    if batches:
        write = write.foreachBatch(batches)
    elif mode == "append":
        write = write.format("parquet").option("path", path)
    else:
        write = write.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={i}"))
    write.start().awaitTermination()
    if batches:
        return None
    out = spark.read.parquet(path)
    return out.drop("batch") if mode == "update" else out
