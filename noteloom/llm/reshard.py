"""Sharding: minimum-cost-flow resharding.

Rows leave their old shards for new ones so that row counts are at most one apart (law ``rows``) and the fewest bytes
move.  Spark counts the rows and bytes of blocks, one for each old shard and power-of-two size class.  The driver
solves the flow from blocks to new shards over these counts only: a row costs nothing where old and new shard are the
same and the mean size of its block elsewhere, so bytes are least over blocks; within a block the smallest rows go.
The solution is a table of transfers (block, ranks from and to, new shard, first slot), and each row finds its shard
and slot by its rank in its block.  Rows are shuffled once, whole, to the task that ranks their part of a block, and
written from there to the files of their new shards.

A layout is a folder with a manifest: which folder holds each shard.  ``rewrite_layout`` writes the shards that gained
or lost rows to a new folder, with a manifest that names the old folder for the others and leaves emptied shards out;
the old layout stays as it was, so a run that fails can be repeated.

Null text has no bytes, a null id is one of its own kind, rows that are equal in all columns are each placed and
written, ties in size are ranked by a hash of all columns, an empty table gives no rows, and the columns of the table
lie in a struct of their own, so their names don't matter.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hashable, row_key, shared_dir, whole_row

OLD_SHARDS, NEW_SHARDS = 32, 40
OVERHEAD = 16
#: Rows and bytes of a block that are ranked by one task, about.
RANKED, RANKED_BYTES = 200_000, 256 << 20
#: Steps by size inside a class; ranks rise with them.
STEPS = 16


@dataclass
class _Edge:
    to: int
    room: int
    cost: float
    back: int


class FlowNetwork:
    """Successive shortest augmenting paths with potentials."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[_Edge]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: float) -> tuple[int, int]:
        self.edges[a].append(_Edge(b, room, cost, len(self.edges[b])))
        self.edges[b].append(_Edge(a, 0, -cost, len(self.edges[a]) - 1))
        return a, len(self.edges[a]) - 1

    def solve(self, source: int, sink: int) -> None:
        n = len(self.edges)
        height = [0.0] * n
        while True:
            far, via, queue = [float("inf")] * n, [None] * n, [(0.0, source)]
            far[source] = 0.0
            while queue:
                d, a = heapq.heappop(queue)
                if d > far[a]:
                    continue
                for e in self.edges[a]:
                    if e.room and (new := d + e.cost + height[a] - height[e.to]) < far[e.to] - 1e-9:
                        far[e.to], via[e.to] = new, (a, e)
                        heapq.heappush(queue, (new, e.to))
            if via[sink] is None:
                return
            height = [h + (f if f < float("inf") else 0.0) for h, f in zip(height, far, strict=True)]
            path, at = [], sink
            while at != source:
                a, e = via[at]
                path.append(e)
                at = a
            flow = min(e.room for e in path)
            for e in path:
                e.room -= flow
                self.edges[e.to][e.back].room += flow


def plan_transfers(blocks: list[tuple[int, int, int, int]], new_shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """blocks: (old shard, class, rows, bytes).  Transfers: (old shard, class, rank from, rank to, new shard, first slot)."""
    blocks = sorted(blocks)
    total = sum(b[2] for b in blocks)
    room = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    n = len(blocks)
    hub, first, sink = n + 1, n + 2, n + 2 + new_shards
    net = FlowNetwork(sink + 1)
    stay, move = {}, {}
    for i, (old, _, rows, size) in enumerate(blocks):
        net.add(0, i + 1, rows, 0.0)
        if old < new_shards:
            stay[i] = net.add(i + 1, first + old, rows, 0.0)
        move[i] = net.add(i + 1, hub, rows, size / rows)
    taken = [net.add(hub, first + j, total, 0.0) for j in range(new_shards)]
    for j in range(new_shards):
        net.add(first + j, sink, room[j], 0.0)
    net.solve(0, sink)
    used = lambda at: (lambda e: net.edges[e.to][e.back].room)(net.edges[at[0]][at[1]])
    slots, out, want = [0] * new_shards, [], [used(t) for t in taken]

    def put(i: int, begin: int, count: int, j: int) -> int:
        old, kind, _, _ = blocks[i]
        out.append((old, kind, begin, begin + count, j, slots[j]))
        slots[j] += count
        return begin + count

    at, j = [0] * n, 0
    for i in range(n):  # the smallest rows of a block go
        rest = used(move[i])
        while rest:
            while not want[j]:
                j += 1
            k = min(rest, want[j])
            at[i] = put(i, at[i], k, j)
            want[j] -= k
            rest -= k
    for i in range(n):
        if i in stay and (k := used(stay[i])):
            put(i, at[i], k, blocks[i][0])
    return out


def sized(docs: DataFrame, old_shard: Column) -> DataFrame:
    """document (all columns), size, text_crc32, old, class."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    return docs.select(whole_row(docs).alias("document"), size.alias("size"), old_shard.cast("int").alias("old"), F.floor(F.log2(size)).cast("int").alias("class"))


def place(docs: DataFrame, old_shard: Column, new_shards: int = NEW_SHARDS) -> tuple[DataFrame, list[int], list[int]]:
    """document, size, old, shard, slot for each row; the numbers of the shards that gain or lose rows, and of those that have rows.

    The driver gets one row for each old shard and size class.
    """
    spark = docs.sparkSession
    rows = sized(docs, old_shard)
    totals = cut(rows.groupBy("old", "class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    blocks = [(r["old"], r["class"], r["n"], r["bytes"]) for r in totals.collect()]
    parts = totals.select("old", "class", F.greatest(F.ceil(F.col("n") / RANKED), F.ceil(F.col("bytes") / RANKED_BYTES), F.lit(1)).alias("parts"))
    # rows of one step are dealt to parts by hash, so no task ranks more than its part
    step = F.floor(F.log2("size") * STEPS).cast("int") - STEPS * F.col("class")
    keyed = rows.join(F.broadcast(parts), ["old", "class"]).withColumn("key", row_key(*[hashable(F.col("document")[f.name], f.dataType) for f in docs.schema]))
    keyed = keyed.withColumn("part", step * F.col("parts") + F.pmod(F.xxhash64("key"), F.col("parts"))).drop("parts")
    own = ["old", "class", "part"]
    counts = keyed.groupBy(*own).agg(F.count("*").alias("n"))
    before = Window.partitionBy("old", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select(*own, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy("key")) - 1).join(starts, own).withColumn("rank", F.col("rank") + F.col("begin"))
    plan = plan_transfers(blocks, new_shards)
    transfers = spark.createDataFrame(plan, "t_old int, t_class int, rank_from long, rank_to long, shard int, first_slot long")
    here = (F.col("old") == F.col("t_old")) & (F.col("class") == F.col("t_class")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    # at most one transfer for each block and two for each shard: a few thousand rows whatever the input
    placed = ranked.join(F.broadcast(transfers), here)
    touched = sorted({x for old, *_, shard, _ in plan if old != shard for x in (old, shard)})
    return placed.select("document", "size", "old", "shard", (F.col("first_slot") + F.col("rank") - F.col("rank_from")).alias("slot")), touched, sorted({t[4] for t in plan})


def hashed_layout(shards: int = OLD_SHARDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(shards))


def _write(placed: DataFrame, folder: str, written: list[int], stay: list[tuple[int, str]]) -> None:
    """Rows under shard=N, then the manifest: (shard, folder) of the shards written here and those that stay elsewhere."""
    spark = placed.sparkSession
    placed.write.option("compression", "zstd").partitionBy("shard").parquet(f"{folder}/rows")
    spark.createDataFrame([], placed.schema).coalesce(1).write.parquet(f"{folder}/none")
    spark.createDataFrame([(n, folder) for n in written] + stay, "shard int, folder string").coalesce(1).write.parquet(f"{folder}/manifest")


def write_layout(docs: DataFrame, folder: str, old_shard: Column, new_shards: int = NEW_SHARDS) -> None:
    """A first layout of ``docs``: every shard is written; ``old_shard`` is where a row counts as coming from."""
    placed, _, filled = place(docs, old_shard, new_shards)
    _write(placed, folder, filled, [])


def rewrite_layout(spark, folder: str, new_folder: str, new_shards: int) -> list[int]:
    """Reshards the layout in ``folder`` to ``new_folder``: only shards that gain or lose rows are written.  Returns their numbers."""
    now = read_layout(spark, folder)
    inner = now.select("document.*").columns
    placed, touched, filled = place(now.select(*[F.col("document")[c].alias(c) for c in inner], F.col("shard").alias("shard__at")), F.col("shard__at"), new_shards)
    placed = placed.withColumn("document", F.struct(*[F.col("document")[c].alias(c) for c in inner]))
    stay = [(r["shard"], r["folder"]) for r in spark.read.parquet(f"{folder}/manifest").collect() if r["shard"] not in touched]
    _write(placed.where(F.col("shard").isin(touched)), new_folder, [n for n in filled if n in touched], stay)
    return touched


def read_layout(spark, folder: str) -> DataFrame:
    """document, size, old, slot, shard of every row of a layout; its manifest has a row for each shard."""
    out = spark.read.parquet(f"{folder}/none")
    places = spark.read.parquet(f"{folder}/manifest").collect()
    for at in sorted({r["folder"] for r in places}):
        own = [r["shard"] for r in places if r["folder"] == at]
        out = out.unionByName(spark.read.parquet(f"{at}/rows").where(F.col("shard").isin(own)))
    return out


def reshard_documents(docs: DataFrame) -> DataFrame:
    """Moves all rows from 32 shards by hash of the id to 40 and returns their places, read back from the new shards' files.

    The old layout has no files, so every shard is written, to a folder of its own in the shared folder.
    """
    folder = f"{shared_dir(docs.sparkSession)}/noteloom/shards-{uuid.uuid4().hex}"
    write_layout(docs, folder, hashed_layout())
    text = F.coalesce(F.col("document.text"), F.lit(""))
    return read_layout(docs.sparkSession, folder).select(
        "document.doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard")
    )
