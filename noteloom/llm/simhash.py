"""SimHash near-dedup: segment-popcount embedding and grid range-join.

A fingerprint maps to the vector of bit counts of its segments.  Two fingerprints that differ in at most two bits
have vectors at Manhattan distance of at most two, so a grid with one cell for each vector is probed with half of the
radius-two ball (every unordered pair once), and survivors are verified by the exact bit distance inside the join.
Only distinct fingerprints are joined, so copies cost nothing; components come from alternating star contraction.
Null text counts as empty; texts without words have fingerprint zero and link like any other.  Rows with equal
fingerprints share a component whatever their ids; a component whose ids are all null has a null component_id.
Repeated rows get equal results, of a component the smallest id stays and of rows that share it one, an empty table gives
no rows, and other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, stage, whole_row

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Segments, and the number of fingerprints up to which that many keep the probes of a cell short.
SEGMENTS = ((8, 1 << 21), (12, 1 << 27), (16, 1 << 63))


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: -SHINGLE]).tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.array([digest(view[s:e], SEED) for s, e in zip(starts, stops, strict=True)], dtype=">u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """row (a key of id and text, null apart from any text), doc_id, fp: the 64 bits as a signed number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"row": b["row"], "doc_id": b["doc_id"], "fp": fps})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", "text").mapInPandas(run, f"row binary, doc_id {kind}, fp long")


def cell(fp: Column, segments: int) -> Column:
    """The vector of bit counts, four bits for each segment."""
    edges = [64 * i // segments for i in range(segments + 1)]
    parts = [
        F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))).cast("long"), 4 * i)
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def half_ball(segments: int) -> list[int]:
    """Steps between cells at Manhattan distance of at most RADIUS, one of each step and its opposite, as differences of cell numbers."""
    unit = [1 << (4 * i) for i in range(segments)]
    steps = {0}
    for r in range(1, RADIUS + 1):
        for where in combinations(range(segments), r):
            steps |= {sum(s * unit[i] for s, i in zip(signs, where, strict=True)) for signs in product((1, -1), repeat=r)}
        steps |= {s * r * u for u in unit for s in (1, -1)}
    return sorted(s if s < 1 << 63 else s - (1 << 64) for s in steps if s >= 0)


def links(distinct: DataFrame, segments: int) -> DataFrame:
    """a, b: pairs of different fingerprints at RADIUS bits or fewer, each once."""
    steps = F.array(*[F.lit(s) for s in half_ball(segments)])
    probes = distinct.select(F.col("fp").alias("a"), F.explode(steps).alias("step")).select("a", "step", (cell(F.col("a"), segments) + F.col("step")).alias("cell"))
    grid = distinct.select(F.col("fp").alias("b"), cell(F.col("fp"), segments).alias("cell"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS) & ((F.col("step") != 0) | (F.col("a") < F.col("b")))
    # the planner's size of the probes leaves out that each fingerprint has many, so it must not choose a broadcast
    return probes.hint("merge").join(grid.hint("merge"), (probes["cell"] == grid["cell"]) & near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root: alternating large-star and small-star until nothing changes; root is the smallest node."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def cluster(docs: DataFrame) -> DataFrame:
    """row, doc_id, fp, root, component_id: one row for each row of ``docs``."""
    prints = stage(fingerprints(docs), "fingerprints")
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("lowest"))
    distinct = cut(lowest)
    n = distinct.count()
    segments = next(m for m, most in SEGMENTS if n <= most)
    roots = components(cut(links(distinct.select("fp"), segments)))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "lowest", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    members = cut(named.where("linked").select("root").distinct().withColumn("hub", F.lit(True)))
    grouped = named.join(members, "root", "left").withColumn("linked", F.col("linked") | F.coalesce("hub", F.lit(False)))
    grouped = stage(grouped.select("fp", "lowest", "root", "linked"), "named")
    ids = cut(grouped.where("linked").groupBy("root").agg(F.min("lowest").alias("id")))
    final = cut(grouped.join(ids, "root", "left").select("fp", "root", F.coalesce("id", "lowest").alias("component_id")))
    return prints.join(final, "fp").select("row", "doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    return cluster(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, the one with the smallest id (null ids last)."""
    rows = stage(cluster(docs).select("row", "doc_id", "root"), "components")
    groups = rows.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("keep")).where("n > 1")
    groups = cut(groups.select("root", F.col("keep.row").alias("keep")))
    gone = stage(rows.join(groups, "root").where("row != keep").select(F.col("row").alias("gone")).distinct(), "duplicates")
    keyed = docs.select(whole_row(docs).alias("document"), row_key(docs["doc_id"], docs["text"]).alias("key"))
    stay = keyed.join(gone, keyed["key"] == gone["gone"], "left_anti")
    if not rows.groupBy("row").count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["key"])
    return stay.select("document.*")
