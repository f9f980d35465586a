"""Hard-negative mining with Four-Russians scoring.

Components become whole numbers, and a candidate's numbers are cut into bit planes in two's complement: one byte for each
plane and group of eight dimensions.  For every group of an anchor a table holds the sums of all 256 subsets of its eight
components, so a candidate's exact score is, plane by plane from the sign down, twice what came before plus the entries
that the plane's bytes look up.  Rows lie in packs of bounded size, anchors in packs of their own; every pack of anchors
meets every pack of rows once for the positives and once for the negatives, and of each rectangle only the best few of an
anchor leave the task.  In a rectangle, tables have a column for each anchor, so that one byte looks up all anchors at once.

Rows with a null label or vector, or with a null or non-finite component take no part.  Shorter vectors count as filled
up with zeros.  A null id is never an anchor's and comes last in ties.  Rows that are equal or share an id are rows of
their own: each may be anchor, positive and negative, and ties beyond the id go by vector, label and place in the table.
Anchors without positives and positives without negatives give no rows; so does an empty table.  Extra columns, whatever
their names, play no part.  Components beyond ``LARGEST`` would leave 64-bit scores and are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SCALE = 256
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score as hundredths of the positive's.
LEAST, MOST = 30, 90
#: Rows and anchors of a pack; bytes up to which all packs of anchors are broadcast.
PACK_ROWS, PACK_ANCHORS, BROADCAST_BYTES = 8192, 128, 32 << 20
GROUP = 8
LARGEST = 1 << 26
NO_ID = np.iinfo(np.int64).max


def planes_of(numbers: np.ndarray) -> np.ndarray:
    """planes by groups by rows: the bytes of every bit plane, the sign's first."""
    rows, dims = numbers.shape
    bits = 1 + max(int(numbers.max(initial=0)), -1 - int(numbers.min(initial=0))).bit_length()
    wide = np.zeros((rows, -(-dims // GROUP) * GROUP), np.int64)
    wide[:, :dims] = numbers
    shifts = np.arange(bits - 1, -1, -1)
    return np.stack([np.packbits((wide >> s & 1).astype(np.uint8), axis=1, bitorder="little").T for s in shifts])


def subset_sums(numbers: np.ndarray) -> np.ndarray:
    """groups by 256 by anchors: the sums of all subsets of each group's components, every one made from a smaller by one addition."""
    anchors, dims = numbers.shape
    groups = -(-dims // GROUP)
    wide = np.zeros((anchors, groups * GROUP), np.int64)
    wide[:, :dims] = numbers
    table = np.zeros((groups, 1 << GROUP, anchors), np.int64)
    for bit in range(GROUP):
        table[:, 1 << bit : 2 << bit] = table[:, : 1 << bit] + wide.reshape(anchors, groups, GROUP)[:, :, bit].T[:, None, :]
    return table


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """rows by anchors: exact inner products, by shifts, additions and lookups."""
    bits, groups, rows = planes.shape
    groups = min(groups, len(table))  # what one side lacks counts as zeros
    most = int(np.abs(table).max(initial=0)) * max(1, groups) << bits
    table = table.astype(np.int32) if most < 1 << 31 else table
    total, looked = np.zeros((rows, table.shape[2]), table.dtype), np.empty((rows, table.shape[2]), table.dtype)
    for plane in range(bits):
        if plane:
            np.left_shift(total, 1, out=total)
        for group in range(groups):
            np.take(table[group], planes[plane, group], axis=0, out=looked, mode="clip")
            if plane:
                np.add(total, looked, out=total)
            else:  # the sign's plane weighs negatively
                np.subtract(total, looked, out=total)
    return total


ROW = "pack long, n int, bits int, groups int, ids binary, labels binary, planes binary"
ANCHOR = "pack long, n int, dims int, ids binary, labels binary, places binary, numbers binary"


def packed(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packs of rows and packs of anchors, made where the rows lie; a pack's number is the place of its first row, the others follow."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", number), F.lit(False))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    rows = embeddings.where(whole).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("vec_id").isNull().alias("null"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = TaskContext.get().partitionId() << 40
        for b in batches:
            for begin in range(0, len(b), PACK_ROWS):
                part = b.iloc[begin : begin + PACK_ROWS]
                dims = max(map(len, part["embedding"]), default=0)
                x = np.zeros((len(part), dims))
                for i, e in enumerate(part["embedding"]):
                    x[i, : len(e)] = e
                x = np.floor(x * SCALE)
                if np.abs(x).max(initial=0) > LARGEST:
                    raise ValueError(f"components beyond {LARGEST / SCALE}: their scores could leave 64 bits")
                x = x.astype(np.int64)
                ids, labels = part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
                order = np.lexsort([*x.T[::-1], ids, labels])  # of one label together, and in it by id
                x, ids, labels = x[order], ids[order], labels[order]
                planes = planes_of(x)
                places = pack + np.arange(len(ids))
                own = (ids % ANCHOR_EVERY == 0) & ~part["null"].to_numpy(bool)[order]
                yield pd.DataFrame({
                    "pack": [pack], "n": [len(ids)], "bits": [planes.shape[0]], "groups": [planes.shape[1]], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "planes": [planes.tobytes()],
                    "a_n": [int(own.sum())], "dims": [dims], "a_ids": [ids[own].tobytes()], "a_labels": [labels[own].tobytes()], "a_places": [places[own].tobytes()], "numbers": [x[own].astype(np.int32).tobytes()],
                })
                pack += len(ids)

    made = stage(rows.mapInPandas(run, f"{ROW}, a_n int, dims int, a_ids binary, a_labels binary, a_places binary, numbers binary"), "packs")
    few = made.where("a_n > 0").select("a_n", "dims", "a_ids", "a_labels", "a_places", "numbers")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Anchors of several packs of rows, of one number of dimensions, in packs of at most PACK_ANCHORS."""
        pack, held = TaskContext.get().partitionId() << 24, {}
        columns = ["pack", *(c.split()[0] for c in ANCHOR.split(", ")[1:])]

        def out(dims: int, k: int) -> pd.DataFrame:
            nonlocal pack
            taken = [a[:k] for a in held[dims]]
            held[dims] = [a[k:] for a in held[dims]]
            pack += 1
            return pd.DataFrame([(pack - 1, k, dims, *(np.ascontiguousarray(a).tobytes() for a in taken))], columns=columns)

        for b in batches:
            for n, dims, *parts in b.itertuples(index=False):
                arrays = [np.frombuffer(p, np.int64) for p in parts[:3]] + [np.frombuffer(parts[3], np.int32).reshape(n, dims)]
                held[dims] = [np.concatenate(x) for x in zip(held[dims], arrays, strict=True)] if dims in held else arrays
                while len(held[dims][0]) >= PACK_ANCHORS:
                    yield out(dims, PACK_ANCHORS)
        for dims in held:
            if len(held[dims][0]):
                yield out(dims, len(held[dims][0]))

    return made.select(*[c.split()[0] for c in ROW.split(", ")]), stage(few.mapInPandas(gather, ANCHOR), "anchors")


def rectangles(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each pack of anchors (columns a_*) beside each pack of rows.  Anchors are broadcast where their measured size allows it."""
    named = anchors.select(F.col("pack").alias("nth"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    size = anchors.agg(F.coalesce(F.sum(F.octet_length("numbers") + 24 * F.col("n")), F.lit(0)).alias("bytes"), F.collect_list("pack").alias("packs")).first()
    dealt = rows.withColumn("nth", F.explode(F.array(*[F.lit(p) for p in size["packs"]]).cast("array<bigint>")))
    return dealt.join(F.broadcast(named) if size["bytes"] <= BROADCAST_BYTES else named, "nth").drop("nth")


class Rows:
    def __init__(self, r) -> None:
        self.ids, self.labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
        self.planes = np.frombuffer(r.planes, np.uint8).reshape(r.bits, r.groups, r.n)
        self.places = r.pack + np.arange(r.n)


class Anchors:
    def __init__(self, r) -> None:
        self.ids, self.labels, self.places = (np.frombuffer(x, np.int64) for x in (r.a_ids, r.a_labels, r.a_places))
        self.table = subset_sums(np.frombuffer(r.a_numbers, np.int32).reshape(r.a_n, r.a_dims).astype(np.int64))


FOUND = "anchor_place long, anchor_id long, place long, id long, score long"


def positives(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_place, anchor_id, nth (from 1), place, id, score: the best other rows of each anchor's label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                own, asked, out = Rows(r), Anchors(r), []
                for label in np.unique(asked.labels):
                    begin, end = np.searchsorted(own.labels, [label, label + 1])
                    which = np.flatnonzero(asked.labels == label)
                    if begin == end:
                        continue
                    s = scores(np.ascontiguousarray(asked.table[:, :, which]), own.planes[:, :, begin:end])
                    for j, a in enumerate(which):
                        # rows lie by id, so a stable order keeps the smaller of equals first; one more, as the anchor may be among them
                        best = np.argsort(-s[:, j], kind="stable") if end - begin <= 64 else leading(s[:, j], POSITIVES + 1)
                        best = best[own.places[begin + best] != asked.places[a]][:POSITIVES] + begin
                        out.append(pd.DataFrame({"anchor_place": asked.places[a], "anchor_id": asked.ids[a], "place": own.places[best], "id": own.ids[best], "score": s[best - begin, j].astype(np.int64)}))
                if out:
                    yield pd.concat(out)

    found = rectangles(rows, anchors).mapInPandas(run, FOUND)
    nth = F.row_number().over(Window.partitionBy("anchor_place").orderBy(F.desc("score"), "id", "place"))
    return found.withColumn("nth", nth).where(F.col("nth") <= POSITIVES)


def leading(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest, the earlier of equals first."""
    if len(values) <= k:
        return np.argsort(-values, kind="stable")
    bound = np.partition(values, len(values) - k)[len(values) - k]
    above = np.flatnonzero(values > bound)
    at = np.concatenate([above, np.flatnonzero(values == bound)[: k - len(above)]])
    return at[np.lexsort([at, -values[at]])]


def negatives(rows: DataFrame, anchors: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor_place, nth, place, id, score: of each positive the best rows of other labels within its bounds."""
    own = anchors.select(F.col("pack").alias("of"), "places")

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for of, places in zip(b["of"], b["places"], strict=True):
                at = np.frombuffer(places, np.int64)
                yield pd.DataFrame({"of": of, "at": np.arange(len(at)), "anchor_place": at})

    placed = own.mapInPandas(numbered, "of long, at int, anchor_place long").join(wanted.select("anchor_place", "nth", F.col("score").alias("s")), "anchor_place")
    # at most PACK_ANCHORS times POSITIVES of a pack
    asked = stage(placed.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("at", "nth", "s"))).alias("asked")), "asked")
    with_bounds = stage(anchors.join(asked, anchors["pack"] == asked["of"]).drop("of"), "bounded")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                own, asked, out = Rows(r), Anchors(r), []
                s = scores(asked.table, own.planes)
                for x in r.a_asked:
                    a, bound = x["at"], x["s"]
                    column = s[:, a].astype(np.int64) * 100 if abs(bound) > 1 << 20 else s[:, a] * 100
                    fits = np.flatnonzero((column >= LEAST * bound) & (column <= MOST * bound) & (own.labels != asked.labels[a]))
                    if not len(fits):
                        continue
                    value = s[fits, a]
                    if len(fits) > NEGATIVES:  # all that tie with the last of them stay in the choice
                        last = np.partition(value, len(value) - NEGATIVES)[len(value) - NEGATIVES]
                        fits, value = fits[value >= last], value[value >= last]
                    best = fits[np.lexsort([own.places[fits], own.ids[fits], -value])[:NEGATIVES]]
                    out.append(pd.DataFrame({"anchor_place": asked.places[a], "nth": x["nth"], "place": own.places[best], "id": own.ids[best], "score": s[best, a].astype(np.int64)}))
                if out:
                    yield pd.concat(out)

    found = rectangles(rows, with_bounds).mapInPandas(run, "anchor_place long, nth int, place long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_place", "nth").orderBy(F.desc("score"), "id", "place"))
    return found.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES)


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows, anchors = packed(embeddings)
    wanted = stage(positives(rows, anchors), "positives")
    found = negatives(rows, anchors, wanted).select("anchor_place", "nth", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return wanted.join(found, ["anchor_place", "nth"]).select(
        named("anchor_id").alias("anchor_id"), named("id").alias("positive_id"), "rank", named("negative").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score"
    )


ORACLE = f"""WITH v AS (SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE)))),
s AS (SELECT a.vec_id AS anchor_id, a.place AS a, b.vec_id AS id, b.place AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.place <> b.place WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 100 * n.score BETWEEN {LEAST} * p.score AND {MOST} * p.score
QUALIFY rank <= {NEGATIVES}"""
