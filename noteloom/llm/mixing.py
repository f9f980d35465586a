"""Mixing sources to target weights: temperature mixing.

Source token shares are raised to an exponent and normalised.  The exponent is bisected until the mixture reaches a
target entropy, or as far as the repetition limit allows.  The budget is the smallest that uses every document once,
so that the source which gains least has one epoch and no other more than the limit.  Weights are realised in blocks:
each source's documents are hashed to blocks; whole epochs take all blocks in an order of their own, the last, partial
epoch takes blocks in its order until the source's budget is met and cuts the block at the limit by documents.  The
blocks of a source are summed in ranges of their order first, so that no task orders all blocks of a large source.
Null text and texts without words count as one token, a null source is one of its own, repeated rows are each drawn as
their equals, ties in the order go by block or row key, an empty table gives no rows, and other columns, whatever their
names, play no part.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_key, stage, whole_row

SEED = 20
BLOCK_TOKENS = 200_000
ENTROPY_SHARE = 0.999
REPETITION_LIMIT = 2.0
#: Sources up to which the plan, five numbers each, is broadcast.
SOURCES = 100_000
#: Halvings of the exponent's interval.
STEPS = 24
#: Leading bits of a block's place in the order; blocks are summed by these first.
RANGE_BITS = 10


def token_counts(docs: DataFrame) -> DataFrame:
    tokens = F.greatest(F.lit(1), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")))
    return docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("source"), tokens.cast("long").alias("tokens"), row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("row"))


def mixture(totals: DataFrame, tau: float) -> tuple[float, float]:
    """Entropy and largest number of epochs at an exponent; one pass over the sources' shares."""
    power = F.pow("share", F.lit(tau))
    r = totals.agg(F.min("share").alias("least"), F.max("share").alias("most"), F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("w")).first()
    return log(r["z"]) - tau * r["w"] / r["z"], (r["least"] / r["most"]) ** (tau - 1)


def exponent(totals: DataFrame, sources: int, entropy_share: float, limit: float) -> float:
    """The largest exponent in [0, 1] that reaches ``entropy_share`` of the greatest entropy, raised where the limit demands it.

    Entropy and epochs both fall as the exponent rises, so an exponent is too small if its epochs pass the limit, else
    too large if its entropy misses the target.
    """

    def fits(tau: float) -> bool:
        entropy, epochs = mixture(totals, tau)
        return epochs > limit or entropy >= entropy_share * log(max(2, sources))

    low, high = 0.0, 1.0
    if fits(high):
        return high
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low if mixture(totals, low)[1] <= limit else high


def copies(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, limit: float = REPETITION_LIMIT) -> DataFrame:
    """row, doc_id, source, tokens, block, whole (epochs that take all), copies, weight."""
    rows = stage(token_counts(docs), "tokens")
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("total"))
    grand = cut(sums)
    all_tokens = grand.agg(F.sum("total").alias("t"), F.count("*").alias("n")).first()
    if not all_tokens["n"]:
        tau = 1.0
    else:
        tau = exponent(grand.select((F.col("total") / F.lit(float(all_tokens["t"]))).alias("share")), all_tokens["n"], entropy_share, limit)
    norms = grand.agg(F.sum(F.pow(F.col("total") / F.lit(float(all_tokens["t"] or 1)), F.lit(tau))).alias("z"), F.max("total").alias("most")).first()
    share = F.col("total") / F.lit(float(all_tokens["t"] or 1))
    weight = F.pow(share, F.lit(tau)) / F.lit(norms["z"] or 1.0)
    epochs = F.least(F.lit(limit), F.pow(F.col("total") / F.lit(float(norms["most"] or 1)), F.lit(tau - 1)))
    plan = grand.select(
        "source", weight.alias("weight"), F.floor(epochs).cast("int").alias("whole"), F.round((epochs - F.floor(epochs)) * F.col("total")).cast("long").alias("partial"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_TOKENS)).cast("long").alias("blocks"),
    )
    if all_tokens["n"] <= SOURCES:
        plan = F.broadcast(plan)
    blocked = rows.join(plan, "source").withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "row"), F.col("blocks")))
    sizes = blocked.groupBy("source", "block").agg(F.sum("tokens").alias("size"), F.first("partial").alias("budget"), F.first("whole").alias("epoch"))
    sizes = stage(sizes.withColumn("order", F.xxhash64(F.lit(SEED), "epoch", "block")).withColumn("range", F.shiftrightunsigned("order", 64 - RANGE_BITS)), "blocks")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("source", "range").agg(F.sum("size").alias("sum")).select("source", "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    inside_range = Window.partitionBy("source", "range").orderBy("order", "block")
    filled = sizes.join(cut(ranges), ["source", "range"]).select("source", "block", (F.col("budget") - F.col("before") - (F.sum("size").over(inside_range) - F.col("size"))).alias("left"), "size")
    left = blocked.join(filled, ["source", "block"])
    at_limit = (F.col("left") > 0) & (F.col("left") < F.col("size"))
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(SEED), "whole", "row"), "row")
    cut_rows = left.where(at_limit).withColumn("extra", (F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("left")).cast("int"))
    other = left.where(~at_limit).withColumn("extra", (F.col("left") >= F.col("size")).cast("int"))
    out = cut_rows.unionByName(other)
    return out.select("row", "doc_id", "source", "tokens", "block", "whole", (F.col("whole") + F.col("extra")).alias("copies"), "weight")


def mix(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, limit: float = REPETITION_LIMIT) -> DataFrame:
    """One row for each draw: doc_id, source, tokens, epoch, block, block_order and doc_order (sort by epoch and these), weight."""
    drawn = copies(docs, entropy_share, limit).select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))
    return drawn.select(
        "doc_id", F.col("source"), "tokens", "epoch", "block", F.xxhash64(F.lit(SEED), "epoch", "block").alias("block_order"),
        F.xxhash64(F.lit(SEED), "epoch", "row").alias("doc_order"), F.round("weight", 9).alias("weight"),
    )


def mix_documents(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, limit: float = REPETITION_LIMIT) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture draws it."""
    counts = stage(copies(docs, entropy_share, limit).groupBy("row").agg(F.min("copies").alias("copies")), "draws")
    keyed = docs.select(whole_row(docs).alias("document"), row_key(docs["doc_id"], docs["source"], docs["text"]).alias("row"))
    drawn = keyed.join(counts, "row")
    return drawn.select("document", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("document.*")
