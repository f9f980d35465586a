"""Fill-in-middle transformation: cuts of texts at ranks of units, found in an indexable skip list.

A text's units, code points unless a pattern says otherwise, are the nodes of a skip list.  Every link of every express
lane carries how many units and how many code points it skips, so a descent that adds up widths comes to the code point
at which the unit of any rank begins without reading the links between.  A document's checksums draw the two ranks and
the form: plain, prefix-suffix-middle (psm) or suffix-prefix-middle (spm).  Marked texts are put together and taken apart
again on the JVM side.

Null text counts as empty and a null id as one without digits; empty texts, and texts that hold a marker, stay plain;
repeated rows give equal results; texts are cut whole however long they are; an empty table gives no rows; the columns of
the table lie in a struct of their own, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_row

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Of a hundred documents: those that stay plain, and those of the others that are written suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: One node in so many of a lane is in the next lane too.
FAN_BITS = 4


class Heights:
    """In how many express lanes each node is, by its place: drawn from a hash, so that lists are equal in every run."""

    def __init__(self) -> None:
        self.known = np.zeros(0, np.uint8)

    def of(self, n: int) -> np.ndarray:
        if n > len(self.known):
            x = np.arange(max(n, 1 << 12), dtype=np.uint64)
            with np.errstate(over="ignore"):
                x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
            height = np.zeros(len(x), np.uint8)
            for lane in range(1, 64 // FAN_BITS):
                height += x & np.uint64((1 << FAN_BITS * lane) - 1) == 0
            self.known = height
        return self.known[:n]


_heights = Heights()


class SkipList:
    """Lanes from the full one up; of each link the units and code points that it skips, of each node its place one lane below."""

    def __init__(self, widths: np.ndarray) -> None:
        """widths: code points of each unit."""
        self.units, self.points = [np.ones(len(widths), np.int64)], [np.asarray(widths, np.int64)]
        self.below: list[np.ndarray] = []
        height, lane = _heights.of(len(widths)), 1
        while len(self.units[-1]) > 1 << FAN_BITS:
            up = height >= lane
            up[0] = True
            at = np.flatnonzero(up)
            self.units.append(np.add.reduceat(self.units[-1], at))
            self.points.append(np.add.reduceat(self.points[-1], at))
            self.below.append(np.append(at, len(up)))
            height, lane = height[at], lane + 1

    def __len__(self) -> int:
        return len(self.units[0])

    def seek(self, rank: int) -> int:
        """Code points before the unit of this rank; of a rank at or behind the end, all."""
        node = units = points = 0
        for lane in range(len(self.units) - 1, -1, -1):
            wide, far = self.units[lane], self.points[lane]
            while node < len(wide) and units + wide[node] <= rank:
                units, points, node = units + int(wide[node]), points + int(far[node]), node + 1
            if lane:
                node = int(self.below[lane - 1][node])
        return points


def unit_widths(text: str, pattern: regex.Pattern | None) -> np.ndarray:
    """Code points of each unit: one, or from a match of the pattern to the next; what stands before the first match is part of the first unit."""
    if pattern is None:
        return np.ones(len(text), np.int64)
    starts = [m.start() for m in pattern.finditer(text) if m.end() > m.start()]
    if not starts:
        return np.array([len(text)] if text else [], np.int64)
    return np.diff([0, *starts[1:], len(text)])


def cutter(unit: str | None) -> Callable[[Column, Column, Column], Column]:
    """Column function of text and two drawn numbers: units of the text, and the code points of the first and of the second cut."""

    @F.pandas_udf("n long, first long, second long")
    def cut(text: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(unit) if unit else None
        out = np.zeros((len(text), 3), np.int64)
        for i, (t, a, b) in enumerate(zip(text, one, two, strict=True)):
            units = SkipList(unit_widths(t, pattern))
            n = len(units)
            low, high = sorted((a % (n + 1), b % (n + 1)))
            out[i] = n, units.seek(low), units.seek(high)
        return pd.DataFrame(out, columns=["n", "first", "second"])

    return cut


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four 32-bit numbers of a document, from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made.  Texts without markers hold none at a seam either, so the first ones are the right ones."""
    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    part = lambda begin, end: F.substr(output, begin + len(PREFIX), end - begin - len(PREFIX))
    middle = F.substr(output, m + len(MIDDLE))
    psm, spm = F.concat(part(p, s), middle, part(s, m)), F.concat(part(p, m), middle, part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str | None = None, seed: str = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """document (all columns), n (units), form, prefix_chars, middle_chars (null if plain) and output of each row.

    ``unit`` is a pattern whose matches begin units; without it code points are units.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    one, two, three, four = draws(F.col("doc_id"), seed)
    drawn = docs.select(whole_row(docs).alias("document"), text.alias("whole"), one.alias("one"), two.alias("two"), (three % 100).alias("three"), (four % 100).alias("four"))
    cut = drawn.withColumn("cut", cutter(unit)("whole", "one", "two"))
    whole, first, second = F.col("whole"), F.col("cut.first"), F.col("cut.second")
    marked = (whole == "") | F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    form = F.when(marked | (F.col("three") >= 100 - plain), "plain").when(F.col("four") < suffix_first, "spm").otherwise("psm")
    formed = cut.select("document", "whole", first.alias("first"), second.alias("second"), F.col("cut.n").alias("n"), form.alias("form"))
    prefix, middle, suffix = F.substr(whole, F.lit(1), F.col("first")), F.substr(whole, F.col("first") + 1, F.col("second") - F.col("first")), F.substr(whole, F.col("second") + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(whole)
    split = F.col("form") != "plain"
    return formed.select(
        "document", "n", "form", F.when(split, F.col("first")).alias("prefix_chars"), F.when(split, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output")
    )


def transformation_digest(docs: DataFrame) -> DataFrame:
    made = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "document.doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: Code points as units need no list in SQL.
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || substring(x, 1, 8))::BIGINT AS h1, ('0x' || substring(x, 9, 8))::BIGINT AS h2, ('0x' || substring(x, 17, 8))::BIGINT AS h3, ('0x' || substring(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
