"""Quality rules: n-gram perplexity with a modified Kneser-Ney model.

n-grams are over characters of the words joined by one space, with a boundary mark before each text, of one language
at a time (null language: ``und``).  The distinct texts of a language are dealt by hash to two halves; Spark counts the
highest order of each half, in which every text counts once, and each text is scored by the model of the other half, so
that neither a text nor its copies make it likely.  The lower orders use continuation counts and every order its own
three discounts.  Probabilities and back-off weights are stored in sorted arrays of 64-bit hashes.  Small models share
slices of about SLICE_BYTES; a larger one is cut by the two characters before the predicted one into slices of its own.
One slice at a time is broadcast, scores the texts of its models and is dropped, so that the driver holds one slice
whatever the size of the model, and a text is read once for each slice of its own model.

Documents whose log perplexity leaves the band of their language are rejected; the band's quartiles take each distinct
text once, so copies move neither and share their text's verdict.  Null text counts as empty and has no perplexity; it
fails the base rule.  U+FDD0 in a text isn't scored.  A language of one distinct text has no other half: its text's
characters all weigh alike.  Repeated rows get equal results, ties in the quartiles go to the lower bin, an empty table
gives no rows, and other columns, whatever their names, play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, row_key, stage

ORDER = 5
BOUNDARY = "﷐"
MARK = ord(BOUNDARY)
#: Size of a slice of the models in bytes; twelve bytes an entry.
SLICE_BYTES = 24 << 20
ENTRY_BYTES = 12
#: Languages up to which their discounts, three numbers each, are broadcast.
LANGUAGES = 10_000
#: n-grams gathered in a task before they are passed on.
HELD = 1 << 19
#: n-grams passed on at a time.
PASSED = 1 << 17
#: Text characters counted or scored at a time.
CHUNK = 1 << 19
#: Rows taken from a batch at a time.
ROWS = 1 << 11
#: Characters told apart in packed n-grams, the unused number zero included; chunks of more are counted and scored unpacked.
LETTER_BITS = 12
LETTERS = 1 << LETTER_BITS
BIN = 0.002
#: Band: this many quartile distances below and above the median score of the language; three are about four deviations of a normal law.
WIDTH_BELOW, WIDTH_ABOVE = 3.0, 3.0
FLOOR = -20.0
SYMBOLS = b"#*$%&|<>"
SLOT_BITS = 19
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Powers of SPREAD and of its inverse, and a value for each byte but the blank: word hashes of texts up to this length.
POWERS, INVERSES = (np.cumprod(np.append(np.uint64(1), np.full((1 << 16) - 1, x, np.uint64))) for x in (int(SPREAD), pow(int(SPREAD), -1, 1 << 64)))
BYTE_VALUES = np.where(np.arange(256) == 32, 0, (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)).astype(np.uint64)


def language() -> Column:
    return F.coalesce(F.col("lang"), F.lit("und"))


def model_of(half: Column) -> Column:
    """Name of the model that one half's texts make."""
    return F.concat(language(), F.lit(BOUNDARY), half.cast("string"))


def text_key() -> Column:
    return row_key(F.col("text"), language())


def half_of_text() -> Column:
    return F.pmod(F.xxhash64("text", language()), F.lit(2)).cast("int")


def codes(texts: list[str]) -> np.ndarray:
    """Code points of the texts, each behind ORDER - 1 marks."""
    lead = BOUNDARY * (ORDER - 1)
    joined = "".join(lead + t for t in texts)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32)


def normal(text: str | None) -> str:
    return b" ".join((text or "").encode().split()).decode()


class Alphabet:
    """Numbers of up to LETTERS - 1 characters as they come, so that n-grams of highest order are whole numbers of 60 bits."""

    def __init__(self) -> None:
        self.number = np.zeros(0x110000, np.uint16)
        self.chars = np.zeros(1, np.uint32)

    def keys(self, c: np.ndarray) -> np.ndarray | None:
        """Of the n-grams that begin at each place; None if their characters find no room."""
        ids = self.number[c]
        if not ids.all():
            new = np.unique(c[ids == 0])
            size = len(self.chars)
            if size + len(new) > LETTERS:
                return None
            self.number[new] = np.arange(size, size + len(new))
            self.chars = np.concatenate([self.chars, new])
            ids = self.number[c]
        n = len(c) - ORDER + 1
        key = ids[:n].astype(np.uint64)
        for k in range(1, ORDER):
            key <<= np.uint64(LETTER_BITS)
            key |= ids[k : k + n]
        return key

    def columns(self, keys: np.ndarray) -> list[np.ndarray]:
        """Code points, first characters first."""
        return [self.chars[keys >> np.uint64(LETTER_BITS * k) & np.uint64(LETTERS - 1)] for k in range(ORDER - 1, -1, -1)]


def wide_grams(c: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams of highest order as columns of code points, and how often each occurs; none that predicts a mark.

    Code points have 21 bits, so three and two of them make sort keys.
    """
    at = np.flatnonzero(c[ORDER - 1 :] != MARK)
    columns = [c[at + k] for k in range(ORDER)]
    keys = [np.zeros(len(at), np.uint64) for _ in range(-(-ORDER // 3))]
    for k in range(ORDER):
        keys[k // 3] = keys[k // 3] << np.uint64(21) | columns[k].astype(np.uint64)
    order = np.lexsort(keys)
    differs = np.ones(len(at), bool)
    differs[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(differs)
    return [x[order[first]] for x in columns], np.diff(np.append(first, len(at)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of equal n-grams."""
    if len(parts) == 1:
        return parts[0]
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n[order], first)


def as_strings(columns: list[np.ndarray]) -> pa.Array:
    flat = np.column_stack(columns).astype(np.uint32, copy=False)
    sizes = 1 + (flat >= 0x80).astype(np.int32) + (flat >= 0x800) + (flat >= 0x10000)
    ends = np.append(0, np.cumsum(sizes.sum(axis=1))).astype(np.int32)
    data = flat.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(flat), pa.py_buffer(ends), pa.py_buffer(data))


def _chunks(texts: list[str]) -> Iterator[list[int]]:
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        size += len(t) + ORDER
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def with_copies(docs: DataFrame) -> DataFrame:
    """model, text, copies: each row with its text's number of rows in its language; texts that occur once aren't moved."""
    rows = docs.select(model_of(half_of_text()).alias("model"), "text", text_key().alias("row"))
    often = stage(rows.groupBy("row").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    return rows.join(often, "row", "left").select("model", "text", F.coalesce("copies", F.lit(1)).alias("copies"))


def count_grams(docs: DataFrame) -> DataFrame:
    """lang (the model's name), gram, n: each distinct text once, summed within each task before the shuffle.

    A row gives its text's share, one by its copies, and the sums are rounded to the whole numbers they stand for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        alphabet = Alphabet()
        waiting: dict[tuple[str, int], list[str]] = {}
        chars: dict[tuple[str, int], int] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def passed(model: str, columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(model, pa.string()), len(n)), as_strings(columns), pa.array(n, pa.float64())], ["lang", "gram", "n"])

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for model, parts in held.items():
                keys, n = merged(parts)
                for at in range(0, len(n), PASSED):
                    yield passed(model, alphabet.columns(keys[at : at + PASSED]), n[at : at + PASSED])
            held.clear()
            size = 0

        def count(key: tuple[str, int]) -> Iterator[pa.RecordBatch]:
            nonlocal alphabet, held, size
            model, copies = key
            del chars[key]
            c = codes(waiting.pop(key))
            keys = alphabet.keys(c)
            if keys is None:
                yield from out()
                alphabet = Alphabet()
                keys = alphabet.keys(c)
            if keys is None:
                columns, n = wide_grams(c)
                for at in range(0, len(n), PASSED):
                    yield passed(model, [x[at : at + PASSED] for x in columns], n[at : at + PASSED] / copies)
                return
            keys, n = np.unique(keys[c[ORDER - 1 :] != MARK], return_counts=True)
            held.setdefault(model, []).append((keys, n / copies))
            size += len(n)
            if size > 2 * HELD:
                held = {k: [merged(v)] for k, v in held.items()}
                size = sum(len(v[0][1]) for v in held.values())
                if size > HELD:
                    yield from out()

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                for *key, text in zip(*(part[x].to_pylist() for x in ("model", "copies", "text")), strict=True):
                    if text := normal(text):
                        key = tuple(key)
                        waiting.setdefault(key, []).append(text)
                        chars[key] = chars.get(key, 0) + len(text) + ORDER
                        if chars[key] >= CHUNK:
                            yield from count(key)
                if sum(chars.values()) >= 4 * CHUNK:
                    for key in list(waiting):
                        yield from count(key)
        for key in list(waiting):
            yield from count(key)
        yield from out()

    counted = with_copies(docs).mapInArrow(run, "lang string, gram string, n double")
    return counted.groupBy("lang", "gram").agg(F.round(F.sum("n")).cast("long").alias("n"))


def discounts(grams: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 from the counts of counts of one order."""
    n = [F.count_if(F.col("n") == i).cast("double") for i in range(1, 5)]
    c = grams.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usable = F.least("n1", "n2", "n3", "n4") > 0

    def discount(i: int) -> F.Column:
        d = i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))
        return F.when(usable, F.greatest(F.lit(0.05), F.least(d, F.lit(i - 0.05)))).otherwise(F.lit(0.5 * i)).alias(f"d{i}")

    return c.select(F.col("lang").alias("d_lang"), discount(1), discount(2), discount(3))


def estimate(counted: DataFrame) -> DataFrame:
    """lang, size, gram, logp, back: interpolated log probability of the last character and log back-off weight of the first ``size`` - 1."""
    orders = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = orders[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
    lower, models = None, []
    for k in range(1, ORDER + 1):
        g = orders[k]
        d = cut(discounts(g))
        if d.count() <= LANGUAGES:
            d = F.broadcast(d)
        context = Window.partitionBy("lang", "context")
        of = lambda c: F.sum(c.cast("long")).over(context)
        g = g.select("lang", "gram", F.substring("gram", 1, k - 1).alias("context"), "n")
        g = g.select("*", of(F.col("n")).alias("total"), of(F.col("n") == 1).alias("n1"), of(F.col("n") == 2).alias("n2"), of(F.col("n") > 2).alias("n3"))
        cut_by = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        mass = F.col("n1") * F.col("d1") + F.col("n2") * F.col("d2") + F.col("n3") * F.col("d3")
        g = g.join(d, g["lang"] == d["d_lang"]).select("lang", "gram", "n", "total", cut_by.alias("cut"), mass.alias("mass"))
        if k == 1:
            g = g.withColumn("below", 1.0 / (1 + F.count("*").over(Window.partitionBy("lang"))))
        else:
            low = lower.select(F.col("lang").alias("l_lang"), F.col("gram").alias("l_gram"), F.col("p").alias("below"))
            g = g.join(low, (g["lang"] == low["l_lang"]) & (F.substring(g["gram"], 2, k - 1) == low["l_gram"]))
        g = g.select("lang", F.lit(k).alias("size"), "gram", ((F.col("n") - F.col("cut") + F.col("mass") * F.col("below")) / F.col("total")).alias("p"), (F.col("mass") / F.col("total")).alias("share"))
        lower = cut(g) if k < ORDER else g
        models.append(lower.select("lang", "size", "gram", F.log("p").alias("logp"), F.log("share").alias("back")))
    out = models[0]
    for m in models[1:]:
        out = out.unionByName(m)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def gram_hash(lang: str, kind: int, columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the language, what is stored (order, or back-off of an order) and the characters."""
    h = mixed(np.full(len(columns[0]) if columns else 1, (zlib.crc32(lang.encode()) << 8 | kind) + 1, np.uint64))
    for c in columns:
        h = (h + c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mixed(h)


def route(first: np.ndarray, second: np.ndarray, slices: int) -> np.ndarray:
    return (gram_hash("", 99, [first, second]) % np.uint64(slices)).astype(np.int64)


class SortedArrays:
    """Log values by 64-bit hash: sorted hashes, a table of where each leading bit pattern begins, and values."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.values = hashes[order], values[order]
        self.bits = max(1, int(np.log2(len(self.hashes) + 2)) - 1)
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.begin = np.searchsorted(self.hashes, edges).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values; NaN where a hash isn't held."""
        out = np.full(len(h), np.nan, np.float32)
        if not len(self.hashes):
            return out
        at = self.begin[(h >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        last = len(self.hashes) - 1
        rest, want = np.arange(len(h)), h
        while len(rest):
            at = np.minimum(at, last)
            here = self.hashes[at]
            hit = here == want
            out[rest[hit]] = self.values[at[hit]]
            go = (here < want) & (at < last)
            rest, want, at = rest[go], want[go], at[go] + 1
        return out


class Slices:
    """Where the entries of each model lie: models larger than a slice have their own, the others are dealt by name."""

    def __init__(self, model: DataFrame) -> None:
        sizes = cut(model.groupBy("lang").agg((F.count("*") * 2 * ENTRY_BYTES).alias("bytes")))
        # larger models are at most as many as slices
        large = sizes.where(F.col("bytes") > SLICE_BYTES).orderBy("lang").collect()
        rest = sizes.where(F.col("bytes") <= SLICE_BYTES).agg(F.sum("bytes")).first()[0] or 0
        self.shared = max(1, -(-rest // SLICE_BYTES))
        self.own: dict[str, tuple[int, int]] = {}
        self.count = self.shared
        for r in large:
            k = -(-r["bytes"] // SLICE_BYTES)
            self.own[r["lang"]] = (self.count, k)
            self.count += k

    def of(self, model: str) -> tuple[int, int]:
        """First slice and number of slices."""
        return self.own.get(model) or (zlib.crc32(model.encode()) % self.shared, 1)

    def texts_of(self, which: int, model: Column) -> Column:
        """Condition for the texts that slice ``which`` scores."""
        for name, (first, k) in self.own.items():
            if first <= which < first + k:
                return model == name
        small = F.pmod(F.crc32(model), F.lit(self.shared)) == which
        return small & ~model.isin(list(self.own)) if self.own else small


def model_arrays(model: DataFrame, slices: Slices) -> DataFrame:
    """slice, hashes, values: the entries of each slice as bytes; -1 - s: those of the two lowest orders, for all slices of the model that begins at s."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (lang, size), part in b.groupby(["lang", "size"]):
                size, (first, k) = int(size), slices.of(lang)
                grams = np.array(part["gram"].tolist(), dtype=f"U{size}").view(np.uint32).reshape(-1, size)
                columns = [grams[:, j] for j in range(size)]
                place = lambda cs: first + route(cs[-2], cs[-1], k) if k > 1 and len(cs) > 1 else np.full(len(cs[0]) if cs else 1, -1 - first if k > 1 else first)
                hashes, values, where = [gram_hash(lang, size, columns)], [part["logp"].to_numpy(np.float32)], [place(columns[:-1]) if size > 2 else place(columns[:1])]
                if size > 1:
                    _, once = np.unique(gram_hash(lang, 64 + size, columns[:-1]), return_index=True)
                    context = [c[once] for c in columns[:-1]]
                    hashes.append(gram_hash(lang, 64 + size, context))
                    values.append(part["back"].to_numpy(np.float32)[once])
                    where.append(place(context) if size > 2 else place(context[:1]))
                hashes, values, where = map(np.concatenate, (hashes, values, where))
                for s in np.unique(where):
                    own = where == s
                    yield pd.DataFrame({"slice": [s], "hashes": [hashes[own].tobytes()], "values": [values[own].tobytes()]})

    return stage(model.mapInPandas(run, "slice long, hashes binary, values binary"), "arrays")


def load_slice(arrays: DataFrame, which: int, slices: Slices) -> SortedArrays:
    lowest = next((first for first, k in slices.own.values() if first <= which < first + k), which)
    rows = arrays.where(F.col("slice").isin(which, -1 - lowest)).select("hashes", "values").toArrow()
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in rows["hashes"]]
    hashes = np.concatenate(parts or [np.empty(0, np.uint64)])
    del parts
    values = np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in rows["values"]] or [np.empty(0, np.float32)])
    del rows
    pa.default_memory_pool().release_unused()
    return SortedArrays(hashes, values)


def log_probabilities(arrays: SortedArrays, lang: str, columns: list[np.ndarray]) -> np.ndarray:
    """Of the last characters of n-grams, backing off to shorter contexts where an n-gram wasn't seen."""
    out = np.zeros(len(columns[0]))
    rest, weight = np.arange(len(out)), np.zeros(len(out))
    for k in range(ORDER, 0, -1):
        columns = columns[-k:]
        found = arrays.find(gram_hash(lang, k, columns)).astype(np.float64)
        hit = ~np.isnan(found)
        out[rest[hit]] = weight[rest[hit]] + found[hit]
        miss = ~hit
        rest = rest[miss]
        if not len(rest):
            return out
        columns = [x[miss] for x in columns]
        if k > 1:
            back = arrays.find(gram_hash(lang, 64 + k, columns[:-1]))
            weight[rest] += np.nan_to_num(back, nan=0.0)
    out[rest] = weight[rest] + FLOOR
    return out


def shared_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose keys stand for all, and which of them each place has; some equal keys stay apart where slots collide."""
    slots = (keys * SPREAD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    last = np.zeros(1 << SLOT_BITS, np.int32)
    last[slots] = np.arange(len(keys), dtype=np.int32)
    place = last[slots]
    other = np.flatnonzero(keys[place] != keys)
    place[other] = other
    chosen = np.zeros(len(keys), bool)
    chosen[place] = True
    return np.flatnonzero(chosen), (np.cumsum(chosen, dtype=np.int32) - 1)[place]


def distinct_grams(alphabet: Alphabet, c: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the n-grams that end at ``at``, mostly once each if the alphabet has room, and which of them each place has."""
    keys = alphabet.keys(c)
    if keys is None:
        alphabet.__init__()
        keys = alphabet.keys(c)
    if keys is None:
        return [c[at - k] for k in range(ORDER - 1, -1, -1)], np.arange(len(at))
    keys = keys[at - ORDER + 1]
    chosen, which = shared_places(keys)
    return alphabet.columns(keys[chosen]), which


def word_hashes(data: bytes) -> np.ndarray:
    """Of words parted by single blanks: equal words have equal ones."""
    n = len(data)
    if n > len(POWERS):
        return np.fromiter(map(hash, data.split(b" ")), np.int64).astype(np.uint64)
    c = np.frombuffer(data, np.uint8)
    starts = np.append(0, np.flatnonzero(c == 32) + 1)
    return np.add.reduceat(POWERS[:n] * BYTE_VALUES[c], starts) * INVERSES[starts]


def found_twice(values: np.ndarray) -> np.ndarray:
    """Places of the values that occur twice or more."""
    order = np.sort(values)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return np.empty(0, np.int64)
    return np.flatnonzero(again[np.minimum(np.searchsorted(again, values), len(again) - 1)] == values)


def n_repeated(data: bytes) -> int:
    """Words, parted by single blanks, in windows of three that occur twice or more: sought by hashes, then settled by the words."""
    h = word_hashes(data) if data else np.empty(0, np.uint64)
    if len(h) < 4:
        return 0
    at = found_twice((h[:-2] * SPREAD + h[1:-1]) * SPREAD + h[2:])
    if not len(at):
        return 0
    words = data.split(b" ")
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pair = ids[at] * len(known) + ids[at + 1]
    if len(known) >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    at = at[found_twice(pair * len(known) + ids[at + 2])]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def base_counts(text: str | None, clean: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words joined by single blanks."""
    data, joined = (text or "").encode(), clean.encode()
    blanks = joined.count(b" ")
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return blanks + bool(joined), len(clean) - blanks, symbols, len(lines) - len(set(lines)), n_repeated(joined)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_slice(docs: DataFrame, arrays: SortedArrays, which: int, slices: Slices) -> DataFrame:
    """row, doc_id, lang, logp (this slice's share), characters scored; the first slice of a model also gives the base counts.  Written before the arrays are dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        alphabet = Alphabet()
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                b = batch.slice(begin, ROWS)
                originals, of_model = b["text"].to_pylist(), {}
                for i, model in enumerate(b["model"].to_pylist()):
                    of_model.setdefault(model, []).append(i)
                counts = np.zeros((len(COUNTS), len(originals)), np.int64)
                total, scored = np.zeros(len(originals)), np.zeros(len(originals), np.int64)
                for model, rows in of_model.items():
                    rows = np.array(rows)
                    first, k = slices.of(model)
                    texts = [normal(originals[i]) for i in rows]
                    if first == which:
                        counts[:, rows] = np.array([base_counts(originals[i], t) for i, t in zip(rows, texts, strict=True)]).T
                    for part in _chunks(texts):
                        c = codes([texts[i] for i in part])
                        at = np.flatnonzero(c != MARK)
                        owner = np.repeat(np.arange(len(part)), [len(texts[i]) + ORDER - 1 for i in part])[at]
                        if not len(at):
                            continue
                        columns, gram = distinct_grams(alphabet, c, at)
                        if k > 1:
                            own = route(columns[-3], columns[-2], k) == which - first
                            logp = np.zeros(len(own))
                            logp[own] = log_probabilities(shared.value, model, [x[own] for x in columns])
                            scored[rows[part]] += np.bincount(owner[own[gram]], minlength=len(part))
                        else:
                            logp = log_probabilities(shared.value, model, columns)
                            scored[rows[part]] += np.bincount(owner, minlength=len(part))
                        total[rows[part]] += np.bincount(owner, logp[gram], len(part))
                yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], b["lang"], pa.array(total), pa.array(scored), *map(pa.array, counts)], ["row", "doc_id", "lang", "logp", "scored", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row binary, doc_id {kind}, lang string, logp double, scored long, " + ", ".join(f"{x} long" for x in COUNTS)
    out = stage(docs.where(slices.texts_of(which, F.col("model"))).mapInArrow(run, schema), f"scores-{which}")
    shared.destroy()
    return out


def perplexities(docs: DataFrame, model: DataFrame, half: Column | None = None) -> DataFrame:
    """row (a key of text and language), doc_id, lang, log_ppl (null without characters) and base counts, one row for each row of ``docs``.

    ``half``: of the model that scores a text; by default the one that hasn't seen it.
    """
    slices = Slices(model)
    arrays = model_arrays(model, slices)
    docs = docs.select(text_key().alias("row"), "doc_id", language().alias("lang"), model_of(1 - half_of_text() if half is None else half).alias("model"), "text")
    parts = [score_slice(docs, load_slice(arrays, i, slices), i, slices) for i in range(slices.count)]
    firsts = {*range(slices.shared), *(first for first, _ in slices.own.values())}
    union = lambda ps: reduce(DataFrame.unionByName, ps)
    out = union([p for i, p in enumerate(parts) if i in firsts])
    if len(firsts) < len(parts):
        # equal rows get equal sums from every slice, so one of them stands for all
        rest = union([p.dropDuplicates(["row"]) for i, p in enumerate(parts) if i not in firsts]).groupBy("row").agg(F.sum("logp").alias("more"), F.sum("scored").alias("also"))
        out = out.join(rest, "row", "left").withColumn("logp", F.col("logp") + F.coalesce("more", F.lit(0.0))).withColumn("scored", F.col("scored") + F.coalesce("also", F.lit(0)))
    return out.select("row", "doc_id", "lang", F.when(F.col("scored") > 0, -F.col("logp") / F.col("scored")).alias("log_ppl"), *COUNTS)


def bands(scored: DataFrame) -> DataFrame:
    """b_lang, low, high: exact quartiles of the binned log perplexity of each language's distinct texts."""
    once = scored.where("log_ppl is not null").groupBy("lang", "row").agg(F.floor(F.min("log_ppl") / BIN).alias("bin"))
    bins = once.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin")
    ranked = bins.select("lang", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * BIN
    q = ranked.groupBy("lang").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(5 * BIN))
    return q.select(F.col("lang").alias("b_lang"), (F.col("q2") - WIDTH_BELOW * spread).alias("low"), (F.col("q2") + WIDTH_ABOVE * spread).alias("high"))


def verdicts(docs: DataFrame) -> DataFrame:
    """One for each row: row key, doc_id, base counts, base_failed, kept, log_ppl and the band of its language."""
    model = stage(estimate(stage(count_grams(docs), "grams")), "kneser-ney")
    scored = stage(perplexities(docs, model), "perplexity")
    band = bands(scored)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.col("log_ppl").between(F.col("low"), F.col("high"))
    out = scored.join(band, scored["lang"] == band["b_lang"], "left")
    return out.select("row", "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"), "log_ppl", "low", "high")


def judge(docs: DataFrame) -> DataFrame:
    return verdicts(docs).drop("row")


def keep_passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose verdict, which depends on text and language alone, is kept."""
    gone = stage(verdicts(docs).where("not kept").select(F.col("row").alias("gone")).distinct(), "rejected")
    return docs.join(gone, text_key() == gone["gone"], "left_anti")
