"""Suffix-array dedup: bytes covered by a 400-byte string that starts more than once, by deep-shallow sorting.

Sorting all suffixes of a corpus would move every byte hundreds of times, so suffixes are first dealt to groups by a
content-defined anchor: the 64-byte string of least hash inside each 400-byte window.  Equal windows have equal anchors
at equal distance, so groups never split a match.  Neighbouring windows with one anchor form an occurrence: anchor,
range of distances, and the context that covers its windows.

1. Anchors that occur once have no repeated window.  A context that occurs twice repeats in all its windows.
2. What is left, a context of its own whose anchor recurs, is decided within its group: the texts right of the anchor
   and, reversed, left of it are sorted by multikey quicksort to a shallow depth and blind tries below it; from the
   orders and common-prefix lengths follow the classes of equal windows at every distance.
3. Groups with more contexts than a task should sort (a passage that a third of all documents hold) are decided by
   digests instead, summed before the shuffle: first of the part common to 16 neighbouring windows, then of the windows
   whose part isn't found once, in blocks that no other equals.  This is exact for any group size.

``n_passage_words`` beside these counts the words in passages of over 50 words that another document holds too, however
blanks separate them: the same occurrences over hashes of words, with windows of 51 words.

Null text counts as empty; texts under 400 bytes keep all; repeated rows are copies of each other, rows of equal id and
text are one and the same and get equal results; an empty table gives no rows; other columns of the table, whatever
their names, play no part.  Hashes have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, stage

WINDOW = 400
ANCHOR = 64
#: Passages: windows of so many words, anchors of so many.
PASSAGE, PASSAGE_ANCHOR = 51, 16
BYTES, WORDS = 0, 1
SHALLOW = 8
#: Contexts that are sorted together at most.
GROUP = 512
BLOCK = 16
PLACES = 24
SEGMENT = 1 << 23
#: Symbols of short sequences that are hashed together.
TOGETHER = 1 << 16

_random = np.random.default_rng(400)
_TABLES = [_random.integers(0, 1 << 64, 256, dtype=np.uint64) for _ in range(2)]
_BASES = [int(_random.integers(1 << 32, 1 << 62)) * 2 + 1 for _ in range(2)]
_INVERSES = [pow(b, -1, 1 << 64) for b in _BASES]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Digests:
    """Hashes of any part of a sequence from two prefix sums of its symbols' codes."""

    def __init__(self, codes: list[np.ndarray]) -> None:
        self.n = len(codes[0])
        self.sums = []
        for own, inverse in zip(codes, _INVERSES, strict=True):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(own * powers(inverse, self.n), out=s[1:])
            self.sums.append(s)

    def of(self, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return mixed((s[stop] - s[start]) * powers(_BASES[which], self.n + 1)[start])

    def each(self, width: int) -> np.ndarray:
        """Of every part of ``width`` symbols, as ``of`` gives with the first prefix sum."""
        s = self.sums[0]
        return mixed((s[width:] - s[:-width]) * powers(_BASES[0], self.n + 1)[: self.n - width + 1])


def byte_codes(data: np.ndarray) -> list[np.ndarray]:
    return [table[data] for table in _TABLES]


_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def word_hashes(raws: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    out: list[list[np.ndarray]] = [[] for _ in raws]
    chunk: list[tuple[int, bytes]] = []

    def flush() -> None:
        data = np.frombuffer(b" ".join([*(raw for _, raw in chunk), b""]), np.uint8)
        word = np.concatenate([[False], ~_BLANK[data], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        hashes = Digests(byte_codes(data)).of(edge[::2], edge[1::2], 0)
        ends = np.cumsum([len(raw) + 1 for _, raw in chunk])
        for (i, _), own in zip(chunk, np.split(hashes, np.searchsorted(edge[::2], ends[:-1])), strict=True):
            out[i].append(own)
        chunk.clear()

    size = 0
    for i, raw in enumerate(raws):
        parts = [raw]
        if len(raw) > SEGMENT:
            words, parts, at, own = raw.split(), [], 0, 0
            for j, w in enumerate(words):
                own += len(w) + 1
                if own > TOGETHER or j + 1 == len(words):
                    parts.append(b" ".join(words[at : j + 1]))
                    at, own = j + 1, 0
        for part in parts:
            chunk.append((i, part))
            size += len(part)
            if size > TOGETHER:
                flush()
                size = 0
    if chunk:
        flush()
    return [np.concatenate(x) if x else np.empty(0, np.uint64) for x in out]


def word_codes(hashes: np.ndarray) -> list[np.ndarray]:
    return [mixed(hashes + np.uint64(i)) for i in (1, 2)]


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from minima upwards and downwards within blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


COLUMNS = ("p", "lo", "hi", "h", "c1", "c2", "n")


def occurrences(sequences: list[np.ndarray], codes, window: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of whole sequences at a time: which one, and COLUMNS: anchor place, first and last window start, anchor hash, two context hashes, times found there (below 0: found so often before)."""
    pieces: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for i, x in enumerate(sequences):
        cuts = range(0, max(0, len(x) - window + 1), SEGMENT)
        pieces += [(i, at, x[at : at + SEGMENT + window - 1]) for at in cuts]
        size += len(x)
        if size > TOGETHER and pieces:
            yield _told(pieces, codes, window, anchor)
            pieces, size = [], 0
    if pieces:
        yield _told(pieces, codes, window, anchor)


def _told(pieces: list[tuple[int, int, np.ndarray]], codes, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Occurrences of the pieces (sequence, offset, symbols), those of long ones by themselves."""
    groups: list[list[tuple[int, int, np.ndarray]]] = [[]]
    size = 0
    for piece in pieces:
        size += len(piece[2])
        if size > SEGMENT + (1 << 22):
            groups.append([])
            size = len(piece[2])
        groups[-1].append(piece)
    i, p, lo, hi, h, c1, c2 = map(np.concatenate, zip(*(_occurrences(g, codes, window, anchor) for g in groups if g), strict=True))
    order = np.lexsort((c2, c1, h, i))
    differs = np.ones(len(i), bool)
    differs[1:] = np.any([x[order][1:] != x[order][:-1] for x in (i, h, c1, c2)], axis=0)
    first = np.flatnonzero(differs)
    counts = np.diff(np.append(first, len(i)))
    n = np.empty(len(i), np.int64)
    n[order] = np.repeat(first, counts) - np.arange(len(i))
    n[order[first]] = counts
    return i, p, lo, hi, h.view(np.int64), c1.view(np.int64), c2.view(np.int64), n


def joined_repeats(i, p, lo, hi, h, c1, c2, n) -> tuple[np.ndarray, ...]:
    """Occurrences whose context was found before in the same text are decided; their windows become runs without hashes."""
    again = np.flatnonzero(n < 0)
    if not len(again):
        return i, p, lo, hi, h, c1, c2, n
    begin = np.flatnonzero(np.concatenate([[True], (lo[again][1:] != hi[again][:-1] + 1) | (i[again][1:] != i[again][:-1])]))
    end = np.concatenate([begin[1:], [len(again)]]) - 1
    own, zeros = np.flatnonzero(n > 0), np.zeros(len(begin), np.int64)
    p, h, c1, c2, n = (np.concatenate([x[own], zeros]) for x in (p, h, c1, c2, n))
    return np.concatenate([i[own], i[again][begin]]), p, np.concatenate([lo[own], lo[again][begin]]), np.concatenate([hi[own], hi[again][end]]), h, c1, c2, n


def _occurrences(pieces: list[tuple[int, int, np.ndarray]], codes, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    lengths = np.array([len(x) for _, _, x in pieces])
    starts = np.cumsum(lengths) - lengths
    d = Digests(codes(np.concatenate([x for _, _, x in pieces])))
    at = np.arange(d.n - anchor + 1)
    hashes = d.each(anchor)
    low = np.uint64((1 << PLACES) - 1)
    least = sliding_least((hashes & ~low) | at.astype(np.uint64), window - anchor + 1)
    begin = np.flatnonzero(at[: d.n - window + 1] + window <= np.repeat(starts + lengths, lengths)[: d.n - window + 1])
    p = (least[begin] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (begin[1:] != begin[:-1] + 1)]))
    lo, hi, p = begin[new], begin[np.append(new[1:], len(begin)) - 1], p[new]
    shape = ((p - lo) << 10 | (p - hi)).astype(np.uint64)
    c1 = mixed(d.of(lo, hi + window, 0) + shape)
    c2 = mixed(d.of(lo, hi + window, 1) + shape)
    piece = np.searchsorted(starts, lo, "right") - 1
    which, shift = np.array([x[0] for x in pieces])[piece], np.array([x[1] for x in pieces])[piece] - starts[piece]
    return which, p + shift, lo + shift, hi + shift, hashes[p], c1, c2


def anchors(keyed: DataFrame) -> DataFrame:
    """unit, row and COLUMNS: the occurrences over bytes and over words."""

    def frame(unit: int, rows: np.ndarray, i: np.ndarray, *found: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"unit": np.full(len(i), unit, np.int32), "row": rows[i]} | dict(zip(COLUMNS, found, strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                rows = np.array([bytes(r) for r in part["row"]], object)
                raws = [(t or "").encode() for t in part["text"]]
                for found in occurrences([np.frombuffer(r, np.uint8) for r in raws], byte_codes, WINDOW, ANCHOR):
                    yield frame(BYTES, rows, *joined_repeats(*found))
                for found in occurrences(word_hashes(raws), word_codes, PASSAGE, PASSAGE_ANCHOR):
                    # one of equal contexts in a text stands for all; the anchor's 64 bits and as many of the context tell them apart
                    *own, c2, n = (x[found[-1] > 0] for x in found)
                    yield frame(WORDS, rows, *own, np.zeros_like(c2), np.ones_like(n))

    return keyed.select("row", "text").mapInPandas(run, "unit int, row binary, p long, lo long, hi long, h long, c1 long, c2 long, n long")


# -- deep-shallow sorting ------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return n if not differ else ((differ & -differ).bit_length() - 1) // 8


class BlindTrie:
    """Branches by single characters at stated depths; skipped characters are compared once, with the leaf that is reached."""

    def __init__(self, strings: list[bytes], first: int) -> None:
        self.strings = strings
        self.root: list | int = first

    @staticmethod
    def _char(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        s, node, path = self.strings[i], self.root, []
        while not isinstance(node, int):
            path.append(node)
            c = self._char(s, node[0])
            node = node[1].get(c) if c in node[1] else next(iter(node[1].values()))
        depth = common_prefix(s, self.strings[node])
        other = self._char(self.strings[node], depth)
        above, node = None, self.root
        for step in path:
            if step[0] >= depth:
                node = step
                break
            above, node = step, step[1].get(self._char(s, step[0]))
        if not isinstance(node, int) and node is not None and node[0] == depth:
            c = self._char(s, depth)
            if c in node[1]:  # equal strings share a leaf chain
                node[2].append(i)
            else:
                node[1][c] = i
            return
        c = self._char(s, depth)
        if c == other:
            branch: list = [depth, {c: node}, [i]]
        else:
            branch = [depth, {other: node, c: i}, []]
        if above is None:
            self.root = branch
        else:
            above[1][self._char(s, above[0])] = branch

    def in_order(self) -> list[int]:
        out: list[int] = []
        todo: list = [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                todo += [child for _, child in sorted(node[1].items(), key=lambda x: x[0], reverse=True)]
                todo += node[2]
        return out


def deep_shallow(strings: list[bytes], depth: int = 0) -> tuple[list[int], list[int]]:
    """Sorted order and common-prefix length of each string with the one before it (first: 0); all share ``depth`` characters."""
    order: list[int] = []
    deep = depth + SHALLOW
    todo = [(list(range(len(strings))), depth)]
    while todo:
        part, at = todo.pop()
        if len(part) == 1:
            order.append(part[0])
        elif at >= deep:
            trie = BlindTrie(strings, part[0])
            for i in part[1:]:
                trie.insert(i)
            order += trie.in_order()
        else:
            chars = [strings[i][at] if at < len(strings[i]) else -1 for i in part]
            pivot = chars[len(chars) // 2]
            below = [i for i, c in zip(part, chars, strict=True) if c < pivot]
            same = [i for i, c in zip(part, chars, strict=True) if c == pivot]
            above = [i for i, c in zip(part, chars, strict=True) if c > pivot]
            if above:
                todo.append((above, at))
            if pivot < 0:
                todo += [([i], at) for i in same]
            else:
                todo.append((same, at + 1))
            if below:
                todo.append((below, at))
    return order, [0, *(common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False))]


def repeated_distances(contexts: list[bytes], near: list[int], far: list[int]) -> np.ndarray:
    """For every context and distance, whether its window there equals another context's; near and far: ranges of distances."""
    n = len(contexts)
    right = [c[f:] for c, f in zip(contexts, far, strict=True)]
    left = [c[f - 1 :: -1] if f else b"" for c, f in zip(contexts, far, strict=True)]
    base, top = min(near), max(far)
    out = np.zeros((n, top - base + 1), bool)
    r_order, r_common = deep_shallow(right, ANCHOR)
    l_order, l_common = deep_shallow(left)
    distance = np.arange(base, top + 1)
    active = (distance >= np.array(near)[:, None]) & (distance <= np.array(far)[:, None])
    r_class, l_class = np.empty((n, len(distance)), np.int64), np.empty((n, len(distance)), np.int64)
    r_class[r_order] = np.cumsum(np.array(r_common)[:, None] < WINDOW - distance, axis=0)
    l_class[l_order] = np.cumsum(np.array(l_common)[:, None] < distance, axis=0)
    key = np.where(active, r_class * (n + 1) + l_class, -1 - np.arange(n)[:, None])
    sort = np.argsort(key, axis=0, kind="stable")
    ranked = np.take_along_axis(key, sort, axis=0)
    equal = ranked[1:] == ranked[:-1]
    twin = np.zeros_like(active)
    twin[1:] |= equal
    twin[:-1] |= equal
    np.put_along_axis(out, sort, twin, axis=0)
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def span_frame(rows: list[tuple[bytes, int, int]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["row", "lo", "hi"]).astype({"lo": "int64", "hi": "int64"})


def sorted_groups(contexts: DataFrame) -> DataFrame:
    """row, lo, hi: window starts that repeat, of the contexts marked alone.  A group's rows meet in one task, in order."""

    def decide(group: pd.DataFrame) -> Iterator[tuple[int, int, int]]:
        near, far = (group["p"] - group["hi"]).tolist(), (group["p"] - group["lo"]).tolist()
        flags = repeated_distances([bytes(c) for c in group["context"]], near, far)
        base = min(near)
        for row, p, alone, own in zip(group["row"], group["p"], group["alone"], flags, strict=True):
            if alone:
                for a, b in runs(own):
                    yield row, p - base - b, p - base - a

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            h = b["h"].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, int)
            out = [x for s, e in zip(edges[:-1], edges[1:], strict=True) for x in decide(b.iloc[s:e])]
            held = b.iloc[edges[-1] :] if len(edges) else None
            yield span_frame(out)
        if held is not None and len(held):
            yield span_frame(list(decide(held)))

    return contexts.repartition("h").sortWithinPartitions("h").mapInPandas(run, "row binary, lo long, hi long")


def _tagged(d: Digests, start: np.ndarray, stop: np.ndarray, tag: np.ndarray) -> list[np.ndarray]:
    return [mixed(d.of(start, stop, w) ^ mixed(tag * np.uint64(0x9E3779B97F4A7C15))).view(np.int64) for w in (0, 1)]


def _per_context(contexts: DataFrame, digests, schema: str) -> DataFrame:
    """Rows of ``digests(x, its substring hashes, nearest and farthest distance)``, a data frame, for every context x."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                yield pd.concat([digests(x, Digests(byte_codes(np.frombuffer(bytes(x.context), np.uint8))), x.p - x.hi, x.p - x.lo) for x in b.iloc[at : at + 256].itertuples()])

    return contexts.mapInPandas(run, schema)


def _block_digests(x, d: Digests, near: int, far: int) -> pd.DataFrame:
    """at, k1, k2, f1, f2: of each block of distances the part common to its windows, and all that its windows cover."""
    o = np.arange(near // BLOCK, far // BLOCK + 1)
    h = np.uint64(x.h & 0xFFFFFFFFFFFFFFFF)
    low, high = np.maximum(o * BLOCK, near), np.minimum(o * BLOCK + BLOCK - 1, far)
    part = _tagged(d, np.maximum(far - o * BLOCK, 0), np.minimum(far - (o * BLOCK + BLOCK - 1) + WINDOW, d.n), h + o.astype(np.uint64))
    full = _tagged(d, far - high, far - low + WINDOW, h + (low << 10 | high).astype(np.uint64))
    return pd.DataFrame({"row": x.row, "p": x.p, "at": o, "k1": part[0], "k2": part[1], "f1": full[0], "f2": full[1]})


def _window_digests(x, d: Digests, near: int, far: int) -> pd.DataFrame:
    """at, k1, k2, weight: of the windows in blocks that aren't settled; those of a block that stands for equal ones count twice."""
    lone, settled, stands = (np.array([] if v is None else v, np.int64) for v in (x.lone, x.settled, x.stands))
    o = np.arange(near, far + 1)
    block = o // BLOCK
    o = o[~np.isin(block, lone) & (~np.isin(block, settled) | np.isin(block, stands))]
    k = _tagged(d, far - o, far - o + WINDOW, np.uint64(x.h & 0xFFFFFFFFFFFFFFFF) + o.astype(np.uint64))
    return pd.DataFrame({"row": x.row, "p": x.p, "at": o, "k1": k[0], "k2": k[1], "weight": np.where(np.isin(o // BLOCK, stands), 2, 1)})


def _found_once(digests: DataFrame, name: str, times) -> DataFrame:
    """row, p, and the places whose digest nothing else has: sums that combine before the shuffle, and no join back to all rows."""
    once = digests.groupBy("k1", "k2").agg(times.alias("times"), F.min(F.struct("row", "p", "at")).alias("one")).where("times = 1").select("one.*")
    return once.groupBy(F.col("row").alias("r"), F.col("p").alias("q")).agg(F.collect_set("at").alias(name))


def counted_groups(contexts: DataFrame) -> DataFrame:
    """As sorted_groups, for groups of any size: a window is repeated unless its block's part or itself is found once.

    Blocks that equal another one in all their windows are settled; one of them stands for all.
    """
    same = (F.col("row") == F.col("r")) & (F.col("p") == F.col("q"))
    parts = stage(_per_context(contexts, _block_digests, "row binary, p long, at long, k1 long, k2 long, f1 long, f2 long"), "parts")
    full = parts.groupBy("f1", "f2").agg(F.count("*").alias("times"), F.min(F.struct("row", "p", "at")).alias("one"))
    stands = full.where("times > 1").select("one.*").groupBy(F.col("row").alias("r"), F.col("p").alias("q")).agg(F.collect_set("at").alias("stands"))
    alone = full.where("times = 1").select("one.*").groupBy(F.col("row").alias("r"), F.col("p").alias("q")).agg(F.collect_set("at").alias("open"))
    known = contexts.join(_found_once(parts, "lone", F.count("*")), same, "left").drop("r", "q").join(stands, same, "left").drop("r", "q").join(alone, same, "left").drop("r", "q")
    blocks = F.sequence(F.floor((F.col("p") - F.col("hi")) / BLOCK), F.floor((F.col("p") - F.col("lo")) / BLOCK))
    known = stage(known.withColumn("settled", F.array_except(blocks, F.coalesce("open", F.array().cast("array<bigint>")))).drop("open"), "blocks")
    windows = _found_once(_per_context(known, _window_digests, "row binary, p long, at long, k1 long, k2 long, weight long"), "single", F.sum("weight"))
    asked = known.where("alone").select("row", "p", "lo", "hi", "lone").join(windows, same, "left").drop("r", "q")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b.itertuples():
                o = np.arange(x.p - x.hi, x.p - x.lo + 1)
                again = np.ones(len(o), bool)
                for places, own in ((x.lone, o // BLOCK), (x.single, o)):
                    if places is not None:
                        again &= ~np.isin(own, places)
                out += [(x.row, x.p - int(o[j]), x.p - int(o[i])) for i, j in runs(again)]
            yield span_frame(out)

    return asked.select("row", "p", "lo", "hi", "lone", "single").mapInPandas(run, "row binary, lo long, hi long")


def kinds_of(found: DataFrame, name: str, times) -> tuple[DataFrame, DataFrame]:
    """Occurrences whose anchor recurs, and of these one for each context with ``times``, how often (or in how many texts) it is found."""
    recurring = stage(found.groupBy("h").agg(times.alias("times")).where("times > 1").select("h"), f"{name}-anchors")
    rest = stage(found.join(recurring, "h"), f"{name}-recurring")
    kinds = rest.groupBy("h", "c1", "c2").agg(times.alias("times"), F.min(F.struct("row", "p", "lo", "hi")).alias("one"))
    return rest, stage(kinds.select("h", "c1", "c2", "times", "one.*"), f"{name}-contexts")


def open_kinds(kinds: DataFrame, unit: int, name: str) -> DataFrame:
    """row, x: the contexts of anchors that have several of them, not all of which are known to repeat."""
    groups = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.count_if(F.col("times") == 1).alias("alone")).where("kinds > 1 and alone > 0")
    groups = stage(groups.select("h", (F.col("kinds") > GROUP).alias("large")), f"{name}-open")
    return kinds.join(groups, "h").select("row", F.struct(F.lit(unit).alias("unit"), "h", "p", "lo", "hi", (F.col("times") == 1).alias("alone"), "large").alias("x"))


def cut_contexts(keyed: DataFrame, asked: DataFrame) -> DataFrame:
    """row, unit, h, p, lo, hi, alone, large, context: the bytes, or hashes of words, that the windows of an occurrence cover."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size = [], 0
            for row, text, xs in zip(b["row"], b["text"], b["xs"], strict=True):
                raw = (text or "").encode()
                words = word_hashes([raw])[0] if any(x["unit"] == WORDS for x in xs) else None
                for x in xs:
                    lo, hi = x["lo"], x["hi"]
                    part = raw[lo : hi + WINDOW] if x["unit"] == BYTES else words[lo : hi + PASSAGE].tobytes()
                    out.append((bytes(row), x["unit"], x["h"], x["p"], lo, hi, x["alone"], x["large"], part))
                    size += len(part)
                if size > 1 << 24:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    fields = "row binary, unit int, h long, p long, lo long, hi long, alone boolean, large boolean, context binary"
    names = [x.split()[0] for x in fields.split(", ")]
    xs = asked.groupBy(F.col("row").alias("of")).agg(F.collect_list("x").alias("xs"))
    return keyed.join(xs, F.col("row") == F.col("of")).select("row", "text", "xs").mapInPandas(run, fields)


def passage_windows(contexts: DataFrame) -> DataFrame:
    """row, lo, k1, k2, alone: the digests of every word window of the contexts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2048):
                x = b.iloc[at : at + 2048]
                words = [np.frombuffer(bytes(c), np.uint64) for c in x["context"]]
                lengths = np.array([len(w) for w in words])
                d, starts = Digests(word_codes(np.concatenate(words))), np.cumsum(lengths) - lengths
                p, lo = x["p"].to_numpy(), x["lo"].to_numpy()
                n = x["hi"].to_numpy() - lo + 1
                of = np.repeat(np.arange(len(x)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first = starts[of] + step
                k = _tagged(d, first, first + PASSAGE, x["h"].to_numpy().view(np.uint64)[of] + (p[of] - lo[of] - step).astype(np.uint64))
                rows = np.array([bytes(r) for r in x["row"]], object)
                yield pd.DataFrame({"row": rows[of], "lo": lo[of] + step, "k1": k[0], "k2": k[1], "alone": x["alone"].to_numpy()[of]})

    return contexts.mapInPandas(run, "row binary, lo long, k1 long, k2 long, alone boolean")


def shared_passages(rest: DataFrame, kinds: DataFrame, contexts: DataFrame) -> DataFrame:
    """row, lo, hi: runs of starts of word windows that another document holds: those of a shared context, and single ones of the others."""
    # the windows are made twice from the contexts, which takes less than writing them
    own = ["h", "c1", "c2"]
    shared = stage(kinds.where("times > 1").select(*own), "shared")
    windows = passage_windows(contexts)
    held = windows.groupBy("k1", "k2").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.bool_and("alone").alias("alone")).where("a != b or not alone")
    found = windows.where("alone").join(stage(held.select("k1", "k2"), "held"), ["k1", "k2"], "left_semi")
    return rest.join(shared, own, "left_semi").select("row", "lo", "hi").unionByName(found.select("row", "lo", F.col("lo").alias("hi")))


def repeated_windows(keyed: DataFrame) -> DataFrame:
    """unit, row, lo, hi: runs of starts of the byte windows that start anywhere else too, and of word windows that other documents hold."""
    found = stage(anchors(keyed), "anchors")
    of_bytes, of_words = found.where(f"unit = {BYTES} and n > 0"), found.where(f"unit = {WORDS}")
    decided = found.where(f"unit = {BYTES} and n = 0").select("row", "lo", "hi")
    rest, kinds = kinds_of(of_bytes, "bytes", F.sum("n"))
    word_rest, word_kinds = kinds_of(of_words, "words", F.count("*"))
    asked = open_kinds(kinds, BYTES, "bytes").unionByName(open_kinds(word_kinds, WORDS, "words"))
    contexts = stage(cut_contexts(keyed, asked), "cuts")
    of_bytes = contexts.where(f"unit = {BYTES}")
    large = of_bytes.where("large")
    alone = kinds.where("times = 1").select(F.col("row").alias("r"), F.col("p").alias("q"))
    whole = rest.join(alone, (F.col("row") == F.col("r")) & (F.col("p") == F.col("q")), "left_anti").select("row", "lo", "hi")
    out = whole.unionByName(sorted_groups(of_bytes.where("not large"))).unionByName(decided)
    if not large.isEmpty():
        out = out.unionByName(counted_groups(large))
    passages = shared_passages(word_rest, word_kinds, contexts.where(f"unit = {WORDS}"))
    return out.withColumn("unit", F.lit(BYTES)).unionByName(passages.withColumn("unit", F.lit(WORDS)))


def same_windows(text: str, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Starts of all word windows of a text that equal one that starts in a run lo to hi."""
    words = word_hashes([text.encode()])[0]
    n = len(words) - PASSAGE + 1
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + 1, -1)
    marked = np.cumsum(change[:-1]) > 0
    if not marked.all():
        each = Digests(word_codes(words)).each(PASSAGE)
        marked |= np.isin(each, each[marked])
    return np.flatnonzero(marked)


def covered(lo: np.ndarray, hi: np.ndarray, window: int, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + window, -1)
    return np.cumsum(change[:-1]) > 0


def strip_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (remaining bytes), n_bytes, n_removed, n_spans, n_passage_words for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(row_key(F.col("doc_id"), text).alias("row"), "doc_id", text.alias("text"))
    spans = repeated_windows(keyed).groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("unit", "lo", "hi")).alias("spans"))
    joined = keyed.join(spans, F.col("row") == F.col("of"), "left").select("doc_id", "text", *[F.col(f"spans.{c}").alias(c) for c in ("unit", "lo", "hi")])

    def one(text: str, unit: np.ndarray | None, lo: np.ndarray | None, hi: np.ndarray | None) -> tuple[bytes, int, int, int, int]:
        raw = text.encode()
        if unit is None:
            return raw, len(raw), 0, 0, 0
        unit, lo, hi = np.asarray(unit), np.asarray(lo), np.asarray(hi)
        b, w = unit == BYTES, unit == WORDS
        gone = covered(lo[b], hi[b], WINDOW, len(raw))
        words = 0
        if w.any():
            at = same_windows(text, lo[w], hi[w])
            words = int(covered(at, at, PASSAGE, int(at[-1]) + PASSAGE).sum())
        return np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), len(runs(gone)), words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [one(*x) for x in zip(b["text"], b["unit"], b["lo"], b["hi"], strict=True)]
            out = pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans", "n_passage_words"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInPandas(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, n_passage_words long")


def repeat_digest(docs: DataFrame) -> DataFrame:
    return strip_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")
