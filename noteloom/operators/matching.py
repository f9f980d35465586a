"""The similarity join of retrieval queries with chunks, and what follows from it.

Queries and chunks of a project meet as rectangles: packs of a few hundred chunks beside packs of queries, both of
bounded size, one row for each pair of packs.  Inside a rectangle everything is a matrix of queries by chunks.  Which
grams of a pack's queries each text holds is one sparse-to-dense table; a product of it with the queries' grams counts
the shared ones of every pair, and tells which substrings can occur at all before any is looked for.  The score is the
greatest of independent pieces of evidence; the sequence ratio, the only one that needs a pair of strings, is computed
for pairs that pass a gate and where its bound by length and letters exceeds the other evidence.  Only accepted pairs
leave the task, at most ``candidates`` of each query, stage and rectangle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import CONFIG, Config
from ..functions import text as T
from ..functions.keys import key_of
from ..sources.sinks import stored, written
from . import prefix
from .slices import map_slices

_LINK = re.compile(C.LINK_NOISE)
_SHORT = re.compile(C.SHORT_NUMBERING)


@lru_cache(maxsize=1 << 10)
def _matcher(b: str) -> SequenceMatcher:
    """What a matcher learns of its second text serves every first one."""
    return SequenceMatcher(None, "", b)


#: Length of a second text from which on the standard library leaves its frequent letters out.
LONG_TEXT = 200


def matched(a: str, b: str) -> int:
    """Letters in the matching blocks of two texts, as the standard library finds them where no letter is left out: the
    longest common stretch, the first one in ``a`` and then in ``b``, and so on before and behind it."""
    total, open_, find = 0, [(0, len(a), 0, len(b))], b.find
    while open_:
        low, high, first, last = open_.pop()
        size = at = place = 0
        i = low
        while i + size < high:
            j = find(a[i : i + size + 1], first, last)
            if j >= 0:
                size, at, place = size + 1, i, j
                # a longer stretch from here on begins where a shorter one does, or behind
                while i + size < high and (j := find(a[i : i + size + 1], j, last)) >= 0:
                    size, place = size + 1, j
            i += 1
        if size:
            total += size
            if low < at and first < place:
                open_.append((low, at, first, place))
            if at + size < high and place + size < last:
                open_.append((at + size, high, place + size, last))
    return total


@lru_cache(maxsize=1 << 14)
def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio with the standard library's rules."""
    if len(b) < LONG_TEXT:
        return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0
    m = _matcher(b)
    m.set_seq1(a)
    return m.ratio()


@lru_cache(maxsize=1 << 12)
def _letters(text: str) -> Counter:
    return Counter(text)


def common_letters(a: str, b: str) -> int:
    x, y = _letters(a), _letters(b)
    return sum(n if n < (m := y.get(k, 0)) else m for k, n in x.items())


#: Pairs of letters for which a table is laid out; with more letters grams are looked up one by one.
MOST_PAIRS = 1 << 22
#: Characters of a stretch of a needle, the length over which stretches are looked for, and how many marks tell them apart.
STRETCH, SPOTS, MARKS = 6, 7, 1 << 16
#: Places of a needle at which its stretches are looked for.
PLACES = 4


class Codes:
    """Texts as one row of code points, each text closed by a zero; keys have none."""

    def __init__(self, texts: list[str]) -> None:
        self.points = self.of("\0".join(texts) + "\0")
        self.text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        self.count = len(texts)
        self.marked: np.ndarray | None = None

    @staticmethod
    def of(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def numbered(self, letters: dict[str, int], points: np.ndarray | None = None) -> np.ndarray:
        """Each code point by its number in letters, others 0."""
        points = self.points if points is None else points
        table = np.zeros(int(points.max(initial=0)) + 1, np.int32)
        for x, i in letters.items():
            if ord(x) < len(table):
                table[ord(x)] = i
        return table[points]

    def counts(self, letters: dict[str, int], most: int | None = None) -> np.ndarray:
        """Texts by letters, numbered from 1: how often each stands in the text, or in its first ``most`` characters."""
        here, text, size = self.points, self.text, len(letters) + 1
        if most is not None:
            sizes = np.bincount(text, minlength=self.count)
            taken = np.minimum(sizes, most)
            starts = np.cumsum(sizes) - sizes - np.cumsum(taken) + taken
            near = np.arange(taken.sum()) + np.repeat(starts, taken)
            here, text = here[near], text[near]
        here = self.numbered(letters, here)
        return np.bincount(text * size + here, minlength=self.count * size).reshape(self.count, size)[:, 1:]

    @staticmethod
    def marks(points: np.ndarray) -> np.ndarray:
        """A mark of each stretch; equal stretches have equal marks."""
        out = np.zeros(max(len(points) - STRETCH + 1, 0), np.uint32)
        for i in range(STRETCH):
            out = out * np.uint32(2654435761) + points[i : i + len(out)]
        return (out ^ (out >> np.uint32(15))) % np.uint32(MARKS)

    def may_hold(self, needles: list[str]) -> np.ndarray:
        """Needles by texts: whether stretches at a few places of the needle may all occur; all needles are longer than SPOTS."""
        sizes = np.array([len(n) for n in needles])
        places = (np.cumsum(sizes) - sizes)[:, None] + (sizes - STRETCH)[:, None] * np.arange(PLACES) // (PLACES - 1)
        wanted = self.marks(self.of("".join(needles)))[places]
        if self.marked is None:
            self.marked = self.marks(self.points)
        column = np.full(MARKS, -1, np.int32)
        different = np.unique(wanted)
        column[different] = np.arange(len(different))
        at, of = column[self.marked], self.text[: len(self.marked)]
        held = np.zeros((len(different), self.count), bool)
        held[at[at >= 0], of[at >= 0]] = True
        return np.logical_and.reduce([held[column[wanted[:, i]]] for i in range(wanted.shape[1])])


class Needles:
    """Strings to look for, by the grams that a text must hold for any of them to occur."""

    def __init__(self, needles: list[str]) -> None:
        self.needles = list(dict.fromkeys(needles))
        self.at = {n: i for i, n in enumerate(self.needles)}
        grams = [self.grams(n, 2 if len(n) > 1 else 1) for n in self.needles]
        self.vocabulary: dict[str, int] = {}
        place = self.vocabulary.setdefault
        at = [place(g, len(self.vocabulary)) for own in grams for g in own]
        self.wanted = np.zeros((len(grams), len(self.vocabulary)), np.float32)
        self.wanted[np.repeat(np.arange(len(grams)), [len(own) for own in grams]), at] = 1

    @staticmethod
    def grams(text: str, size: int) -> set[str]:
        return set(text) if size == 1 else set(map("".join, zip(text, text[1:], strict=False)))

    def table(self, rows: list[set[str]]) -> np.ndarray:
        out, place = np.zeros((len(rows), len(self.vocabulary)), np.float32), self.vocabulary.get
        at = np.array([place(g, -1) for own in rows for g in own], int)
        row = np.repeat(np.arange(len(rows)), [len(own) for own in rows])
        out[row[at >= 0], at[at >= 0]] = 1
        return out

    def held(self, texts: list[str], codes: Codes | None = None) -> np.ndarray:
        """Texts by vocabulary: single characters and pairs."""
        letters = {x: i for i, x in enumerate(dict.fromkeys("".join(self.vocabulary)), 1)}
        size = len(letters) + 1
        if size * size > MOST_PAIRS:
            return self.table([self.grams(t, 1) | self.grams(t, 2) for t in texts])
        codes = codes or Codes(texts)
        column = np.full(size * size, -1, np.int32)
        for g, i in self.vocabulary.items():
            # a single character stands as a pair with none before it, which no pair of known letters is
            column[letters[g[0]] * size + letters[g[1]] if len(g) == 2 else letters[g]] = i
        here = codes.numbered(letters)
        out = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        for at, of in ((column[here], codes.text), (column[np.where(here[:-1] > 0, here[:-1] * size + here[1:], 0)], codes.text[:-1])):
            known = at >= 0
            out[of[known], at[known]] = 1
        return out

    def held_with(self, heads: list[str], texts: list[str], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``held`` of each text behind its head, from that of the text alone, and what begins in the head."""
        begun = self.table([self.grams(h, 1) | self.grams(h + t[:1], 2) if h else set() for h, t in zip(heads, texts, strict=True)])
        return np.maximum(held, begun), begun

    def _possible(self, held: np.ndarray) -> np.ndarray:
        return self.wanted @ held.T >= self.wanted.sum(axis=1)[:, None]

    def found(self, texts: list[str], held: np.ndarray, codes: Codes | None = None) -> np.ndarray:
        """Needles by texts: whether it occurs."""
        out = self._possible(held)
        sizes = np.array([len(n) for n in self.needles])
        out[sizes == 0] = False
        # one and two characters are their own grams
        long = np.nonzero(sizes > 2)[0]
        longer = np.nonzero(sizes > SPOTS)[0]
        if codes and len(longer):
            out[longer] &= codes.may_hold([self.needles[n] for n in longer])
        for n, t in zip(*np.nonzero(out[long]), strict=True):
            if self.needles[long[n]] not in texts[t]:
                out[long[n], t] = False
        return out

    def found_with(self, heads: list[str], texts: list[str], held: np.ndarray, begun: np.ndarray, found: np.ndarray) -> np.ndarray:
        """``found`` of each text behind its head, from that of the text alone: a needle begins in the head or lies in the text."""
        out = found.copy()
        headed = np.array([t for t, h in enumerate(heads) if h], int)
        some = np.array([n for n, needle in enumerate(self.needles) if needle], int)
        if not len(headed) or not len(some):
            return out
        first = [self.vocabulary[self.needles[n][:2]] for n in some]
        open_ = self._possible(held[headed])[some] & ~found[np.ix_(some, headed)] & (begun[np.ix_(headed, first)].T > 0)
        for n, at in zip(*np.nonzero(open_), strict=True):
            t, needle = headed[at], self.needles[some[n]]
            if needle in heads[t] + texts[t][: len(needle) - 1]:
                out[some[n], t] = True
        return out


class Queries:
    """A pack of retrieval queries as arrays; rows: idx, chapter, q_no, query, core, matching, words."""

    def __init__(self, rows: list) -> None:
        self.rows = rows
        self.keys = [key_of(r["matching"]) for r in rows]
        self.lengths = np.array([len(k) for k in self.keys])
        self.cores = [key_of(r["core"]) for r in rows]
        self.words = [[key_of(w) for w in dict.fromkeys(r["words"])] for r in rows]
        self.chapters = [key_of(r["chapter"] or "") for r in rows]
        self.needles = Needles([*self.keys, *self.cores, *(w for ws in self.words for w in ws)])
        self.key_at, self.core_at = ([self.needles.at[x] for x in xs] for xs in (self.keys, self.cores))
        # a query of four characters and more is compared by pairs, as it is looked for, a shorter one by characters
        short = [i for i, k in enumerate(self.keys) if len(k) < 4]
        for g in (x for i in short for x in self.keys[i]):
            self.needles.vocabulary.setdefault(g, len(self.needles.vocabulary))
        self.needles.wanted = np.pad(self.needles.wanted, ((0, 0), (0, len(self.needles.vocabulary) - self.needles.wanted.shape[1])))
        self.grams = self.needles.wanted[self.key_at]
        self.grams[short] = self.needles.table([set(self.keys[i]) for i in short])
        self.has_core = np.array([bool(c) for c in self.cores])
        self.letters = {x: i for i, x in enumerate(dict.fromkeys("".join(self.keys)), 1)}
        own = Codes(self.keys).counts(self.letters) if rows else np.zeros((0, 0), int)
        # a letter that a query has three times is three things to share
        most = own.max(axis=0, initial=0)
        self.letter_at = np.repeat(np.arange(len(most)), most)
        self.nth = np.arange(len(self.letter_at)) - np.repeat(np.cumsum(most) - most, most) + 1
        self.letter_table = self.lettered(own)
        self.word_table = np.zeros((len(rows), len(self.needles.needles)), np.float32)
        for i, ws in enumerate(self.words):
            for w in ws:
                self.word_table[i, self.needles.at[w]] += 1

    def lettered(self, counts: np.ndarray) -> np.ndarray:
        return (counts[:, self.letter_at] >= self.nth).astype(np.float32)

    def common(self, counts: np.ndarray) -> np.ndarray:
        """Queries by texts: letters in common, by the texts' counts of the queries' letters."""
        return self.letter_table @ self.lettered(counts).T

    def shared(self, held: np.ndarray) -> np.ndarray:
        """Queries by texts: share of the query's grams that the text holds."""
        return (self.grams @ held.T) / np.maximum(self.grams.sum(axis=1), 1)[:, None]

    def recalled(self, found: np.ndarray) -> np.ndarray:
        """Queries by texts: the core phrase occurs, or two keywords."""
        return (found[self.core_at] & self.has_core[:, None]) | (self.word_table @ found.astype(np.float32) >= 2)


def has_link(text: str) -> bool:
    # all links but the worded one hold a colon and a slash, which few texts do
    return (":/" in text or "复制" in text) and bool(_LINK.search(text))


class Chunks:
    """A pack of chunks as arrays; rows: chunk_id, chapter_title, section_title, content, page_start, page_end."""

    def __init__(self, rows: list) -> None:
        self.rows = rows
        self.chapter, self.section = ([key_of(r[c] or "") for r in rows] for c in ("chapter_title", "section_title"))
        self.body = [key_of.__wrapped__(r["content"] or "") for r in rows]
        self.near = [s + b for s, b in zip(self.section, self.body, strict=True)]
        self.all = [c + n for c, n in zip(self.chapter, self.near, strict=True)]
        self.codes = Codes(self.body)
        self.titles = sorted({*self.chapter, *self.section})
        self.title_needles, self.title_codes = Needles(self.titles), Codes(self.titles)
        self.chapters = list(dict.fromkeys(self.chapter))
        self.near_chapters: dict[str, np.ndarray] = {}
        place = {t: i for i, t in enumerate(self.titles)}
        self.title_at = [np.array([place[t] for t in ts], int) for ts in (self.section, self.chapter)]
        # place by page and id
        self.order = np.empty(len(rows), np.int64)
        self.order[sorted(range(len(rows)), key=lambda i: (rows[i]["page_start"] is not None, rows[i]["page_start"], rows[i]["chunk_id"]))] = np.arange(len(rows))
        self.factor = np.array([(C.STRUCTURAL_FACTOR if self._structural(i) else 1.0) * (C.LINK_FACTOR if has_link(r["content"] or "") else 1.0) for i, r in enumerate(rows)])

    def alike(self, chapter: str) -> np.ndarray:
        """The sequence ratio of a query's chapter with each different one of the chunks, kept for the next pack of queries."""
        if chapter not in self.near_chapters:
            self.near_chapters[chapter] = np.array([ratio(chapter, c) if chapter and c else 0.0 for c in self.chapters])
        return self.near_chapters[chapter]

    def _structural(self, i: int) -> bool:
        body, titles = self.body[i], self.chapter[i] + self.section[i]
        return len(body) < C.STRUCTURAL_LENGTH and (bool(titles) and (body in titles or titles in body) or C.CONTENTS_WORD in body or len(_SHORT.sub("", body)) <= C.UNNUMBERED_LENGTH)


class Rectangle:
    """Evidence and score of every pair of a pack of queries and a pack of chunks."""

    def __init__(self, q: Queries, c: Chunks) -> None:
        self.q, self.c = q, c
        held = {"body": q.needles.held(c.body, c.codes)}
        found = {"body": q.needles.found(c.body, held["body"], c.codes)}
        for name, heads, inner in (("near", c.section, "body"), ("all", c.chapter, "near")):
            held[name], begun = q.needles.held_with(heads, getattr(c, inner), held[inner])
            found[name] = q.needles.found_with(heads, getattr(c, inner), held[name], begun, found[inner])
        self.grams, self.recalled = q.shared(held["all"]), q.recalled(found["all"])
        self.open = (q.lengths > 0)[:, None] & ((q.lengths > C.STRICT_LENGTH)[:, None] | q.recalled(found["near"]))
        self.base = np.maximum(found["body"][q.key_at] * C.BODY_SCORE, q.shared(held["body"]) * C.GRAM_FACTOR)
        titles = self._titled(q, c)
        for at in c.title_at:
            self.base = np.maximum(self.base, titles[:, at])
        mine, theirs = ({x: n for n, x in enumerate(dict.fromkeys(xs))} for xs in (q.chapters, c.chapters))
        near = np.array([c.alike(a) for a in mine]).reshape(len(mine), len(theirs))
        self.bonus = near[np.ix_([mine[a] for a in q.chapters], [theirs[b] for b in c.chapter])] * C.CHAPTER_BONUS

    @staticmethod
    def _titled(q: Queries, c: Chunks) -> np.ndarray:
        """Queries by titles: equal, or one within the other."""
        inner, outer, keys = c.title_needles, q.needles, list(dict.fromkeys(q.keys))
        at = {k: i for i, k in enumerate(keys)}
        within = inner.found(keys, inner.held(keys)).T[[at[k] for k in q.keys]] | outer.found(c.titles, outer.held(c.titles, c.title_codes))[q.key_at]
        within[:, [t == "" for t in c.titles]] = False
        out = within * C.TITLE_PART_SCORE
        place = {t: n for n, t in enumerate(c.titles)}
        for i, k in enumerate(q.keys):
            if k and k in place:
                out[i, place[k]] = C.TITLE_SCORE
        return out

    def _compared(self) -> list[tuple[list[str], np.ndarray]]:
        """What the sequence ratio compares with each query: section, chapter and head of the chunk, with the bound by their letters in common."""
        q = self.q.lengths[:, None]
        titles = self.q.common(self.c.title_codes.counts(self.q.letters))
        shared = [titles[:, at] for at in self.c.title_at]
        # heads are as long as their query asks; a few lengths, of which each query takes the next one, bound them all
        heads = np.maximum(self.q.lengths * C.HEAD_FACTOR, C.HEAD_LENGTH)
        steps = C.HEAD_LENGTH << np.arange(max(int(heads.max(initial=C.HEAD_LENGTH)) - 1, 0).bit_length() + 1)
        step = np.searchsorted(steps, heads)
        common = np.zeros(self.base.shape, np.float32)
        for n in np.unique(step):
            rows = step == n
            common[rows] = (self.q.letter_table[rows]) @ self.q.lettered(self.c.codes.counts(self.q.letters, int(steps[n]))).T
        shared.append(common)
        sizes = [np.array([len(t) for t in ts]) for ts in (self.c.section, self.c.chapter)]
        sizes = [np.broadcast_to(n, self.base.shape) for n in sizes] + [np.minimum(np.array([len(b) for b in self.c.body]), heads[:, None])]
        return [2 * np.minimum(m, np.minimum(q, n)) / np.maximum(q + n, 1) for m, n in zip(shared, sizes, strict=True)]

    def _lifted(self, kind: int, i: int, j: int, base: float) -> float:
        """``base``, or more where the sequence ratio with the section, chapter or head of the chunk says more."""
        key = self.q.keys[i]
        other = self.c.body[j][: max(len(key) * C.HEAD_FACTOR, C.HEAD_LENGTH)] if kind == 2 else (self.c.section[j], self.c.chapter[j])[kind]
        # the bound of a head that isn't as long as the shortest is not the closest
        if kind == 2 and len(other) > C.HEAD_LENGTH and 2 * common_letters(key, other) / (len(key) + len(other)) * C.SEQUENCE_FACTOR <= base:
            return base
        return max(base, ratio(key, other) * C.SEQUENCE_FACTOR)

    def lift(self, where: np.ndarray, least: np.ndarray | None = None) -> None:
        """Takes the sequence ratio into the base of the pairs marked by ``where``, of each query those that can reach the score ``least``."""
        compared = self._compared()
        if least is not None:
            where = where & (self.scores(np.maximum(self.base, reduce(np.maximum, compared) * C.SEQUENCE_FACTOR)) >= least[:, None])
        for kind, bound in enumerate(compared):
            # pairs of a chunk follow each other, so that what is known of its text serves all of them
            for j, i in zip(*np.nonzero((where & (bound * C.SEQUENCE_FACTOR > self.base)).T), strict=True):
                self.base[i, j] = self._lifted(kind, i, j, self.base[i, j])

    def scores(self, base: np.ndarray | None = None) -> np.ndarray:
        value = np.minimum((self.base if base is None else base) + self.bonus, 1.0)
        # both factors apply to scores below a bound; a lowered score stays below it
        return np.where(value < C.FACTORS_BELOW, value * self.c.factor, value)

    def accepted(self, value: np.ndarray, config: Config) -> np.ndarray:
        """The stage of each pair by its score: 1 primary, 2 with recall evidence, 0 refused."""
        primary = (value >= config.threshold) & ((value >= C.SCORE_GATE) | (self.grams >= C.GRAM_GATE))
        stage = np.where(primary, 1, np.where((value >= config.fallback) & self.recalled, 2, 0))
        return np.where(self.open, stage, 0)

    def stages(self, config: Config) -> tuple[np.ndarray, np.ndarray]:
        """Scores and stages of all pairs that can be among a query's best ``candidates``, see accepted.

        Where as many primary pairs are known, none of stage 2 can be, and no pair is compared any further whose bound lies
        below them all.
        """
        most = config.candidates
        value, least = self.scores(), np.full(len(self.base), config.fallback)
        sure = np.where(self.accepted(value, config) == 1, value, 0)
        if sure.shape[1] >= most > 0:
            least = np.maximum(least, np.partition(sure, -most, axis=1)[:, -most])
        # scores are rounded to four places before they are ranked
        self.lift(self.open & (self.recalled | (self.grams >= C.GRAM_GATE)), least - 1e-4)
        value = self.scores()
        stage = self.accepted(value, config)
        stage[((stage == 1).sum(axis=1) >= most)[:, None] & (stage == 2)] = 0
        return value, stage

    def top_scores(self) -> np.ndarray:
        """Of each query the best score over the chunks, refused ones too.

        A query's pairs are taken by their bounds, the highest first, until none left can be above what is known.
        """
        compared = self._compared()
        bound = reduce(np.maximum, compared) * C.SEQUENCE_FACTOR
        value = np.minimum(np.maximum(self.base, bound) + self.bonus, 1.0)
        most = np.where(self.open, np.where(value < C.FACTORS_BELOW, value * self.c.factor, value), 0)
        out = np.where(self.open, self.scores(), 0).max(axis=1, initial=0)
        for i in range(len(out) if most.shape[1] else 0):
            for j in np.argsort(-most[i], kind="stable"):
                if most[i, j] <= out[i] + 1e-12:
                    break
                base = self.base[i, j]
                for kind, limit in enumerate(compared):
                    if limit[i, j] * C.SEQUENCE_FACTOR > base:
                        base = self._lifted(kind, i, j, base)
                score = min(base + self.bonus[i, j], 1.0)
                out[i] = max(out[i], score * self.c.factor[j] if score < C.FACTORS_BELOW else score)
        return out


def best_pairs(score: np.ndarray, stage: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and chunks of the best ``most`` accepted pairs of each query and stage; scores have four places, order says which chunk of equal ones comes first."""
    # a whole number for each chunk of a query, different for all of them
    place = (10_000 - np.rint(score * 10_000).astype(np.int64)) * max(len(order), 1) + order
    out = []
    for n in (1, 2):
        key = np.where(stage == n, place, np.iinfo(np.int64).max)
        if key.shape[1] > most:
            at = np.argpartition(key, most - 1, axis=1)[:, :most]
            rows, ranks = np.nonzero(np.take_along_axis(key, at, axis=1) != np.iinfo(np.int64).max)
            out.append((rows, at[rows, ranks]))
        else:
            out.append(np.nonzero(stage == n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def prepared(queries: Column) -> Column:
    """Of each query its core phrase, the text that is matched and its keywords."""
    return F.transform(queries, lambda q: F.struct(q.alias("query"), T.prepared_core(q).alias("core"), T.matching_query(q).alias("matching"), T.expanded_keywords(q).alias("words")))


#: Columns of retrieval queries: one row for each query of a topic; plans may bring them prepared.
def retrieval_queries(plans: DataFrame) -> DataFrame:
    ready = F.col("prepared") if "prepared" in plans.columns else prepared(F.col("queries"))
    return plans.select("project", "idx", "chapter", F.posexplode(ready).alias("q_no", "q")).select("project", "idx", "chapter", "q_no", "q.query", "q.core", "q.matching", "q.words")


CANDIDATE = "project string, idx long, q_no int, query string, chunk_id string, score double, stage int, page_start long, page_end long"
QUERY = ["idx", "chapter", "q_no", "query", "core", "matching", "words"]
CHUNK = ["chunk_id", "chapter_title", "section_title", "content", "page_start", "page_end"]
#: Chunks and queries of one rectangle.
PACKED_CHUNKS, PACKED_QUERIES = 256, 1024


#: Topics with their candidates that a Python worker holds at once.
TOPICS_AT_ONCE = 64
#: Characters of chunks in a task of rectangles, so that what its Python worker holds at once doesn't grow with the tables.
TASK_CHARACTERS = 1 << 20


#: Bytes of a project's name and number of packs, about.
NAME_BYTES = 64


def packs(rows: DataFrame, columns: list[str], size: int, name: str, *spread: str, tasks: int | None = None, by: tuple[str, ...] = ("project", "part")) -> DataFrame:
    """project and an array of about ``size`` rows; large projects are dealt to several by a hash of ``spread``, packs to ``tasks`` partitions."""
    large = rows.groupBy("project").agg(F.ceil(F.count("*") / size).alias("parts")).where("parts > 1")
    # few names beside all the rows, which would be moved for them once more
    if large.count() * NAME_BYTES <= CONFIG.broadcast_bytes:
        large = F.broadcast(large)
    dealt = rows.join(large, "project", "left").withColumn("part", F.pmod(F.xxhash64(*spread), F.coalesce("parts", F.lit(1))))
    if tasks:
        dealt = dealt.repartition(tasks, *by)
    return dealt.groupBy("project", "part").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("part")


def rectangles(queries: DataFrame, chunks: DataFrame, config: Config) -> DataFrame:
    """One row for each pair of packs of a project.  Query packs are broadcast where their measured size allows it.

    Where the chunks' measured size asks for more tasks than run at once, they are dealt to as many; where queries aren't
    broadcast either, both sides are dealt by project, so that no pack is sent twice.  Chunks are measured before they are
    packed, so they are written if they aren't a table yet.
    """
    chunks = stored(chunks.select("project", *CHUNK), "chunks")
    size = F.coalesce(F.sum(4 * (F.length("query") + F.length("core") + F.length("matching")) + 64), F.lit(0))
    small = queries.agg(size.alias("n")).first()["n"] <= config.broadcast_bytes
    characters = chunks.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n")).first()["n"]
    tasks = -(-characters // TASK_CHARACTERS)
    deal = {"tasks": tasks if tasks > chunks.sparkSession.sparkContext.defaultParallelism else None, "by": ("project", "part") if small else ("project",)}
    asked = packs(queries, QUERY, PACKED_QUERIES, "queries", "idx", "q_no", **({} if small else deal))
    if small:
        asked = F.broadcast(asked)
    return packs(chunks, CHUNK, PACKED_CHUNKS, "chunks", "chunk_id", **deal).join(asked, "project").select("project", "queries", "chunks")


def _rows(value) -> list[dict]:
    return [dict(r) if not isinstance(r, dict) else r for r in value]


def met(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Queries, Chunks]]:
    """The packs of each rectangle; chunks that meet several packs of queries one after another are prepared once."""
    rows, chunks = None, None
    for b in batches:
        for project, asked, own in zip(b["project"], b["queries"], b["chunks"], strict=True):
            own = _rows(own)
            if chunks is None or rows != own:
                chunks = None
                rows, chunks = own, Chunks(own)
            yield project, Queries(_rows(asked)), chunks


def match_queries(queries: DataFrame, chunks: DataFrame, config: Config = CONFIG, form: str | None = None) -> DataFrame:
    """The best ``candidates`` chunks of every query: primary by score and grams, then those with recall evidence."""
    return top_candidates(scored_pairs(written(queries, "queries"), chunks, config, form), config.candidates)


def scored_pairs(queries: DataFrame, chunks: DataFrame, config: Config = CONFIG, form: str | None = None) -> DataFrame:
    """Accepted pairs: of each query, stage and rectangle the best ``candidates``, among which the best of all are.

    Queries are read several times.
    ``form`` is grams, where pairs come out of joins of rare grams (see prefix), or matrix, where all pairs of a project meet
    in rectangles; if it isn't given, grams are taken where they would make few of all pairs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for project, q, c in met(batches):
            value, stage = Rectangle(q, c).stages(config)
            score = np.round(value, 4)
            # no other than the best of a rectangle can be among the best of all
            i, j = best_pairs(score, stage, c.order, config.candidates)
            if not len(i):  # columns of no rows would have no types
                continue
            pick = lambda rows, name, at: [rows[k][name] for k in at]
            yield pd.DataFrame({
                "project": project, "idx": pick(q.rows, "idx", i), "q_no": pick(q.rows, "q_no", i), "query": pick(q.rows, "query", i), "chunk_id": pick(c.rows, "chunk_id", j), "score": score[i, j],
                "stage": stage[i, j], "page_start": pick(c.rows, "page_start", j), "page_end": pick(c.rows, "page_end", j),
            })

    if form is None:
        form = "grams" if prefix.worth_looking(queries) and prefix.expected_share(queries, chunks) <= config.few_pairs else "matrix"
    if form == "grams":
        return prefix.scored_by_grams(queries, chunks, run, QUERY, CHUNK, CANDIDATE, PACKED_QUERIES)
    return map_slices(rectangles(queries, chunks, config), run, CANDIDATE, 1)


def query_scores(queries: DataFrame, chunks: DataFrame, config: Config = CONFIG) -> DataFrame:
    """project, idx, q_no, query, best: the best score of each query over all chunks of its project, refused ones too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for project, q, c in met(batches):
            best = Rectangle(q, c).top_scores()
            yield pd.DataFrame({"project": project, "idx": [r["idx"] for r in q.rows], "q_no": [r["q_no"] for r in q.rows], "query": [r["query"] for r in q.rows], "best": np.round(best, 4)})

    scored = map_slices(rectangles(queries, chunks, config), run, "project string, idx long, q_no int, query string, best double", 1)
    return scored.groupBy("project", "idx", "q_no", "query").agg(F.max("best").alias("best"))


def top_candidates(scored: DataFrame, most: int = CONFIG.candidates) -> DataFrame:
    """By score, page and chunk id.  Fallback rows fill up only where primary ones are fewer than ``most``."""
    query = Window.partitionBy("project", "idx", "q_no")
    primary = F.count_if(F.col("stage") == 1).over(query)
    open_ = scored.withColumn("primary", primary).where((F.col("stage") == 1) | (F.col("primary") < most))
    rank = F.row_number().over(query.orderBy(F.desc("score"), "page_start", "chunk_id"))
    return open_.withColumn("rank", rank).where(F.col("rank") <= most)


def fuse(candidates: DataFrame) -> DataFrame:
    """One row for each topic and chunk: best score, queries in order."""
    queries = F.transform(F.array_sort(F.collect_set(F.struct("q_no", "query"))), lambda x: x["query"])
    return candidates.groupBy("project", "idx", "chunk_id").agg(F.max("score").alias("score"), F.min("stage").alias("stage"), F.first("page_start").alias("page_start"), F.first("page_end").alias("page_end"), queries.alias("matched_queries"))

def top_scores(scores: DataFrame) -> DataFrame:
    """project, idx, scores: the best score of each query, by query; scores: rows of query_scores, or of candidates."""
    best = "best" if "best" in scores.columns else "score"
    each = scores.groupBy("project", "idx", "query").agg(F.max(best).alias("best"))
    return each.groupBy("project", "idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("query", "best")))).alias("scores"))


def cover_order(masks: list[int], wanted: int, most: int) -> list[int]:
    """Ranked rows by greedy cover: always the one with most bits of ``wanted`` still open, the first of equals, then the rest in order."""
    order: list[int] = []
    while wanted and len(order) < most:
        gains = [(m & wanted).bit_count() for m in masks]
        best = max(range(len(masks)), key=gains.__getitem__, default=0)
        if not masks or not gains[best]:
            break
        order.append(best)
        wanted &= ~masks[best]
    return (order + [i for i in range(len(masks)) if i not in order])[:most]


def bits(queries: list[str], place: dict[str, int]) -> int:
    return reduce(or_, (1 << place[k] for q in queries if (k := key_of(q)) in place), 0)


def cover(rows: list[dict], subqueries: list[str], most: int) -> list[dict]:
    """Rows, ranked, in the order in which they cover the subqueries."""
    place = {k: i for i, k in enumerate(dict.fromkeys(map(key_of, subqueries)))}
    masks = [bits(r["matched_queries"], place) for r in rows]
    return [rows[i] for i in cover_order(masks, (1 << len(place)) - 1, most)]


def match_topics(plans: DataFrame, chunks: DataFrame, config: Config = CONFIG) -> DataFrame:
    """project, idx, rank, chunk_id, score, stage, page_start, page_end, matched_queries."""
    fused = fuse(match_queries(retrieval_queries(plans), chunks, config))
    per = fused.groupBy("project", "idx").agg(F.collect_list(F.struct("chunk_id", "score", "stage", "page_start", "page_end", "matched_queries")).alias("rows")).join(plans.select("project", "idx", "subqueries"), ["project", "idx"])
    most = config.candidates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for project, idx, rows, subs in zip(b["project"], b["idx"], b["rows"], b["subqueries"], strict=True):
                ranked = sorted(rows, key=lambda r: (-r["score"], r["page_start"], r["chunk_id"]))
                for n, r in enumerate(cover(ranked, list(subs), most), 1):
                    out.append((project, idx, n, r["chunk_id"], r["score"], r["stage"], r["page_start"], r["page_end"], list(r["matched_queries"])))
            yield pd.DataFrame(out, columns=["project", "idx", "rank", "chunk_id", "score", "stage", "page_start", "page_end", "matched_queries"])

    return map_slices(per, run, "project string, idx long, rank int, chunk_id string, score double, stage int, page_start long, page_end long, matched_queries array<string>", TOPICS_AT_ONCE)


def item_matches(plans: DataFrame, candidates: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """project, idx, matched, recall_stage, reason of every topic; the reason rests on the best score over all chunks if ``scores`` has it."""
    c = candidates.groupBy("project", "idx").agg(F.count("*").alias("n"), F.min("stage").alias("stage"), F.max("score").alias("best"))
    if scores is not None:
        c = c.drop("best")
        c = c.join(scores.select("project", "idx", F.array_max(F.map_values("scores")).alias("best")), ["project", "idx"], "full")
    j = plans.join(c, ["project", "idx"], "left")
    reason = F.when((F.col("item_type") == "TASK") & (F.size("queries") == 0), "related_theory_pending").when(F.coalesce("best", F.lit(0.0)) < CONFIG.fallback, "below_threshold").otherwise("insufficient_lexical_evidence")
    return j.select("project", "idx", F.col("n").isNotNull().alias("matched"), F.when(F.col("stage") == 1, "primary").when(F.col("stage") == 2, "secondary").alias("recall_stage"), F.when(F.col("n").isNull(), reason).alias("reason"))


def rematch_with_rewrites(plans: DataFrame, candidates: DataFrame, rewrites: DataFrame, chunks: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Candidates with those of unmatched knowledge topics found by looked-up queries.  ``candidates`` are written once, as they are read twice."""
    from .planning import with_rewrites

    candidates = written(candidates, "candidates")
    open_ = plans.where("item_type = 'KNOWLEDGE'").join(candidates.select("project", "idx").distinct(), ["project", "idx"], "left_anti")
    return candidates.unionByName(match_topics(with_rewrites(open_, rewrites), chunks, config))


ROWS = "array<struct<rank:int,chunk_id:string,score:double,stage:int,page_start:bigint,page_end:bigint,matched_queries:array<string>>>"


def asking_topics(plans: DataFrame, found: DataFrame) -> DataFrame:
    """project, idx, title, item_type, subqueries, wanted: collections with children, and tasks not in ``found``, with the titles whose candidates they take."""
    known = plans.withColumn("idx", F.col("idx").cast("long")).join(found.select("project", F.col("idx").cast("long").alias("idx"), F.lit(True).alias("found")).distinct(), ["project", "idx"], "left")
    wanted = F.when((F.col("item_type") == "COLLECTION") & (F.size("children") > 0), F.col("children")).when((F.col("item_type") == "TASK") & F.col("found").isNull(), F.col("related"))
    return known.select("project", "idx", "title", "item_type", "subqueries", wanted.alias("wanted")).where("wanted is not null")


def source_edges(plans: DataFrame, asking: DataFrame) -> DataFrame:
    """project, idx, source, nth, source_title, chained: from which topics each asking one takes, and whether that one asks and comes before it.

    A title stands for the last topic that has it; collections take their own candidates first.
    """
    key = T.query_key(F.col("title"))
    place = plans.select("project", key.alias("key"), F.col("idx").cast("long").alias("source"), "title").groupBy("project", "key").agg(F.max("source").alias("source"), F.max_by("title", "source").alias("source_title"))
    listed = asking.select("project", "idx", F.posexplode("wanted").alias("nth", "name")).withColumn("key", T.query_key(F.col("name"))).join(place, ["project", "key"]).select("project", "idx", "nth", "source", "source_title")
    own = asking.where("item_type = 'COLLECTION'").select("project", "idx", F.lit(-1).alias("nth"), F.col("idx").alias("source"), F.col("title").alias("source_title"))
    edges = listed.unionByName(own).groupBy("project", "idx", "source").agg(F.min("nth").alias("nth"), F.first("source_title").alias("source_title"))
    asked = asking.select("project", F.col("idx").alias("source"), F.lit(True).alias("asks"))
    return edges.join(asked, ["project", "source"], "left").withColumn("chained", F.coalesce("asks", F.lit(False)) & (F.col("source") < F.col("idx"))).drop("asks")


def taken_over(sources: list[dict], subqueries: list[str], most: int) -> list[dict]:
    """Candidates of several topics as those of one: sources (source_title, rows) in order; chunks once, with their best score."""
    fused: dict[str, dict] = {}
    for s in sources:
        for r in sorted(map(dict, s["rows"]), key=lambda x: x["rank"]):
            old = fused.get(r["chunk_id"])
            if old is None:
                fused[r["chunk_id"]] = r | {"matched_queries": list(dict.fromkeys([*r["matched_queries"], s["source_title"]]))}
            else:
                old |= {"score": max(old["score"], r["score"]), "stage": min(old["stage"], r["stage"]), "matched_queries": list(dict.fromkeys([*old["matched_queries"], s["source_title"]]))}
    ranked = sorted(fused.values(), key=lambda r: (-r["score"], r["page_start"], r["chunk_id"]))
    return [r | {"rank": n} for n, r in enumerate(cover(ranked, subqueries, most), 1)]


def resolve_dependent(plans: DataFrame, candidates: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Collections take their children's candidates after their own, unmatched tasks those of related topics.

    A topic that takes from one before it takes what that one has taken, from one behind it only its own.  So topics are
    resolved by levels: those that wait for none, then those that wait for these only, until none is left; every level is
    a join, and there are as many as the longest chain of topics is long.
    """
    own = written(candidates.groupBy("project", F.col("idx").cast("long").alias("idx")).agg(F.collect_list(F.struct("rank", "chunk_id", "score", "stage", "page_start", "page_end", "matched_queries")).cast(ROWS).alias("rows")), "own")
    asking = written(asking_topics(plans, own), "asking")
    edges = written(source_edges(plans, asking), "edges")
    pending, resolved = asking, None
    most = config.candidates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [taken_over(list(s), list(q), most) for s, q in zip(b["sources"], b["subqueries"], strict=True)]
            yield pd.DataFrame({"project": b["project"], "idx": b["idx"], "rows": rows})

    while not pending.isEmpty():
        waits = edges.where("chained").join(pending.select("project", F.col("idx").alias("source")), ["project", "source"], "left_semi").select("project", "idx").distinct()
        ready = pending.join(waits, ["project", "idx"], "left_anti")
        given = edges.where("not chained").join(own.withColumnRenamed("idx", "source"), ["project", "source"])
        if resolved is not None:
            given = given.unionByName(edges.where("chained").join(resolved.withColumnRenamed("idx", "source"), ["project", "source"]))
        gathered = given.groupBy("project", "idx").agg(F.array_sort(F.collect_list(F.struct("nth", "source_title", "rows"))).alias("sources"))
        level = written(map_slices(ready.select("project", "idx", "subqueries").join(gathered, ["project", "idx"]), run, f"project string, idx long, rows {ROWS}", TOPICS_AT_ONCE), "level")
        resolved = level if resolved is None else resolved.unionByName(level)
        pending = written(pending.join(ready.select("project", "idx"), ["project", "idx"], "left_anti"), "pending")
    kept = own.join(asking.select("project", "idx"), ["project", "idx"], "left_anti")
    every = kept if resolved is None else kept.unionByName(resolved)
    return every.select("project", "idx", F.explode("rows").alias("r")).select("project", "idx", "r.*")


def dependent_matches(plans: DataFrame, candidates: DataFrame, resolved: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """item_matches after resolve_dependent; topics that asked others in vain say of whom."""
    before = item_matches(plans, candidates, scores).withColumn("idx", F.col("idx").cast("long"))
    asked = asking_topics(plans, candidates).select("project", "idx", F.when(F.col("item_type") == "COLLECTION", "no_child_evidence").otherwise("no_related_theory_evidence").alias("vain"))
    now = resolved.groupBy("project", "idx").agg(F.min("stage").alias("least"))
    j = before.join(asked, ["project", "idx"], "left").join(now, ["project", "idx"], "left")
    matched = F.col("least").isNotNull()
    stage = F.when(F.col("vain").isNull(), F.col("recall_stage")).when(matched, "primary")
    return j.select("project", "idx", matched.alias("matched"), stage.alias("recall_stage"), F.when(~matched, F.coalesce("vain", "reason")).alias("reason"))


def adjacent_chunks(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """project, idx, chunk_id of neighbours in the same document and chapter that aren't candidates themselves."""
    place = chunks.select("chunk_id", "doc", "position", T.query_key(F.col("chapter_title")).alias("chapter_key"))
    own = candidates.select("project", "idx", "chunk_id").join(place, "chunk_id").select("project", "idx", F.col("chunk_id").alias("of"), "doc", "chapter_key", F.explode(F.array(F.col("position") - 1, F.col("position") + 1)).alias("position"))
    near = own.join(place, ["doc", "position", "chapter_key"]).where("chapter_key != ''")
    return near.join(candidates.select("project", "idx", "chunk_id"), ["project", "idx", "chunk_id"], "left_anti").select("project", "idx", "of", "chunk_id")


def traits(text: Column) -> list[Column]:
    """long, detailed: what utility asks of a text, see worth."""
    return [(F.length(F.btrim(text)) >= C.PASSAGE_LENGTH).alias("long"), text.rlike(C.USEFUL_DETAIL).alias("detailed")]


def worth(score: Column, long: Column, detailed: Column) -> Column:
    return score + F.when(long, C.LONG_BONUS).otherwise(C.SHORT_MALUS) + F.when(detailed, C.DETAIL_BONUS).otherwise(0.0)


def utility(score: Column, text: Column) -> Column:
    """What a passage is worth by itself: its score, long enough, with useful detail."""
    return worth(score, *traits(text))


def diversity(worth: Column, page_start: Column, page_end: Column, chosen: Column) -> Column:
    """The worth of a passage beside chosen ones, an array of (page_start, page_end): new pages gain, shared ones lose."""
    shares = F.exists(chosen, lambda c: (F.least(page_end, c["page_end"]) >= F.greatest(page_start, c["page_start"])))
    return worth + F.when(F.size(chosen) == 0, 0.0).when(shares, C.SHARED_PAGES_MALUS).otherwise(C.NEW_PAGES_BONUS)


def page_share(a: dict, b: dict) -> float:
    common = min(a["page_end"], b["page_end"]) - max(a["page_start"], b["page_start"]) + 1
    return max(common, 0) / max(min(a["page_end"] - a["page_start"], b["page_end"] - b["page_start"]) + 1, 1)


@lru_cache(maxsize=32)
def _flat(text: str) -> str:
    return " ".join(text.split()).casefold()


@lru_cache(maxsize=32)
def _flat_letters(text: str) -> Counter:
    return Counter(text)


@lru_cache(maxsize=8)
def _flat_matcher(b: str) -> SequenceMatcher:
    return SequenceMatcher(None, "", b)


def reaches(a: str, b: str, least: float) -> bool:
    """Whether the standard library's ratio of two texts is ``least`` or more.

    Blocks are sought only as long as those that can still be found, the shorter side of every open stretch, may suffice.
    """
    size, left = len(a) + len(b), min(len(a), len(b))
    if not size:
        return least <= 1.0
    x, y = _flat_letters(a), _flat_letters(b)
    if 2.0 * left / size < least or 2.0 * sum(min(n, y[k]) for k, n in x.items()) / size < least:
        return False
    m = _flat_matcher(b)
    m.set_seq1(a)
    found, open_ = 0, [(0, len(a), 0, len(b))]
    while open_ and 2.0 * (found + left) / size >= least:
        low, high, first, last = open_.pop()
        left -= min(high - low, last - first)
        i, j, k = m.find_longest_match(low, high, first, last)
        if k:
            found += k
            for part in ((low, i, first, j), (i + k, high, j + k, last)):
                if part[0] < part[1] and part[2] < part[3]:
                    open_.append(part)
                    left += min(part[1] - part[0], part[3] - part[2])
    return 2.0 * (found + left) / size >= least


def near_duplicate(a: dict, b: dict) -> bool:
    """Equal texts, or a sequence ratio over a bound that is lower where most of the pages are shared."""
    x, y = (_flat(r["text"]) for r in (a, b))
    return x == y or reaches(x, y, C.DUPLICATE_ON_SHARED_PAGES if page_share(a, b) >= C.MOST_PAGES else C.DUPLICATE)


def choose_evidence(pool: list[dict], subqueries: list[str], config: Config = CONFIG) -> list[dict]:
    """Up to ``evidence`` different passages within the character budget, best diversity first; rows have worth, see utility.

    Every row keeps a running value: its worth, what pages change once something is chosen, and a bonus while it covers
    an open subquery.
    """
    pool = sorted(pool, key=lambda r: (r["page_start"], r["chunk_id"]))
    place = {k: i for i, k in enumerate(dict.fromkeys(map(key_of, subqueries)))}
    masks = np.array([bits(r["matched_queries"], place) for r in pool], object)
    worth, free = np.array([r["worth"] for r in pool], float), np.ones(len(pool), bool)
    shared = np.array([[page_share(a, b) > 0 for b in pool] for a in pool]).reshape(len(pool), len(pool))
    wanted, chosen, room = (1 << len(place)) - 1, [], config.evidence_characters
    while free.any() and len(chosen) < config.evidence:
        pages = np.where(shared[:, chosen].any(axis=1), C.SHARED_PAGES_MALUS, C.NEW_PAGES_BONUS) if chosen else 0.0
        value = worth + pages + np.array([C.COVER_BONUS if m & wanted else 0.0 for m in masks])
        i = int(np.where(free, value, -np.inf).argmax())
        free[i] = False
        size = len(pool[i]["text"])
        if (chosen and size > room) or any(near_duplicate(pool[i], pool[k]) for k in chosen):
            continue
        chosen.append(i)
        room, wanted = room - size, wanted & ~masks[i]
        if place and not wanted and len(chosen) > 1:
            break
    return [pool[i] for i in chosen]


def near_keys(chunks: DataFrame) -> DataFrame:
    """chunk_id, held: keys of the section and the text as one; for long texts quicker than text.query_key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "held": [key_of.__wrapped__(s or "") + key_of.__wrapped__(c or "") for s, c in zip(b["section_title"], b["content"], strict=True)]})

    return map_slices(chunks.select("chunk_id", "section_title", "content"), run, "chunk_id string, held string", PACKED_CHUNKS)


def recalled_neighbours(near: DataFrame, ready: DataFrame, chunks: DataFrame) -> DataFrame:
    """Those rows of ``near``, written, in whose section and text one of their matched queries is recalled: its core phrase occurs, or two keywords; ready: retrieval queries."""
    key = T.query_key
    keys = ready.select("project", "idx", "query", key(F.col("core")).alias("core"), F.filter(F.transform(F.array_distinct("words"), key), lambda w: w != "").alias("words"))
    asked = near.select("project", "idx", "chunk_id", F.explode("matched_queries").alias("query")).join(keys, ["project", "idx", "query"]).where("core != '' or size(words) > 1")
    asked = asked.groupBy("project", "idx", "chunk_id").agg(F.collect_set(F.struct("core", "words")).alias("asked"))
    hit = F.exists("asked", lambda a: ((a["core"] != "") & F.contains("held", a["core"])) | (F.size(F.filter(a["words"], lambda w: F.contains(F.col("held"), w))) >= 2))
    hits = asked.join(near_keys(chunks), "chunk_id").where(hit).select("project", "idx", "chunk_id")
    return written(near.join(hits, ["project", "idx", "chunk_id"], "left_semi"), "near")


def select_evidence(plans: DataFrame, candidates: DataFrame, chunks: DataFrame, config: Config = CONFIG) -> DataFrame:
    """project, idx, rank, chunk_id, score, text of the evidence of each matched topic, neighbours included.

    Candidates and chunks are tables, as they are read several times.  Of neighbours only those go on with their texts in
    which a query of the passage beside them is recalled.
    """
    candidates, chunks = written(candidates, "candidates"), stored(chunks, "chunks")
    text = chunks.select("chunk_id", "chapter_title", "section_title", "content", *traits(F.col("content")))
    keyed = plans.select("project", "idx", F.col("chapter").alias("topic_chapter"), "subqueries", F.transform("subqueries", T.query_key).alias("keys"))
    subs = candidates.join(keyed, ["project", "idx"])
    covers = F.exists("matched_queries", lambda q: F.array_contains("keys", T.query_key(q)))
    any_cover = F.max(covers.cast("int")).over(Window.partitionBy("project", "idx"))
    pool = subs.withColumn("covers", covers.cast("int")).withColumn("any", any_cover).where("any = 0 or covers = 1")
    near = adjacent_chunks(pool, chunks).join(pool.select("project", "idx", F.col("chunk_id").alias("of"), "rank", "matched_queries", "topic_chapter", "subqueries"), ["project", "idx", "of"])
    ready = written(retrieval_queries(plans).withColumn("idx", F.col("idx").cast("long")), "ready")
    pages = chunks.select("chunk_id", "page_start", "page_end")
    first = F.row_number().over(Window.partitionBy("project", "idx", "chunk_id").orderBy("rank"))
    near = recalled_neighbours(near.withColumn("n", first).where("n = 1").join(pages, "chunk_id"), ready, chunks)
    names = ["project", "idx", "rank", "chunk_id", "score", "page_start", "page_end", "matched_queries", "subqueries", "topic_chapter", "own"]
    both = pool.withColumn("own", F.lit(True)).select(*names).unionByName(near.withColumn("own", F.lit(False)).withColumn("score", F.lit(0.0)).select(*names)).join(text, "chunk_id")
    both = both.withColumn("worth", worth(F.col("score"), F.col("long"), F.col("detailed"))).drop("long", "detailed")
    grouped = both.groupBy("project", "idx").agg(F.collect_list(F.struct(*[c for c in both.columns if c not in ("project", "idx")])).alias("rows"))
    # queries are only asked of neighbours
    asked = ready.join(near.select("project", "idx").distinct(), ["project", "idx"], "left_semi").groupBy("project", "idx").agg(F.collect_list(F.struct(*QUERY)).alias("prepared"))
    grouped = grouped.join(asked, ["project", "idx"], "left")

    def neighbours(rows: list[dict], asked: list[dict]) -> Iterator[dict]:
        """Those in which a query of the passage beside them is recalled, with their own score."""
        q, c = Queries(asked), Chunks(rows)
        pair = Rectangle(q, c)
        near = q.recalled(q.needles.found(c.near, q.needles.held(c.near)))
        pair.lift(near)
        value = pair.scores()
        for j, r in enumerate(rows):
            hits = [i for i, a in enumerate(asked) if near[i, j] and a["query"] in r["matched_queries"]]
            if hits:
                score = round(max(float(value[i, j]) if q.keys[i] else 0.0 for i in hits), 4)
                yield r | {"score": score, "worth": r["worth"] - r["score"] + score, "matched_queries": [asked[i]["query"] for i in hits]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for project, idx, rows, ready in zip(b["project"], b["idx"], b["rows"], b["prepared"], strict=True):
                rows = [r | {"text": r["content"], "matched_queries": list(r["matched_queries"])} for r in _rows(rows)]
                pool = [r for r in rows if r["own"]]
                if len(pool) < len(rows) and ready is not None:
                    pool += neighbours([r for r in rows if not r["own"]], _rows(ready))
                chosen = choose_evidence(pool, list(rows[0]["subqueries"]), config)
                out += [(project, idx, n, r["chunk_id"], r["score"], r["text"]) for n, r in enumerate(chosen, 1)]
            yield pd.DataFrame(out, columns=["project", "idx", "rank", "chunk_id", "score", "text"])

    return map_slices(grouped, run, "project string, idx long, rank int, chunk_id string, score double, text string", TOPICS_AT_ONCE)


def failure_diagnostics(plans: DataFrame, matches: DataFrame, scores: DataFrame) -> DataFrame:
    """One JSON text for each unmatched topic; scores: project, idx, scores (see top_scores).  ``used_ai_fallback`` is a column of plans, false without it."""
    j = plans.join(matches.where("not matched"), ["project", "idx"]).join(scores, ["project", "idx"], "left")
    short = lambda q: F.left(q, F.lit(80))
    top = F.map_from_entries(F.transform(F.array_distinct(F.transform("queries", short)), lambda k: F.struct(k.alias("key"), F.array_max(F.transform(F.filter(F.map_entries("scores"), lambda e: short(e["key"]) == k), lambda e: e["value"])).alias("value"))))
    fallback = F.col("used_ai_fallback") if "used_ai_fallback" in plans.columns else F.lit(False)
    body = F.to_json(F.struct("item_type", F.transform("queries", short).alias("queries"), F.coalesce(top, F.create_map().cast("map<string,double>")).alias("top_scores"), F.col("reason").alias("reason_category"), fallback.alias("used_ai_fallback")))
    return j.select("project", "idx", F.concat(F.lit("unmatched: "), body).alias("diagnostic"))


def request_context(evidence: DataFrame) -> DataFrame:
    """Evidence of each topic as a JSON array, without repeats by text."""
    flat = T.blank_free(F.col("text"))
    first = F.row_number().over(Window.partitionBy("project", "idx", "flat").orderBy("rank"))
    kept = evidence.withColumn("flat", flat).withColumn("n", first).where("n = 1")
    return kept.groupBy("project", "idx").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text")))).alias("context"), F.count("*").alias("n"))


def extractive_item(evidence: DataFrame) -> DataFrame:
    """The first passage of each topic as one bullet in three versions."""
    text = T.blank_free(F.col("text"))
    words = F.slice(F.split(text, " "), 1, 8)
    return evidence.where("rank = 1").select("project", "idx", "chunk_id", F.left(text, F.lit(800)).alias("original"), F.left(text, F.lit(400)).alias("recitation"), F.array_join(words, "、").alias("keywords"))


def citation_check(bullets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every cited chunk must be a candidate of its topic and every cited page in one's range; bullets: project, idx, bullet, chunk_ids, pages."""
    key = ["project", "idx", "bullet"]
    chunks = bullets.select(*key, F.explode("chunk_ids").alias("chunk_id"))
    bad_chunks = chunks.join(candidates.select("project", "idx", "chunk_id"), ["project", "idx", "chunk_id"], "left_anti").groupBy(*key).agg(F.count("*").alias("bad_chunks"))
    pages = bullets.select(*key, F.explode("pages").alias("page"))
    ranges = candidates.select("project", "idx", F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct()
    bad_pages = pages.join(ranges, ["project", "idx", "page"], "left_anti").groupBy(*key).agg(F.count("*").alias("bad_pages"))
    j = bullets.select(*key).join(bad_chunks, key, "left").join(bad_pages, key, "left")
    return j.select(*key, F.coalesce("bad_chunks", F.lit(0)).alias("bad_chunks"), F.coalesce("bad_pages", F.lit(0)).alias("bad_pages"))


def source_links(bullets: DataFrame, candidates: DataFrame) -> DataFrame:
    """project, idx, bullet, chunk_id, page_from, page_to: cited pages within the chunk's range, else the range."""
    j = bullets.select("project", "idx", "bullet", "pages", F.explode("chunk_ids").alias("chunk_id")).join(candidates.select("project", "idx", "chunk_id", "page_start", "page_end"), ["project", "idx", "chunk_id"])
    inside = F.filter("pages", lambda p: p.between(F.col("page_start"), F.col("page_end")))
    return j.select("project", "idx", "bullet", "chunk_id", F.coalesce(F.array_min(inside), "page_start").alias("page_from"), F.coalesce(F.array_max(inside), "page_end").alias("page_to"))


def vote_chapter(bullets: DataFrame, candidates: DataFrame, chapters: DataFrame) -> DataFrame:
    """project, idx, chapter: of cited chunks the chapter most cited, then of best score, then of the first page; chapters: chunk_id, chapter."""
    cited = bullets.select("project", "idx", F.explode("chunk_ids").alias("chunk_id")).groupBy("project", "idx", "chunk_id").agg(F.count("*").alias("cites"))
    j = cited.join(candidates.select("project", "idx", "chunk_id", "score", "page_start"), ["project", "idx", "chunk_id"]).join(chapters, "chunk_id")
    votes = j.groupBy("project", "idx", "chapter").agg(F.sum("cites").alias("votes"), F.max("score").alias("best"), F.min("page_start").alias("page"))
    rank = F.row_number().over(Window.partitionBy("project", "idx").orderBy(F.desc("votes"), F.desc("best"), "page", "chapter"))
    return votes.withColumn("n", rank).where("n = 1").select("project", "idx", "chapter")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio with the standard library's rules."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, i, j).ratio() if i is not None and j is not None else None for i, j in zip(x, y, strict=True)], dtype="float64")

    return of(a, b)
