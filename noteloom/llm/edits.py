"""Token counts: edit-aware counting.

A document's pre-tokens are the leaves of a segment tree with character and token sums in every node.  An edit finds
its leaves by descending the sums, re-splits from the pre-token before the touched ones (one more on the left, as a
run of blanks looks one character ahead) until a new boundary meets an old one behind the edit, encodes only pre-tokens
in between and updates sums along the paths.  Null text counts as empty; edits are applied in order, positions refer to
the text as it is then and are clipped to it; a null replacement deletes; no edits leave the counts as they are.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32
REMEMBERED = 1 << 20


class Counter:
    """Tokens of single pre-tokens, remembered in a bounded table."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.encoding = tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n


class TokenTree:
    """Segment tree over leaves of up to LEAF pre-tokens (more after edits); sums[i] of node i, children 2i and 2i + 1."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter = text, counter
        pieces = counter.split.findall(text)
        known, count = counter.known, counter.count
        tokens = [known.get(p) or count(p) for p in pieces]
        lengths = list(map(len, pieces))
        self.n_pieces, self.encoded = len(pieces), 0
        self.leaves = [(lengths[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, max(1, len(pieces)), LEAF)]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(a), sum(b)
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def tokens_before(self, at: int) -> int:
        """Tokens of the pre-tokens that end at or before character ``at``."""
        leaf, start, tokens = self._leaf(at)
        for a, b in zip(*self.leaves[leaf], strict=True):
            if start + a > at:
                break
            start, tokens = start + a, tokens + b
        return tokens

    def _leaf(self, at: int) -> tuple[int, int, int]:
        """The leaf that holds character ``at`` (the last at the end), its first character and the tokens before it."""
        node, start, tokens = 1, 0, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start, tokens = start + self.chars[node], tokens + self.tokens[node]
                node += 1
        return node - self.size, start, tokens

    def _update(self, leaf: int) -> None:
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(self.leaves[leaf][0]), sum(self.leaves[leaf][1])
        node //= 2
        while node:
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def _walk(self, leaf: int, start: int) -> Iterator[tuple[int, int, int]]:
        """Leaf, place in it and first character of the pre-tokens from the first of ``leaf`` on."""
        for i in range(leaf, len(self.leaves)):
            for k, a in enumerate(self.leaves[i][0]):
                yield i, k, start
                start += a

    def edit(self, start: int, end: int, put: str) -> None:
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        shift = len(put) - (end - start)
        text = self.text[:start] + put + self.text[end:]
        leaf, first, _ = self._leaf(max(0, start - 1))
        while leaf and sum(1 for p in takewhile(lambda p: p[2] < start, self._walk(leaf, first))) < 3:
            leaf -= 1
            first -= self.chars[self.size + leaf]
        before = list(takewhile(lambda p: p[2] < start, self._walk(leaf, first)))
        begin = before[max(0, len(before) - 3)] if before else (0, 0, 0)
        old_starts = (p for p in self._walk(leaf, first) if p[2] >= end)
        meet = next(old_starts, None)
        lengths, tokens, stop = [], [], None
        for m in self.counter.split.finditer(text, begin[2]):
            while meet is not None and meet[2] + shift < m.start():
                meet = next(old_starts, None)
            if meet is not None and m.start() >= start + len(put) and meet[2] + shift == m.start():
                stop = meet
                break
            lengths.append(m.end() - m.start())
            tokens.append(self.counter.count(m.group()))
        self.encoded += len(lengths)
        self._replace(begin, stop, lengths, tokens)
        self.text = text

    def _replace(self, begin: tuple[int, int, int], stop: tuple[int, int, int] | None, lengths: list[int], tokens: list[int]) -> None:
        last, upto = (stop[0], stop[1]) if stop else (len(self.leaves) - 1, len(self.leaves[-1][0]))
        first, place = begin[0], begin[1]
        gone = sum(len(self.leaves[i][0]) for i in range(first, last)) - place + upto
        self.n_pieces += len(lengths) - gone
        a, b = self.leaves[last]
        if first == last:
            x, y = self.leaves[first]
            self.leaves[first] = (x[:place] + lengths + a[upto:], y[:place] + tokens + b[upto:])
        else:
            x, y = self.leaves[first]
            self.leaves[first] = (x[:place] + lengths, y[:place] + tokens)
            for i in range(first + 1, last):
                self.leaves[i] = ([], [])
            self.leaves[last] = (a[upto:], b[upto:])
        for i in range(first, last + 1):
            self._update(i)


_loaded: dict[int, Counter] = {}


def counter(ranks: bytes) -> Counter:
    key = zlib.crc32(ranks)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Counter(ranks)
    return _loaded[key]


EDITS = "array<struct<start:int,stop:int,put:string>>"


def count_edited(docs: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens before, n_tokens_edited after the edits, n_pieces, n_encoded (pre-tokens encoded again), edited_crc32.

    ``edits`` is an array of (start, stop, put).  The driver reads the vocabulary, a file of fixed size, and broadcasts it.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(ranks.value)
        for b in batches:
            rows = []
            for text, own in zip(b["text"], b["edits"], strict=True):
                tree = TokenTree(text or "", c)
                before, pieces = tree.total, tree.n_pieces
                for e in own if own is not None else ():
                    if e is not None:
                        tree.edit(int(e["start"] or 0), int(e["stop"] or 0), e["put"] or "")
                rows.append((before, tree.total, pieces, tree.n_pieces, tree.encoded, zlib.crc32(tree.text.encode())))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_tokens_edited", "n_pieces", "n_pieces_edited", "n_encoded", "edited_crc32"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", edits.cast(EDITS).alias("edits")).mapInPandas(
        run, f"doc_id {kind}, n_tokens long, n_tokens_edited long, n_pieces long, n_pieces_edited long, n_encoded long, edited_crc32 long"
    )


def revision() -> Column:
    """Three edits of each text, from its own length and checksum: a replacement, an insertion and a deletion."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n, h = F.length(text), F.crc32(text)
    place = lambda k: F.pmod(F.floor(h / F.lit(k)), n + 1).cast("int")
    return F.array(
        F.struct(place(1).alias("start"), (place(1) + 5).alias("stop"), F.lit(" revised text").alias("put")),
        F.struct(place(7).alias("start"), place(7).alias("stop"), F.lit("2024, ").alias("put")),
        F.struct(place(61).alias("start"), (place(61) + 12).alias("stop"), F.lit(None).cast("string").alias("put")),
    )
