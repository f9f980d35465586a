"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Four machines are compiled from the model file:

* the normaliser: a transducer over bytes (the model's character map, longest match first, characters without one copied);
  blanks are then trimmed, joined and turned into word marks by string functions, not by a machine;
* the lexicon: a transducer whose states form a trie of the pieces; a path from the root spells a piece backwards, and
  its end has an arc back to the root that puts out the piece's id with its weight;
* byte fallback: for a character without a piece an arc that puts out the ids of its bytes (or the unknown piece);
* for models of merges the pair acceptor: one state for each piece, an arc of weight zero between two pieces where merging
  would have stopped and none elsewhere.  Pieces of such models weigh nothing, those of unigram models their negative score.

The normalised input, a chain of characters, is composed on the fly with lexicon, fallback and pair acceptor into a lattice
of arcs (begin, end, ids, weight), and the tropical shortest path through the lattice gives the ids.  No piece has the word
mark after another character, so the lattice falls apart at these places; the shortest path of each stretch is kept in a
bounded table and paths are joined.

Null text encodes to no pieces and decodes to empty text; a word mark in a text decodes to a space.  Repeated rows are
coded each, equally; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import held

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORD = "▁"
REMEMBERED = 1 << 18
#: Rows passed on at a time.
ROWS = 512
# Numbers of fields and kinds in the public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The normaliser's byte transducer: a double array of states, each arc labelled with a byte, final states with a replacement."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def _offset(self, unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes read and replacement of the longest path from ``at`` that ends in a final state."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        size, begin = found
        return size, self.replacements[begin : self.replacements.index(b"\0", begin)]

    def apply(self, text: str) -> str:
        data, out, at = text.encode(), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, data[at : at + size]
            at += hit[0]
            out.append(hit[1])
        return b"".join(out).decode(errors="replace")


class PieceTransducer:
    def __init__(self, model: bytes) -> None:
        fields = list(wire(model))
        trainer = dict(next((wire(v) for k, v in fields if k == TRAINER), ()))
        spec = dict(next((wire(v) for k, v in fields if k == NORMALIZER), ()))
        self.map = CharacterMap(spec[2]) if spec.get(2) else None
        self.merges = trainer.get(3, UNIGRAM) == MERGES
        self.dummy_prefix, self.trim = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.text: list[str] = []
        self.kind: list[int] = []
        self.weight: list[float] = []
        for v in (v for k, v in fields if k == PIECES):
            p = dict(wire(v))
            self.text.append(p.get(1, b"").decode())
            self.weight.append(-float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]))
            self.kind.append(p.get(3, NORMAL))
        self.unknown = self.kind.index(UNKNOWN)
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.id = {t: i for i, t in enumerate(self.text) if self.kind[i] in (NORMAL, USER)}
        self.trees: dict[int, tuple[list, list]] = {}
        self.allowed: dict[int, bool] = {}
        self.penalty = 0.0 if self.merges else max((self.weight[i] for i in self.id.values()), default=0.0) + 10
        self._compile_lexicon()
        # stretches of this and the last generation: what is asked for again stays known
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.piece_bytes = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() if self.kind[i] in (NORMAL, USER) else b"" for i, t in enumerate(self.text)]

    def _compile_lexicon(self) -> None:
        """next: for each state its arcs (character to state); final: the piece whose spelling ends there, or -1."""
        self.next: list[dict[str, int]] = [{}]
        self.final = [-1]
        for t, i in self.id.items():
            if self.merges and len(t) > 1 and self._spines(i) is None:
                continue
            state = 0
            for c in reversed(t):
                to = self.next[state].get(c)
                if to is None:
                    to = self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.final.append(-1)
                state = to
            self.final[state] = i

    # -- pair acceptor ---------------------------------------------------------------------------------------------

    def _spines(self, piece: int) -> tuple[list, list] | None:
        """Symbols at the left and at the right edge while ``piece`` is merged, each as (text, born, gone); None if merging doesn't make it."""
        if piece in self.trees:
            return self.trees[piece]
        symbols = [(c, None, None, -inf) for c in self.text[piece]]
        while len(symbols) > 1:
            options = [(self.weight[i], k) for k in range(len(symbols) - 1) if (i := self.id.get(symbols[k][0] + symbols[k + 1][0])) is not None]
            if not options:
                self.trees[piece] = None
                return None
            rank, k = min(options)
            a, b = symbols[k], symbols[k + 1]
            symbols[k : k + 2] = [(a[0] + b[0], a, b, max(rank, a[3], b[3]))]
        out = []
        for side in (1, 2):
            node, gone, spine = symbols[0], inf, []
            while node is not None:
                spine.append((node[0], node[3], gone))
                node, gone = node[side], node[3]
            out.append(spine)
        self.trees[piece] = (out[0], out[1])
        return self.trees[piece]

    def pair(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side."""
        key = a << 20 | b
        known = self.allowed.get(key)
        if known is None:
            known = True
            for right, born_r, gone_r in self._spines(a)[1]:
                for left, born_l, gone_l in self._spines(b)[0]:
                    if born_r >= gone_l or born_l >= gone_r:
                        continue
                    i = self.id.get(right + left)
                    if i is not None and (rank := max(self.weight[i], born_r, born_l)) < gone_r and rank <= gone_l:
                        known = False
                        break
                if not known:
                    break
            if len(self.allowed) > 1 << 21:
                self.allowed.clear()
            self.allowed[key] = known
        return known

    # -- composition and shortest path -------------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        if self.map:
            text = self.map.apply(text)
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (" " + text if self.dummy_prefix else text).replace(" ", WORD)

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode()) if self.bytes else (self.unknown,)

    def shortest_path(self, stretch: str) -> tuple[int, ...]:
        """Ids along the path of least weight through the composition, whose arcs are made as the search comes to their end.

        Every end keeps its least weight, last piece (-1: none or fallback) and where that began.  With a pair acceptor a
        state would be an end and its last piece, but merging a prefix of the stretch has one result, so only one path to
        each end has finite weight and the first arc that gives it is the only one; one of the whole stretch always has.
        """
        n, merges, known, allowed, pieces = len(stretch), self.merges, self.allowed, self.pair, self.weight
        arcs, final, ids = self.next, self.final, self.id
        weight, last, begin = [0.0] + [inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            state, at = 0, end
            while at:
                state = arcs[state].get(stretch[at - 1])
                if state is None:
                    break
                at -= 1
                piece = final[state]
                if piece < 0 or weight[at] == inf:
                    continue
                if merges:
                    before = last[at]
                    free = True if before < 0 else known.get(before << 20 | piece)
                    if free is None:
                        free = allowed(before, piece)
                    if free:
                        weight[end], last[end], begin[end] = weight[at], piece, at
                        break
                elif (w := weight[at] + pieces[piece]) < weight[end]:
                    weight[end], last[end], begin[end] = w, piece, at
            if stretch[end - 1] not in ids and (w := weight[end - 1] + self.penalty) < weight[end]:
                weight[end], last[end], begin[end] = w, -1, end - 1
        out: list[tuple[int, ...]] = []
        end = n
        while end:
            at = begin[end]
            ids = (last[end],) if last[end] >= 0 else self.fallback(stretch[at])
            # unknown characters in a row are one unknown piece
            if not (out and ids == (self.unknown,) == out[-1]):
                out.append(ids)
            end = at
        return tuple(i for part in reversed(out) for i in part)

    def encode_bytes(self, text: str | None) -> bytes:
        """Piece ids as little-endian numbers of four bytes."""
        out: list[bytes] = []
        known = self.known
        for stretch in re.findall(f"{WORD}*[^{WORD}]+|{WORD}+", self.normalise(text or "")):
            ids = known.get(stretch)
            if ids is None:
                ids = self.older.get(stretch)
                if ids is None:
                    ids = np.array(self.shortest_path(stretch), "<i4").tobytes()
                if len(stretch) <= 64:
                    if len(known) >= REMEMBERED:
                        self.older, self.known = known, {}
                        known = self.known
                    known[stretch] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.piece_bytes.__getitem__, ids)).decode(errors="replace").replace(WORD, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def transducer(model: bytes) -> PieceTransducer:
    """One for each worker process and model."""
    return held(hashlib.sha256(model).digest(), lambda: PieceTransducer(model))


def encode_documents(docs: DataFrame, model_path: str = MODEL, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes_fallback, ids_crc32, restored: whether decoding gives the text back.

    The driver reads the model file, a vocabulary of fixed size, and broadcasts it.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(model.value)
        low, high = min(t.byte_of, default=0), max(t.byte_of, default=-1)
        for b in batches:
            for at in range(0, len(b), ROWS):
                part, rows = b.iloc[at : at + ROWS], []
                for text in part["text"]:
                    data = t.encode_bytes(text)
                    ids = np.frombuffer(data, "<i4")
                    rows.append((ids if keep_ids else None, len(ids), int(((ids >= low) & (ids <= high)).sum()), zlib.crc32(data), t.decode(ids.tolist()) == (text or "")))
                out = pd.DataFrame(rows, columns=["ids", "n_pieces", "n_fallback", "ids_crc32", "restored"])
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out if keep_ids else out.drop(columns="ids")

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if keep_ids else ""
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}{ids}, n_pieces long, n_fallback long, ids_crc32 long, restored boolean")


def decode_documents(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give empty text."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(model.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [t.decode([] if i is None else list(map(int, i))) for i in b["ids"]]})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")
