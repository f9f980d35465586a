"""Token-ID output: binary files of documents' ids under one shared zstandard dictionary.

A folder holds the dictionary, a manifest (one row for each file) and files of documents in ascending order of their ids.
A file is a header (format, bytes of an id, SHA-256 of the dictionary), one zstandard frame for each document, and an
index with every document's id, the place of its frame and the number of ids before it; a short footer says where the
index begins and holds its checksum.  So one document is read with the index and one frame.  The dictionary is trained
on serialized id arrays: a bounded sample of blocks, those of least hash among the different blocks of all documents;
it only decides how small the files get.

Texts are encoded by the tokenizers library, of a group of texts each different pre-token once.  Tasks write under names of their own and report
them; only files that the manifest names count, so a task that runs twice leaves nothing behind that is read.

Null text counts as empty and has the end id alone; null ids come first, ids that are equal are ordered by their tokens,
and repeated rows stand as often as they occur; texts are encoded whole; an empty table gives a folder without files;
other columns, whatever their names, play no part.  Ids of documents must be whole numbers.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stage

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"IDSZSTD1"
LEVEL = 3
#: Ids of a block of the sample, blocks of the sample, bytes of the dictionary.
BLOCK_IDS, SAMPLE_BLOCKS, DICTIONARY_BYTES = 2048, 4096, 64 << 10
#: Bytes of serialized ids of a file and of a batch that is read, about.
FILE_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
#: Pre-tokens that a task remembers, twice, and the characters of one; bytes of texts whose words are encoded together.
REMEMBERED, LONGEST, GROUP_BYTES = 400_000, 64, 24 << 20
# The kind of tokenizer whose texts can be encoded by words, and how its byte level shows bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "</w>", None,
)
PIECES = regex.compile(r"\n|" + SPLIT.replace(r"\s", r"\p{White_Space}"))
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
SHOWN = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))} | {10: "\n"}
FILE = "name string, docs long, tokens long, bytes long, first_id long, last_id long"


def ranges(values: np.ndarray, ends: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` numbered ``picked``, one behind the other, and their ends there; run i ends before ends[i]."""
    starts = np.concatenate([[0], ends[:-1]])[picked] if len(ends) else np.zeros(0, np.int64)
    sizes = ends[picked] - starts if len(ends) else starts
    to = np.cumsum(sizes)
    at = np.arange(to[-1] if len(to) else 0) - np.repeat(to - sizes - starts, sizes)
    return values[at], to


class Encoder:
    """Serialized ids of whole texts, by the model of a tokenizer of the library.

    For the kind of tokenizer that PLAIN_KIND describes, white space parts pre-tokens, no normalisation reaches over it
    and special tokens hold none.  So the different words of a group of texts are normalised and split once, and the
    library's model encodes the different pre-tokens among them; the last id of each tells its end.  Words with special
    tokens, and texts for tokenizers of any other kind, are encoded by the library as they are.
    """

    def __init__(self, tokenizer: bytes) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core of its own
        self.whole = Tokenizer.from_buffer(tokenizer)
        self.model = Tokenizer(self.whole.model)
        self.width = 2 if self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        made = json.loads(tokenizer)
        self.plain = (made["normalizer"], made["pre_tokenizer"], made["model"].get("end_of_word_suffix"), made["post_processor"]) == PLAIN_KIND
        self.special = [x["content"] for x in made["added_tokens"]]
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # pre-tokens of this and the last generation: what is asked for again stays known
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = []
        for p in pieces:
            if p not in known:
                ids = older.get(p)
                if ids is None:
                    fresh.append(p)
                else:
                    known[p] = ids
        if fresh:
            shown = "\n".join(fresh).encode().decode("latin-1").translate(SHOWN).split("\n")
            ids = np.array(self.model.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)[0].ids, self.kind)
            ends = [(e + 1) * self.width for e in np.flatnonzero(self.last[ids]).tolist()]
            data = ids.tobytes()
            known.update(zip(fresh, [data[x:y] for x, y in zip([0, *ends], ends, strict=False)], strict=True))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, and where each word's end."""
        special = sorted({i for x in self.special for i in np.flatnonzero(pc.match_substring(words, x).to_numpy(zero_copy_only=False)).tolist()})
        own = [np.array(self.whole.encode(words[i].as_py(), add_special_tokens=False).ids, self.kind) for i in special]
        if special:
            hidden = np.zeros(len(words), bool)
            hidden[special] = True
            words = pc.if_else(pa.array(hidden), "", words)
        text = "\n".join(words.to_numpy(zero_copy_only=False))
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        pieces = pa.array(PIECES.findall(text), pa.large_string()).dictionary_encode()
        different, codes = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy(zero_copy_only=False)
        feed = different.index("\n") if "\n" in different else -1
        self._learn(different[:feed] + different[feed + 1 :] if feed >= 0 else different)
        self.known["\n"] = b""
        ids = list(map(self.known.__getitem__, different))
        run, ends = ranges(np.frombuffer(b"".join(ids), self.kind), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // self.width, codes)
        for p in [p for p in different if len(p) > LONGEST]:
            del self.known[p]
        # a line feed stands behind every word but the last
        word_ends = np.append(ends[codes == feed], len(run)) if len(words) else np.zeros(0, np.int64)
        for i, put in zip(special, own, strict=True):
            run = np.insert(run, word_ends[i], put)
            word_ends[i:] += len(put)
        return run, word_ends

    def encode(self, texts: pa.Array, end_id: int | None = None) -> pa.Array:
        """Little-endian ids of each text, with ``end_id`` behind; null texts are empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.plain:
            split = pc.ascii_split_whitespace(texts)
            coded = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()).dictionary_encode()
            run, ends = ranges(*self._words(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
            to = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        else:
            made = [e.ids for e in self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            run, to = np.array(list(chain.from_iterable(made)), self.kind), np.cumsum([0, *map(len, made)])
        if end_id is not None:
            run, to = np.insert(run, to[1:], end_id), to + np.arange(len(to))
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((to * self.width).astype(np.int64).tobytes()), pa.py_buffer(run.astype(self.kind).tobytes())])


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, of one row at least."""
    sizes, begin = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end


_encoders: dict[int, Encoder] = {}


def encoder(tokenizer: bytes) -> Encoder:
    key = zlib.crc32(tokenizer)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer)
    return _encoders[key]


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, hash (of the ids), n, width, ids: little-endian arrays.  The driver broadcasts the tokenizer, a file of fixed size."""
    with open(tokenizer, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value)
        for b in batches:
            for first, last in slices(b["text"], GROUP_BYTES):
                ids = e.encode(b["text"].slice(first, last - first), end_id)
                n = pc.divide(pc.binary_length(ids), e.width).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(first, last - first), n, pa.array(np.full(len(ids), e.width, np.int32)), ids.cast(pa.binary())], ["doc_id", "n", "width", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, width int, ids binary")
    return rows.withColumn("hash", F.xxhash64("ids"))


def sample(rows: DataFrame, blocks: int = SAMPLE_BLOCKS) -> DataFrame:
    """hash, block: the ``blocks`` different blocks of least hash over all documents, ties of copies counted once."""
    of = lambda k: F.xxhash64("hash", k)
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK_IDS))
    hashes = rows.select(F.explode(F.transform(numbers, of)).alias("h")).distinct()
    most = hashes.orderBy("h").limit(blocks).agg(F.max("h").alias("most")).first()["most"]
    if most is None:
        return rows.select("hash", F.col("ids").alias("block")).limit(0)
    size = F.lit(BLOCK_IDS).cast("long") * F.col("width")
    picked = rows.select("ids", size.cast("int").alias("size"), F.explode(F.filter(numbers, lambda k: of(k) <= most)).alias("k"), "hash")
    return picked.select(of(F.col("k")).alias("hash"), F.substring(F.col("ids"), (F.col("k") * F.col("size") + 1).cast("int"), F.col("size")).alias("block")).dropDuplicates(["hash"])


def trained(blocks: list[bytes]) -> bytes:
    """A dictionary; of too little to train on, the blocks themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def train_dictionary(rows: DataFrame) -> bytes:
    """Trained in one task over the bounded sample, in the order of its hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = sorted(chain.from_iterable(zip(b["hash"], b["block"], strict=True) for b in batches))
        yield pd.DataFrame({"dictionary": [trained([bytes(b) for _, b in taken])]})

    made = sample(rows).coalesce(1).mapInPandas(run, "dictionary binary").first()  # none of no rows
    return bytes(made["dictionary"]) if made else b""


def opened(folder: str):
    """File system and path of a folder, by its scheme; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("/") else f"file://{folder}")


class FileWriter:
    """Writes documents to a file and tells its row of the manifest."""

    def __init__(self, folder: str, name: str, width: int, dictionary: bytes) -> None:
        system, path = opened(folder)
        self.name, self.out, self.at = name, system.open_output_stream(f"{path}/{name}"), 0
        # each frame says how long its content is; checksums are those of the index and of the ids' readers
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.ids: list[int | None] = []
        self.places, self.starts, self.width, self.raw = [], [0], width, 0
        self._put(MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.places.append(self.at)
        self.starts.append(self.starts[-1] + len(ids) // self.width)
        self.raw += len(ids)
        self._put(self.packer.compress(ids))

    def close(self) -> tuple:
        begin, n = self.at, len(self.ids)
        known = np.array([i is not None for i in self.ids], np.uint8)
        index = np.array([i or 0 for i in self.ids], "<i8").tobytes() + known.tobytes() + np.array([*self.places, begin], "<u8").tobytes() + np.array(self.starts, "<u8").tobytes()
        self._put(index)
        self._put(np.array([begin, n, zlib.crc32(index)], "<u8").tobytes())
        self.out.close()
        named = [i for i in self.ids if i is not None]
        return self.name, n, self.starts[-1], self.at, named[0] if named else None, named[-1] if named else None


class FileReader:
    """Reads any document of a file; refuses a dictionary other than the one it was written with and a damaged index."""

    HEAD, FOOT = len(MAGIC) + 1 + 32, 24

    def __init__(self, folder: str, name: str, dictionary: bytes) -> None:
        system, path = opened(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        head = self.file.read_at(self.HEAD, 0)
        if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) + 1 :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name}: not of this format, or written with another dictionary")
        self.kind = np.dtype(f"<u{head[len(MAGIC)]}")
        end = self.file.size()
        begin, n, crc = (int(x) for x in np.frombuffer(self.file.read_at(self.FOOT, end - self.FOOT), "<u8"))
        index = self.file.read_at(end - self.FOOT - begin, begin)
        if zlib.crc32(index) != crc:
            raise ValueError(f"{name}: damaged index")
        self.ids, self.known = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n)
        self.places, self.starts = np.frombuffer(index, "<u8", n + 1, 9 * n).astype(np.int64), np.frombuffer(index, "<u8", n + 1, 9 * n + 8 * (n + 1)).astype(np.int64)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.ids)

    def frames(self, first: int, last: int) -> Iterator[np.ndarray]:
        """The ids of the documents at places first to last - 1, read from the file at once."""
        data, base = self.file.read_at(int(self.places[last] - self.places[first]), int(self.places[first])), self.places[first]
        for i in range(first, last):
            yield np.frombuffer(self.unpacker.decompress(data[self.places[i] - base : self.places[i + 1] - base]), self.kind)

    def find(self, doc_id: int) -> range:
        """Places of a document's id: one, none, or all of those that are equal."""
        nulls = len(self.ids) - int(self.known.sum())
        a, b = (int(np.searchsorted(self.ids[nulls:], doc_id, side)) + nulls for side in ("left", "right"))
        return range(a, b)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes the ids of all documents to ``folder``.  The driver receives the dictionary and one row for each file."""
    spark = docs.sparkSession
    rows = stage(encoded(docs, tokenizer, end_id), "ids")
    dictionary = train_dictionary(rows)
    total = rows.agg(F.sum(F.col("n") * F.col("width")).alias("bytes")).first()["bytes"] or 0
    shared = spark.sparkContext.broadcast(dictionary)
    system, path = opened(folder)
    system.create_dir(f"{path}/ids")
    with system.open_output_stream(f"{path}/dictionary") as out:
        out.write(dictionary)
    target = f"{folder}/ids"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, made, part, attempt = None, [], TaskContext.get().partitionId(), uuid.uuid4().hex
        for b in batches:
            for doc_id, null, width, ids in zip(b["doc_id"], b["null"], b["width"], b["ids"], strict=True):
                if writer is not None and (writer.raw >= 2 * FILE_BYTES or writer.width != width):
                    made.append((part, len(made), *writer.close()))
                    writer = None
                if writer is None:
                    writer = FileWriter(target, f"{part:08d}-{len(made):05d}-{attempt}", int(width), shared.value)
                writer.add(None if null else int(doc_id), ids)
        if writer is not None:
            made.append((part, len(made), *writer.close()))
        yield pd.DataFrame(made, columns=["part", "nth", *(c.split()[0] for c in FILE.split(", "))]).astype({"first_id": "Int64", "last_id": "Int64"})

    # equal rows are dealt apart by their place in the table, so that copies don't meet in one file
    keyed = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("null"), "hash", F.monotonically_increasing_id().alias("at"), "width", "ids")
    order = [F.col("null").desc(), F.col("doc_id"), F.col("hash"), F.col("at")]
    dealt = keyed.repartitionByRange(max(1, -(-total // FILE_BYTES)), *order).sortWithinPartitions(*order)
    files = sorted(dealt.select("doc_id", "null", "width", "ids").mapInPandas(run, f"part int, nth int, {FILE}").collect())
    start, named = 0, []
    for f in files:
        named.append((*f[2:], start))
        start += f["tokens"]
    spark.createDataFrame(named, f"{FILE}, start long").coalesce(1).write.parquet(f"{folder}/manifest")


def _dictionary(folder: str) -> bytes:
    system, path = opened(folder)
    with system.open_input_file(f"{path}/dictionary") as f:
        return f.read()


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit) of every document, read from the files."""
    shared = spark.sparkContext.broadcast(_dictionary(folder))
    files = spark.read.parquet(f"{folder}/manifest").select("name", "start")
    n = files.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, base in chain.from_iterable(zip(b["name"], b["start"], strict=True) for b in batches):
            r, first = FileReader(f"{folder}/ids", name, shared.value), 0
            while first < len(r):
                most = np.searchsorted(r.starts, r.starts[first] + BATCH_BYTES // 4, "right") - 1
                last = min(len(r), max(first + 1, int(most)))
                ids = [x.astype("<u4").tobytes() for x in r.frames(first, last)]
                doc_ids = pd.array(r.ids[first:last], dtype="Int64")
                doc_ids[r.known[first:last] == 0] = pd.NA
                yield pd.DataFrame({"doc_id": doc_ids, "start": r.starts[first:last] + base, "ids": ids})
                first = last

    return files.repartition(max(1, n)).mapInPandas(run, "doc_id long, start long, ids binary")


def lookup(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with its id): the manifest, the index of a file and one frame are read."""
    names = spark.read.parquet(f"{folder}/manifest").where(F.lit(doc_id).between(F.col("first_id"), F.col("last_id"))).orderBy("start").select("name").collect()
    out, dictionary = [], _dictionary(folder)
    for f in names:
        r = FileReader(f"{folder}/ids", f["name"], dictionary)
        out += [next(r.frames(i, i + 1)).tolist() for i in r.find(doc_id)]
    return out


def output_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes a folder of its own in the shared folder and reads it back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/noteloom/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, tokenizer or os.fspath(public_tokenizers.path(TOKENIZER)))
    return read_ids(spark, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
