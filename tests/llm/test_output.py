"""Fill-in-middle, token-id files and hard negatives against brute force and exact round trips, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from noteloom.llm import fim, idfiles, negatives, queries
from noteloom.llm.common import shared_dir

DOCS = "doc_id long, text string"
ODD = [
    (0, None), (1, ""), (2, "x"), (3, "a <P> b"), (4, "<S>"), (5, "It's Ünḯ H̱ ΑΣ Σ 12½ é日本 😀<|endoftext|>\n\n\tq"), (6, "x" * 70_000), (7, "tail<" * 400), (8, "d d d"), (8, "d d d"),
    (8, "other of one id"), (None, "no id"), (None, None), (9, "ab\x1cc \x85 d e  <|EndOfText|>"), (-5, "below zero, first"),
]


def corpus(n: int = 300) -> list[tuple]:
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(("an", "The", "ion", "re", "é", "ou", "S", "7", "'s")) for _ in range(rnd.randint(1, 5)))
    return ODD + [(100 + i, rnd.choice(" \n\t").join(word() + rnd.choice(("", ",", ".")) for _ in range(rnd.randint(0, 300)))) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).withColumn("n", F.lit("clash")).withColumn("a.b`c", F.create_map(F.lit("k"), F.lit(1))).persist()


# 11 -----------------------------------------------------------------------------------------------------------------


def test_skip_list_finds_every_rank():
    rnd = random.Random(3)
    for n in (0, 1, 2, 16, 17, 400, 5000):
        widths = np.array([rnd.randint(1, 9) for _ in range(n)], np.int64)
        units, before = fim.SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
        assert len(units) == n and all(units.seek(r) == before[min(r, n)] for r in {*range(0, n + 3, max(1, n // 97)), n, n + 1})
        for lane, below in zip(units.units[1:], units.units, strict=False):
            assert lane.sum() == below.sum() == n and len(lane) < len(below)
        assert all(p.sum() == widths.sum() for p in units.points)


def test_lanes_are_short():
    units = fim.SkipList(np.ones(1 << 20, np.int64))
    assert len(units.units) >= 5 and len(units.units[-1]) <= 64
    assert all(units.seek(r) == r for r in random.Random(1).sample(range(1 << 20), 200))


def by_hand(doc_id: int | None, text: str | None) -> tuple:
    t, x = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(t), "plain", None, None, sha(t), sha(t)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if form == "spm" else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    return doc_id, len(t), form, a, b - a, sha(out), sha(t)


def test_fim_equals_brute_force(docs):
    got = Counter(map(tuple, fim.transformation_digest(docs).collect()))
    assert got == Counter(by_hand(i, t) for i, t in corpus())
    assert {k[2] for k in got} == {"plain", "psm", "spm"}


def test_fim_keeps_columns_and_cuts_words(docs):
    made = fim.fill_in_middle(docs, unit=r"\S+")
    rows = made.select("document.*", "form", "output", "n", "prefix_chars", "middle_chars", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(corpus()) and made.select("document.*").columns == docs.columns
    for r in made.select("document.text", "n", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect():
        text = r["text"] or ""
        starts = [m.start() for m in regex.finditer(r"\S+", text)]
        assert r["back"] == text and r["n"] == (len(starts) or bool(text))
        if r["prefix_chars"] is not None:
            assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= {0, len(text), *starts[1:]}
    assert fim.transformation_digest(docs.limit(0)).collect() == []


# 12 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(idfiles.TOKENIZER)
    return path, Tokenizer.from_file(str(path))


def test_encoder_equals_the_library(tokenizer):
    path, library = tokenizer
    with open(path, "rb") as f:
        e = idfiles.Encoder(f.read())
    rnd = random.Random(2)
    letters = [chr(c) for c in (*range(1, 0x250), *range(0x300, 0x370), *range(0x370, 0x400), 0x1E96, 0x2028, 0x3000, 0xAC00, 0x1100, 0x1161, 0x212A, 0x1F600)]
    texts = [t for _, t in corpus()] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    expected = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert e.plain and [np.frombuffer(x, e.kind).tolist() for x in e.encode(pa.array(texts), 1).to_pylist()] == expected
    e.plain = False
    assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(pa.array(texts[:40]), 1).to_pylist()] == expected[:40]


def test_encoder_forgets(tokenizer, monkeypatch):
    with open(tokenizer[0], "rb") as f:
        e = idfiles.Encoder(f.read())
    monkeypatch.setattr(idfiles, "REMEMBERED", 50)
    for part in np.array_split(np.array([t or "" for _, t in corpus()], object), 9):
        got = [np.frombuffer(x, e.kind).tolist() for x in e.encode(pa.array(part.tolist(), pa.string())).to_pylist()]
        assert got == [tokenizer[1].encode(t, add_special_tokens=False).ids for t in part]
    assert list(idfiles.slices(pa.array(["aa", None, "b" * 50, "c"]), 3)) == [(0, 2), (2, 3), (3, 4)]


def expected_ids(rows, library):
    out, start = [], 0
    ordered = sorted(((i is not None, i or 0, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows))
    for known, i, ids in ordered:
        out.append((i if known else None, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out, start


def test_id_files_round_trip(docs, tokenizer, monkeypatch):
    monkeypatch.setattr(idfiles, "FILE_BYTES", 40_000)
    got = [tuple(r) for r in idfiles.output_digest(docs).orderBy("start").collect()]
    want, total = expected_ids(corpus(), tokenizer[1])
    assert Counter((i, n, c) for i, _, n, c in got) == Counter(want)
    assert [i for i, *_ in got] == [i for i, *_ in want]  # ascending, null ids first
    assert [s for _, s, _, _ in got] == [0, *np.cumsum([n for _, _, n, _ in got])[:-1]] and got[-1][1] + got[-1][2] == total


def test_id_files_lookup_and_faults(spark, docs, tokenizer, monkeypatch):
    monkeypatch.setattr(idfiles, "FILE_BYTES", 20_000)
    path, library = tokenizer
    folder = f"{shared_dir(spark)}/noteloom/ids-{uuid.uuid4().hex}"
    idfiles.write_ids(docs, folder, str(path))
    files = spark.read.parquet(f"{folder}/manifest").orderBy("start").collect()
    assert len(files) > 3 and sum(f["docs"] for f in files) == len(corpus())
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    for i in (5, 6, 8, 9, -5, 150, 4242):
        assert sorted(idfiles.lookup(spark, folder, i)) == sorted(ids(t) for k, t in corpus() if k == i)
    dictionary = idfiles._dictionary(folder)
    with pytest.raises(ValueError, match="another dictionary"):
        idfiles.FileReader(f"{folder}/ids", files[0]["name"], dictionary + b"x")
    local = f"{folder.removeprefix('file://')}/ids/{files[0]['name']}"
    with open(local, "r+b") as f:
        f.seek(os.path.getsize(local) - 40)
        f.write(b"\xff\xfe\xfd")
    with pytest.raises(ValueError, match="damaged index"):
        idfiles.FileReader(f"{folder}/ids", files[0]["name"], dictionary)


def test_id_files_of_no_documents(docs):
    assert idfiles.output_digest(docs.limit(0)).collect() == []


def test_sample_is_bounded_and_of_all_blocks(spark, docs, tokenizer):
    rows = idfiles.encoded(docs, str(tokenizer[0]), 1).persist()
    every = {r["hash"] for r in idfiles.sample(rows, 10_000).collect()}
    few = idfiles.sample(rows, 20).collect()
    assert len(few) == 20 and {r["hash"] for r in few} == set(sorted(every)[:20]) and max(len(r["block"]) for r in few) <= 2 * idfiles.BLOCK_IDS
    assert len(every) >= rows.select("hash").distinct().count()


# 13 -----------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def mined(rows: list[tuple]) -> Counter:
    own = []
    for i, e, label in rows:
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            own.append((i, [math.floor(256 * float(np.float32(x))) for x in e], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    place = lambda i: (i is None, i or 0)
    out: Counter = Counter()
    for n, (i, q, label) in enumerate(own):
        if i is None or i % 100:
            continue
        others = sorted(((-dot(q, o[1]), place(o[0]), k) for k, o in enumerate(own) if k != n))
        for s, _, k in [x for x in others if own[x[2]][2] == label][:5]:
            fits = [x for x in others if own[x[2]][2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out.update((i, own[k][0], r, own[x[2]][0], -s, -x[0]) for r, x in enumerate(fits, 1))
    return out


def vectors(n: int = 700, dims: int = 20) -> list[tuple]:
    rnd = np.random.default_rng(4)
    centre = rnd.normal(size=dims)
    out = [(int(i), (0.6 * centre + rnd.normal(size=dims)).astype(np.float32).tolist(), int(rnd.integers(0, 4))) for i in range(n)]
    out += [(n + k, out[100][1], k % 3) for k in range(120)]  # one vector in many rows
    bad = [(100, None, 1), (200, out[0][1], None), (300, [None, 1.0], 1), (400, [float("nan")], 1), (500, [float("inf")], 2), (None, out[3][1], out[3][2]), (2000, [], 1), (2100, [0.5, -0.25], 1), (7, [9.0] * 30, 2)]
    return out + bad + [out[0], out[0], out[100]]


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "PACK_ROWS", 97)
    monkeypatch.setattr(negatives, "PACK_ANCHORS", 3)
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("a.b", F.lit(1)).withColumn("score", F.lit("clash"))
    want = mined(rows)
    assert len(want) > 100
    assert Counter(tuple(r) for r in negatives.mine(df).collect()) == want
    monkeypatch.setattr(negatives, "BROADCAST_BYTES", -1)
    assert Counter(tuple(r) for r in negatives.mine(df).collect()) == want
    assert negatives.mine(df.limit(0)).collect() == [] and negatives.mine(df.where("vec_id % 100 != 0")).collect() == []


@pytest.mark.parametrize(("dims", "most"), [(1, 3), (8, 200), (13, 1 << 20), (64, 1 << 25)])
def test_scores_are_inner_products(dims, most):
    rnd = np.random.default_rng(dims)
    a, b = rnd.integers(-most, most + 1, (5, dims)), rnd.integers(-most, most + 1, (300, dims))
    assert (negatives.scores(negatives.subset_sums(a), negatives.planes_of(b)) == b @ a.T).all()
    short = b[:, : dims // 2]
    assert (negatives.scores(negatives.subset_sums(a), negatives.planes_of(short)) == short @ a[:, : dims // 2].T).all()


def test_components_too_large(spark):
    with pytest.raises(Exception, match="components beyond"):
        negatives.mine(spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1)], VECTORS)).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["op11_fim_skip_list", "op13_four_russians_negatives"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    answer = con.execute(queries.ORACLE_SQL[name])
    place = {d[0]: i for i, d in enumerate(answer.description)}
    assert sorted(place) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in df.columns) for r in df.collect()) == Counter(tuple(r[place[c]] for c in df.columns) for r in answer.fetchall())
