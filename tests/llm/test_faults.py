"""Private keys as a whole, texts with many matches, columns of odd names and types, repeated training rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noteloom.llm import mixing, quality, reshard, secrets, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def key_text(body: str, name: str = "RSA ") -> str:
    return f"-----BEGIN {name}PRIVATE KEY-----\n{body}\n-----END {name}PRIVATE KEY-----"


def body(seed: int, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    rnd = random.Random(seed)
    return "\n".join("".join(rnd.choice(letters) for _ in range(64)) for _ in range(12)) + "\nabc="


def holders():
    return F.concat_ws("/", "source", "lang"), F.col("source")


def test_private_keys_are_masked_whole(spark):
    shared = key_text(body(99))
    rows = [(i, f"note {i}\n{key_text(body(i))}\nafter", "en", f"owner{i}", 0) for i in range(4)]
    rows += [(10 + i, f"docs say\n{shared}\nend", "en", f"owner{i}", 0) for i in range(4)]
    rows += [(20, "-----BEGIN PRIVATE KEY----- begins such a file, and so on", "en", "owner0", 0)]
    rows += [(21, f"cut off\n-----BEGIN PRIVATE KEY-----\n{body(50)[:300]}\n\nNext paragraph, untouched.", "en", "owner1", 0)]
    rows += [(22, "-----BEGIN EC PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n" + body(60) + "\n-----END EC PRIVATE KEY----- x", "en", "owner2", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r.text for r in secrets.redact(docs, *holders()).collect()}
    assert all(out[i] == f"note {i}\n[SECRET]\nafter" for i in range(4))
    assert all(out[10 + i] == rows[4 + i][1] for i in range(4))  # four owners copy it: an example
    assert out[20] == rows[8][1] and out[22] == "[SECRET] x"
    assert out[21].startswith("cut off\n[SECRET]") and out[21].endswith("Next paragraph, untouched.") and body(50)[:60] not in out[21]


def test_texts_with_many_matches(spark):
    rnd = random.Random(8)
    n = 2 * secrets.TOGETHER + 3
    parts = [rnd.choice(("password=abcdefghijkl{:04d}", "token: x{:03d}", "AKIA" + "Z" * 12 + "{:02d}", "0123456789abcdef{:02d}")).format(i) for i in range(n)]
    text = "é ".join(parts)
    got = secrets.secret_spans(spark.createDataFrame([(1, text, "en", "s", 0)], DOCS), *holders()).first()
    kinds = (("assign", re.compile(secrets.ASSIGN.replace("\\x20", " "))), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))
    least = {"assign": 12, "access": 18, "hex": 16}
    want = sorted((m.start(), k, m.end()) for k, (name, p) in enumerate(kinds) for m in p.finditer(text) if len(m[1] if k == 0 else m[0]) >= least[name])
    base = [x for x in got.spans.split(",") if x.split(":")[0] in least]
    assert base == [f"{kinds[k][0]}:{a}:{b}" for a, k, b in want] and got.n_assign + got.n_access + got.n_hex == len(want) > secrets.TOGETHER



def odd_columns():
    return {"a.b": F.lit(1), "c`d": F.lit("x"), "document": F.lit("y"), "m": F.create_map(F.lit("k"), F.array(F.lit(1.5))), "s.t": F.struct(F.create_map(F.lit(1), F.lit("v")).alias("in.ner"))}


@pytest.mark.parametrize("name", ["redact", "deduplicate", "mix_documents", "reshard_documents"])
def test_columns_of_odd_names_and_types(spark, name):
    rows = [(i, " ".join(f"w{i % 6}{k}" for k in range(60)) + f' secret = "{random.Random(i % 6).getrandbits(128):032x}"', "en", f"s{i % 3}", 0) for i in range(12)] + [(None, None, None, None, None)]
    plain = spark.createDataFrame(rows, DOCS)
    job = {"redact": lambda d: secrets.redact(d, *holders()), "deduplicate": simhash.deduplicate, "mix_documents": mixing.mix_documents, "reshard_documents": reshard.reshard_documents}[name]
    odd = job(plain.withColumns(odd_columns()))
    if name == "reshard_documents":
        assert Counter((r.doc_id, r.size) for r in odd.collect()) == Counter((r.doc_id, r.size) for r in job(plain).collect())
        return
    assert odd.columns == [*plain.columns, *odd_columns()] and odd.schema["m"].dataType == plain.withColumns(odd_columns()).schema["m"].dataType
    assert Counter((r["doc_id"], r["text"]) for r in odd.collect()) == Counter((r.doc_id, r.text) for r in job(plain).collect())


def test_repeated_rows_train_once(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(("the", "of", "x#", "Q", "12", "word,")) for _ in range(rnd.randint(5, 90))), "en", "s", 0) for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(80)], "doc_id long, quality int")
    once = {r.doc_id: round(r.score, 9) for r in quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    more = quality.classify(spark.createDataFrame(rows + rows[:40] * 3, DOCS), labels).collect()
    assert len(more) == 200 and all(round(r.score, 9) == once[r.doc_id] for r in more) and len(set(once.values())) > 40
