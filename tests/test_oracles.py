"""Registered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import datetime
import math
import os

import pytest

from noteloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind here; the driver compares them all.
NAMES = [n for n in sorted(catalog.ORACLE_SQL) if n[:3] in ("h02", "h05", "b03", "c02", "c03", "c09", "c13", "c15", "d05", "e02", "e04", "e06", "f01", "g02", "j07", "p09", "a09", "a10", "s02", "s04")]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    answer = duck.execute(catalog.ORACLE_SQL[name])
    place = {d[0]: i for i, d in enumerate(answer.description)}
    assert sorted(place) == columns
    assert got == sorted((tuple(plain(r[place[c]]) for c in columns) for r in answer.fetchall()), key=repr)


def test_entry_lists_queries():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and len(known) > 100


def test_lines_of_blanks_and_odd_ends_are_judged_as_in_sql(spark, tmp_path):
    import duckdb

    odd = ["a\n\n\nb\n\n", "", "\n- \n", "　x　\n\xa0\n\xa0y", "1. a\r\n- b\r\n\r\n\r", "- a b\n1.\x85c\nd\x0b", "\x0b- a\n\t\n•\n· \n（一）", None, "x\ny\nz\n \n  \n"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["b13_classify_blocks"](spark, str(tmp_path)).select("doc_id", "run", "kind", "n").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(f"SELECT doc_id, run, kind, n FROM ({catalog.ORACLE_SQL['b13_classify_blocks']})").fetchall())
