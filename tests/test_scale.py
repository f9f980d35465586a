"""What keeps the work and the memory of the similarity join small."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from noteloom.config import CONFIG
from noteloom.functions import predicates as P
from noteloom.functions import text as T
from noteloom.operators import matching as M
from noteloom.operators.slices import map_slices
from noteloom.plans import match_queries as Q
from noteloom.sources.sinks import stored


def pack(rnd, count, say):
    return [{"chunk_id": f"{i:03}", "chapter_title": say(3) if i % 2 else None, "section_title": None, "content": say(rnd.randint(4, 60)), "page_start": i, "page_end": i} for i in range(count)]


def test_only_pairs_that_can_be_among_the_best_are_compared(monkeypatch):
    rnd = random.Random(4)
    words = "tion ing the of ment al".split()
    say = lambda n: "".join(rnd.choice(words) for _ in range(n))
    chunks = pack(rnd, 80, say)
    asked = [{"idx": i, "chapter": say(2), "q_no": 0, "query": q, "core": q, "matching": q, "words": []} for i in range(40) for q in [say(4)]]
    calls, real = [], M.ratio
    monkeypatch.setattr(M, "ratio", lambda a, b: calls.append(1) or real(a, b))
    full = M.Rectangle(M.Queries(asked), M.Chunks(chunks))
    full.lift(full.open & (full.recalled | (full.grams >= 0.6)))
    value, every = full.scores(), len(calls)
    stage = full.accepted(value, CONFIG)
    calls.clear()
    got, kept = M.Rectangle(M.Queries(asked), M.Chunks(chunks)).stages(CONFIG)
    assert len(calls) < every
    for i in range(len(asked)):
        best = lambda v, s: sorted((-round(v[i, j], 4), j, s[i, j]) for j in np.nonzero(s[i] == (1 if (s[i] == 1).sum() >= CONFIG.candidates else s[i]) * (s[i] > 0))[0] if s[i, j])[: CONFIG.candidates]  # noqa: B023, E731
        assert best(got, kept) == best(value, stage)
    order = M.Chunks(chunks).order
    i, j = M.best_pairs(np.round(got, 4), kept, order, 2)
    for q in range(len(asked)):
        for n in (1, 2):
            own = [k for a, k in zip(i, j, strict=True) if a == q and kept[q, k] == n]
            assert set(own) == set(sorted(np.nonzero(kept[q] == n)[0], key=lambda k: (-round(got[q, k], 4), order[k]))[:2])  # noqa: B023


def test_needles_are_found_as_by_search():
    rnd = random.Random(9)
    say = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    for letters in ("abcé", "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))):
        texts = ["", *(say(rnd.randint(0, 90), letters) for _ in range(30))]
        heads = [say(rnd.randint(0, 6), letters) if i % 2 else "" for i in range(len(texts))]
        whole = [h + t for h, t in zip(heads, texts, strict=True)]
        needles = M.Needles(["", "a", "ab", *(w[at : at + n] for w in whole for n in (1, 2, 3, 8, 12, 40) for at in [rnd.randint(0, len(w))]), *(say(n, letters) for n in range(1, 12))])
        held = needles.held(texts, M.Codes(texts))
        found = needles.found(texts, held, M.Codes(texts))
        assert [[bool(n) and n in t for t in texts] for n in needles.needles] == found.tolist()
        assert (held == needles.table([needles.grams(t, 1) | needles.grams(t, 2) for t in texts])).all()
        more, begun = needles.held_with(heads, texts, held)
        assert [[bool(n) and n in t for t in whole] for n in needles.needles] == needles.found_with(heads, texts, more, begun, found).tolist()


def test_frames_stay_small(spark):
    """A batch of a thousand rows comes to Python in frames of seven."""
    rows = spark.range(1000, numPartitions=1).select("id", F.array(F.struct(F.col("id").alias("n"), F.lit("x").alias("s"))).alias("rows"))

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "size": len(f), "rows": f["rows"]})

    got = map_slices(rows, run, "id long, size int, rows array<struct<n:bigint,s:string>>", 7).collect()
    assert sorted(r.id for r in got) == list(range(1000)) and max(r["size"] for r in got) == 7
    assert all(r.rows[0].n == r.id and r.rows[0].s == "x" for r in got)


def test_passages_are_prepared_once(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    plans = Q.passage_plans(spark, d)
    assert "prepared" in plans.columns
    key = lambda df: sorted((r.project, r.idx, r.q_no, r.query, r.core, r.matching, tuple(r.words)) for r in df.collect())
    assert key(M.retrieval_queries(plans)) == key(M.retrieval_queries(plans.drop("prepared")))


def test_texts_are_worked_out_once(spark):
    """Predicates name a long text's expression once, so that no row works it out again for each use."""
    df = spark.createDataFrame([("绪论", "第一章 绪论\n正文", "一", ["正", "文"])], "c string, t string, s string, k array<string>")
    long_text = F.initcap("t")
    made = {
        "recall": (P.recall_evidence(F.initcap("c"), F.col("k"), F.upper(long_text)), 1), "short": (P.is_structural_short(long_text, F.col("c"), F.col("s")), 1),
        "heading": (P.heading_confirmed(F.col("c"), long_text, F.lit(1), F.lit(1)), 1), "characters": (T.body_characters(F.initcap("c"), F.col("t")), 1),
    }
    for name, (column, most) in made.items():
        plan = df.select(column.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("initcap(t") <= most, name
        assert plan.count("initcap(c") <= 1, name
    got = df.select(P.recall_evidence(F.col("c"), F.col("k"), F.col("t")).alias("found"), P.recall_evidence(F.col("s"), F.array(F.lit("正")), F.col("t")).alias("other")).first()
    assert got.found and got.other
    empty = df.select(P.recall_evidence(F.lit(""), F.array(F.lit("q"), F.lit("文")), F.col("t")).alias("found")).first()
    assert empty.found is False


def test_a_task_of_rectangles_holds_a_few_million_characters(spark):
    """Twenty million characters of small projects are dealt to more tasks than run at once, as one task's rows come to Python together."""
    chunks = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("project"), F.col("id").cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("chapter_title"), F.lit(None).cast("string").alias("section_title"), F.repeat(F.lit("x"), 500_000).alias("content"), F.col("id").alias("page_start"), F.col("id").alias("page_end"))
    queries = chunks.select("project", F.lit(0).cast("long").alias("idx"), F.lit("c").alias("chapter"), F.lit(0).alias("q_no"), F.lit("q").alias("query"), F.lit("q").alias("core"), F.lit("q").alias("matching"), F.array(F.lit("q")).alias("words"))
    dealt = M.rectangles(queries, chunks, CONFIG)
    assert dealt.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert dealt.count() == 40


def test_ratio_is_that_of_the_standard_library():
    from difflib import SequenceMatcher

    rnd = random.Random(2)
    say = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    for letters in ("ab", "abcdef甲乙", "etaoin"):
        for most in (12, 60, 199, 260):
            for _ in range(60):
                a, b = say(rnd.randint(0, 40), letters), say(rnd.randint(0, most), letters)
                assert M.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    assert M.matched("", "") == 0 and M.matched("abxcd", "abcdxab") == SequenceMatcher(None, "abxcd", "abcdxab").ratio() * 6


def test_letters_bound_what_is_compared_and_few_pairs_are(monkeypatch):
    """No ratio is above the bound of its pair, and the best scores are known after few of them."""
    rnd = random.Random(8)
    words = "tion ing the of ment al qu x".split()
    say = lambda n: "".join(rnd.choice(words) for _ in range(n))
    chunks = M.Chunks(pack(rnd, 60, say))
    asked = M.Queries([{"idx": i, "chapter": None, "q_no": 0, "query": q, "core": q, "matching": q, "words": []} for i in range(30) for q in [say(1 + i)]])
    full = M.Rectangle(asked, chunks)
    for kind, bound in enumerate(full._compared()):
        for i, k in enumerate(asked.keys):
            for j in range(60):
                other = (chunks.section[j], chunks.chapter[j], chunks.body[j][: max(len(k) * 6, 160)])[kind]
                assert M.ratio(k, other) <= bound[i, j] or not k + other
                assert kind == 2 or bound[i, j] == 2 * M.common_letters(k, other) / max(len(k) + len(other), 1)
    calls, real = [], M.ratio
    monkeypatch.setattr(M, "ratio", lambda a, b: calls.append(1) or real(a, b))
    looked = M.Rectangle(asked, chunks).top_scores()
    few = len(calls)
    calls.clear()
    full.lift(full.open)
    assert looked.tolist() == np.where(full.open, full.scores(), 0).max(axis=1).tolist() and few < len(calls)


def test_chunks_that_meet_several_packs_of_queries_are_prepared_once(monkeypatch):
    rnd = random.Random(3)
    chunks = [pack(rnd, 5, lambda n: "ab" * n) for _ in range(2)]
    asked = [[{"idx": i, "chapter": None, "q_no": 0, "query": "ab", "core": "ab", "matching": "ab", "words": []}] for i in range(3)]
    made, real = [], M.Chunks
    monkeypatch.setattr(M, "Chunks", lambda rows: made.append(1) or real(rows))
    frames = (pd.DataFrame({"project": ["p"], "queries": [q], "chunks": [c]}) for c in chunks for q in asked)
    assert [(q.rows[0]["idx"], c.rows == chunks[n // 3]) for n, (_, q, c) in enumerate(M.met(frames))] == [(n % 3, True) for n in range(6)] and len(made) == 2


def test_near_copies_are_told_as_by_the_whole_ratio(monkeypatch):
    from difflib import SequenceMatcher

    rnd = random.Random(6)
    words = [("".join(rnd.choice("etaoinshrdlucmq") for _ in range(rnd.randint(1, 9)))) for _ in range(300)]
    calls, real = [], SequenceMatcher.find_longest_match
    monkeypatch.setattr(SequenceMatcher, "find_longest_match", lambda *x: calls.append(1) or real(*x))
    few = every = 0
    for n in (3, 40, 120):
        for _ in range(25):
            a = [rnd.choice(words) for _ in range(n)]
            b = [rnd.choice(words) if rnd.random() < rnd.choice((0.02, 0.3)) else w for w in a] if rnd.random() < 0.6 else [rnd.choice(words) for _ in range(n)]
            x, y = " ".join(a), " ".join(b)
            calls.clear()
            whole = SequenceMatcher(None, x, y).ratio()
            every += 3 * len(calls)
            calls.clear()
            assert [M.reaches(x, y, least) for least in (0.65, whole, 0.9)] == [whole >= least for least in (0.65, whole, 0.9)]
            few += len(calls)
    assert few < every


def test_texts_of_neighbours_in_which_nothing_is_recalled_stay_behind(spark):
    """Only the neighbour that holds the query's core phrase comes to the choice of evidence."""
    texts = ["双因素理论 " + "甲乙" * 20, "其他 " + "丙丁" * 20, "说到双因素 理论的 " + "戊己" * 20]
    chunks = spark.createDataFrame([("p", "p", str(i), i, i + 1, i + 1, "第1章 理论", None, t) for i, t in enumerate(texts)], "project string, doc string, chunk_id string, position long, page_start long, page_end long, chapter_title string, section_title string, content string")
    plans = spark.createDataFrame([("p", 0, None, ["双因素理论"], [])], "project string, idx long, chapter string, queries array<string>, subqueries array<string>")
    near = spark.createDataFrame([("p", 0, c, ["双因素理论"]) for c in ("1", "2")], "project string, idx long, chunk_id string, matched_queries array<string>")
    assert [r.chunk_id for r in M.recalled_neighbours(near, M.retrieval_queries(plans), chunks).collect()] == ["2"]


def test_texts_are_matched_and_moved_once(spark):
    """Nothing that is written is worked out again behind it, and no text goes along with candidates."""
    nodes = lambda plan: [plan, *(n for i in range(plan.children().size()) for n in nodes(plan.children().apply(i)))]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan()
    assert not [n for n in nodes(plan(Q.j08_failure_diagnostic(spark, "/root/testdata/sf0.001"))) if n.nodeName().startswith("MapIn")]
    joined = next(n for n in nodes(plan(Q.h12_h13_score(spark, "/root/testdata/sf0.001"))) if n.nodeName() == "Join")
    assert {"content", "text"}.isdisjoint(joined.output().apply(i).name() for i in range(joined.output().size()))


def test_a_table_isnt_written_again(spark, tmp_path):
    made = spark.range(9).withColumn("n", F.col("id") % 2)
    made.write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t").where("n = 1").select("id")
    assert stored(table, "x") is table
    for df in (made, table.distinct(), table.unionByName(table), table.join(table, "id")):
        again = stored(df, "x")
        assert again is not df and sorted(again.collect()) == sorted(df.collect())
