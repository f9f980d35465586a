"""From page text to blocks, chunks and reliable chapters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..functions import predicates as P
from ..functions import text as T
from .slices import map_slices


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no, line (trimmed; blank lines stay as breaks)."""
    return pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\\r\\n|\\r|\\n", -1)).alias("line_no", "line")).withColumn("line", F.btrim(F.col("line"), F.lit(" \t\f\u000b　")))


def outline_titles(outline: DataFrame) -> DataFrame:
    """doc_id, page_number, outline_title: entries of the lowest level, the last of a page."""
    level = F.min("level").over(Window.partitionBy("doc_id"))
    return outline.withColumn("least", level).where("level = least").groupBy("doc_id", "page_number").agg(F.max_by("title", "ord").alias("outline_title"))


def build_blocks(pages: DataFrame, outline: DataFrame | None = None, config: Config = CONFIG) -> DataFrame:
    """doc_id, block_no, kind, page_number, raw_text.

    Adjacent other lines of a page form a content block.  From the first outline title on, titles of the outline are
    the chapters: equal chapter lines of that page vanish and others count as content.
    """
    lines = page_lines(pages)
    if outline is not None:
        titles = outline_titles(outline)
        lines = lines.join(titles, ["doc_id", "page_number"], "left")
        heads = pages.select("doc_id", "page_number").join(titles, ["doc_id", "page_number"]).select("doc_id", "page_number", F.lit(-1).alias("line_no"), F.col("outline_title").alias("line"), "outline_title")
        lines = lines.unionByName(heads)
    else:
        lines = lines.withColumn("outline_title", F.lit(None).cast("string"))
    order = Window.partitionBy("doc_id").orderBy("page_number", "line_no")
    active = F.max((F.col("line_no") == -1).cast("int")).over(order) == 1
    found = P.heading_kind(F.col("line"), config.chapter_line, config.section_line)
    same = (F.regexp_replace(F.lower("line"), "[^\\p{L}\\p{N}_]+", "") == F.regexp_replace(F.lower("outline_title"), "[^\\p{L}\\p{N}_]+", "")) & F.col("outline_title").isNotNull()
    kind = (
        F.when(F.col("line") == "", "blank").when(F.col("line_no") == -1, "chapter")
        .when((found == "chapter") & F.col("active"), F.when(same, "skip").otherwise("content")).otherwise(F.coalesce(found, F.lit("content")))
    )
    k = lines.withColumn("active", active).withColumn("kind", kind).where("kind != 'skip'")
    fresh = (F.col("kind") != "content") | (F.lag("kind").over(order) != "content") | (F.lag("page_number").over(order) != F.col("page_number")) | F.lag("kind").over(order).isNull()
    k = k.withColumn("run", F.sum(fresh.cast("int")).over(order)).where("kind != 'blank'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    blocks = k.groupBy("doc_id", "run").agg(F.first("kind").alias("kind"), F.first("page_number").alias("page_number"), joined.alias("raw_text"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1
    return blocks.select("doc_id", number.alias("block_no"), "kind", "page_number", "raw_text")


def fill_headings(blocks: DataFrame) -> DataFrame:
    """blocks with chapter_title, section_title (cleared at a new chapter) and run, the number of headings so far."""
    order = Window.partitionBy("doc_id").orderBy("block_no")
    is_ = lambda k: F.col("kind") == k
    b = blocks.withColumn("chapter_title", F.last(F.when(is_("chapter"), F.col("raw_text")), ignorenulls=True).over(order))
    b = b.withColumn("chapter_no", F.sum(is_("chapter").cast("int")).over(order)).withColumn("run", F.sum((~is_("content")).cast("int")).over(order))
    inside = Window.partitionBy("doc_id", "chapter_no").orderBy("block_no")
    return b.withColumn("section_title", F.last(F.when(is_("section"), F.col("raw_text")), ignorenulls=True).over(inside)).drop("chapter_no")


def cut_words(text: str, target: int, maximum: int) -> list[str]:
    """By words up to ``target`` characters; a single word every ``maximum``."""
    words = text.split()
    if len(words) < 2:
        return [text[i : i + maximum] for i in range(0, len(text), maximum)]
    out, size = [[words[0]]], len(words[0])
    for w in words[1:]:
        if size + 1 + len(w) > target:
            out.append([])
            size = -1
        out[-1].append(w)
        size += 1 + len(w)
    return [" ".join(x) for x in out]


def cut_oversized(text: str, target: int, maximum: int) -> list[str]:
    """By sentences up to ``target`` characters where there is more than one, long sentences by words."""
    if len(text) <= maximum:
        return [text]
    sentences = [s for s in (x.strip() for x in re.split(r"(?<=[。！？!?；;])\s*", text)) if s]
    if len(sentences) < 2:
        return cut_words(text, target, maximum)
    out: list[str] = []
    open_ = False
    for s in sentences:
        if len(s) > maximum:
            out += cut_words(s, target, maximum)
            open_ = False
        elif open_ and len(out[-1]) + len(s) <= target:
            out[-1] += s
        else:
            out.append(s)
            open_ = True
    return out


class _SplitText:
    def eval(self, text: str | None, target: int, maximum: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(cut_oversized(text, target, maximum) if text else ())


def split_text():
    """Table function split_text(text, target, maximum): position, part; null and empty texts give no rows.  For lateral joins and spark.udtf.register."""
    return F.udtf(_SplitText, returnType="position int, part string")


def pack(run: list[tuple[str, int, str]], target: int, maximum: int) -> list[tuple[int, int, str]]:
    """Chunks (first page, last page, text) of one heading run of (kind, page, text); sizes don't count separators."""
    out: list[list[tuple[int, str]]] = []
    size = 0
    for kind, page, text in run:
        for part in [text] if kind != "content" else cut_oversized(text, target, maximum):
            if not out or (kind == "content" and size + len(part) > target):
                out.append([])
                size = 0
            out[-1].append((page, part))
            size += len(part)
    packed = [(min(p for p, _ in c), max(p for p, _ in c), "\n\n".join(t for _, t in c).strip()) for c in out if c]
    return [x for x in packed if x[2]]


#: Heading runs, with all their blocks, that a Python worker holds at once.
RUNS_AT_ONCE = 16


def split_chunks(blocks: DataFrame, config: Config = CONFIG) -> DataFrame:
    """doc_id, position, page_start, page_end, chapter_title, section_title, content.

    Greedy packing depends on order, so each heading run of a document is packed by a small function over its blocks.
    """
    runs = fill_headings(blocks).groupBy("doc_id", "run").agg(
        F.first("chapter_title").alias("chapter_title"), F.max_by("section_title", "block_no").alias("section_title"), F.array_sort(F.collect_list(F.struct("block_no", "kind", "page_number", "raw_text"))).alias("blocks")
    )
    doc = blocks.schema["doc_id"].dataType.simpleString()
    target, maximum = config.target_size, config.maximum_size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (d, r, k, *chunk, c, s)
                for d, r, c, s, xs in zip(b["doc_id"], b["run"], b["chapter_title"], b["section_title"], b["blocks"], strict=True)
                for k, chunk in enumerate(pack([(x["kind"], x["page_number"], x["raw_text"]) for x in xs], target, maximum))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "run", "k", "page_start", "page_end", "content", "chapter_title", "section_title"])

    packed = map_slices(runs, run, f"doc_id {doc}, run long, k int, page_start long, page_end long, content string, chapter_title string, section_title string", RUNS_AT_ONCE)
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "k")) - 1
    return packed.select("doc_id", position.alias("position"), "page_start", "page_end", "chapter_title", "section_title", "content")


def collapse_repeats(lines: DataFrame) -> DataFrame:
    """Lines without blanks and without those equal to the line before."""
    kept = lines.withColumn("line", F.btrim("line")).where("line != ''")
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return kept.withColumn("before", before).where("before is null or before != line").drop("before")


def chapter_candidates(chunks: DataFrame) -> DataFrame:
    """Chunks whose chapter title is a confirmed heading and not a contents list."""
    title = T.blank_free(F.coalesce("chapter_title", F.lit("")))
    c = chunks.withColumn("title", title)
    sound = P.is_displayable_chapter(F.col("title")) & P.heading_confirmed(F.col("title"), F.col("content"), F.col("page_start"), F.col("page_end")) & ~P.looks_like_toc(F.col("content"))
    return c.where(sound).select("doc", "position", "page_start", "title", T.title_key(F.col("title")).alias("key"), T.chapter_number(F.col("title")).alias("number"), T.body_characters(F.col("title"), F.col("content")).alias("characters"))


def boundary_runs(candidates: DataFrame) -> DataFrame:
    """The best run of boundaries of each document.

    A run ends where a title repeats in it or a number doesn't rise; the state is carried by a fold over the document's
    few candidate headings.  Best: most titles, widest pages, most characters, last page; the first run on ties.
    """
    ordered = candidates.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("position", "page_start", "title", "key", "number", "characters"))).alias("xs"))
    one = "struct<position:bigint,page_start:bigint,title:string,key:string,number:int,characters:int>"
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<string>").alias("seen"), F.lit(None).cast("int").alias("last"), F.array().cast(f"array<struct<run:int,x:{one}>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        ends = (F.size(s["seen"]) > 0) & (F.array_contains(s["seen"], x["key"]) | (s["last"].isNotNull() & x["number"].isNotNull() & (x["number"] <= s["last"])))
        run = s["run"] + ends.cast("int")
        seen = F.when(ends, F.array(x["key"])).otherwise(F.concat(s["seen"], F.array(x["key"])))
        last = F.coalesce(x["number"], F.when(~ends, s["last"]))
        return F.struct(run.alias("run"), seen.alias("seen"), last.alias("last"), F.concat(s["out"], F.array(F.struct(run.alias("run"), x.cast(one).alias("x")))).alias("out"))

    flat = ordered.select("doc", F.explode(F.aggregate("xs", start, step, lambda s: s["out"])).alias("r")).select("doc", "r.run", "r.x.*")
    score = F.struct(F.count_distinct("key").alias("titles"), (F.max("page_start") - F.min("page_start")).alias("span"), F.sum("characters").alias("characters"), F.max("page_start").alias("page"), (-F.col("run")).alias("first"))
    best = flat.groupBy("doc", "run").agg(score.alias("score")).groupBy("doc").agg(F.max_by("run", "score").alias("run"))
    return flat.join(best, ["doc", "run"]).select("doc", "position", "page_start", "title", "number")


def asof_chapter(chunks: DataFrame, boundaries: DataFrame) -> DataFrame:
    """doc, position, chapter: the title of the last boundary at or before each chunk."""
    both = chunks.select("doc", "position", F.lit(None).cast("string").alias("title"), F.lit(1).alias("side")).unionByName(boundaries.select("doc", "position", "title", F.lit(0).alias("side")))
    last = F.last("title", ignorenulls=True).over(Window.partitionBy("doc").orderBy("position", "side"))
    return both.withColumn("chapter", last).where("side = 1 and chapter is not null").select("doc", "position", "chapter")


def reliable_chapters(chunks: DataFrame) -> DataFrame:
    return asof_chapter(chunks, boundary_runs(chapter_candidates(chunks)))
