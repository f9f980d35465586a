"""Predicates and classifications on columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import blank_free, casefold, compare_title, let, query_key, readable_characters, text_lines, title_key


def page_route(has_raster: Column, text: Column, least: int = 32) -> Column:
    return F.when(has_raster & (F.length(text) < max(least, C.CONFIG.ocr_least)), "ocr").otherwise("text")


def upload_violations(name: Column, mime: Column, size: Column, pages: Column, most_bytes: int = 150 << 20, most_pages: int = 600) -> Column:
    rules = [("suffix", ~F.lower(name).endswith(".pdf")), ("mime", mime != "application/pdf"), ("empty", size <= 0), ("size", size > most_bytes), ("pages", pages > most_pages)]
    return F.array_compact(F.array(*[F.when(c, code) for code, c in rules]))


def is_displayable_chapter(title: Column) -> Column:
    def of(v: Column) -> Column:
        hidden = v.startswith("__") | casefold(v).isin(*C.HIDDEN_TITLES)
        reference = v.rlike(C.PAGE_RANGE) | v.rlike(C.FILE_PAGES) | v.rlike(C.TOC_TAIL)
        return (v != "") & ~hidden & ~reference & ~v.rlike(C.BARE_CHAPTER) & ~v.rlike(C.ONLY_NUMBERING) & v.rlike("[A-Za-z\u4e00-\u9fff]")

    return let(blank_free(F.coalesce(title, F.lit(""))), of)


def heading_confirmed(title: Column, text: Column, page_start: Column, page_end: Column) -> Column:
    """The title is one of the first three lines and at least 20 readable characters follow."""

    def of(lines: Column, key: Column) -> Column:
        first = F.slice(lines, 1, 3)
        others = F.concat(F.filter(first, lambda v: title_key(v) != key), F.when(F.size(lines) > 3, F.slice(lines, 4, F.size(lines))).otherwise(F.array().cast("array<string>")))
        return F.exists(first, lambda v: title_key(v) == key) & (readable_characters(F.array_join(others, " ")) >= 20)

    return (page_end - page_start <= 2) & let(text_lines(text), lambda lines: let(title_key(title), lambda key: of(lines, key)))


def looks_like_toc(text: Column, chapter_line: str = C.TOC_LINE) -> Column:
    return F.size(F.array_distinct(F.transform(F.filter(text_lines(text), lambda v: v.rlike(chapter_line)), title_key))) >= 2


def is_structural_short(content: Column, chapter: Column, section: Column) -> Column:
    titles = query_key(F.concat_ws(" ", F.when(chapter != "", chapter), F.when(section != "", section)))

    def of(body: Column) -> Column:
        title_like = let(titles, lambda t: (t != "") & (t.contains(body) | body.contains(t)))
        return (F.length(body) < 50) & (title_like | body.contains("目录") | (F.length(F.regexp_replace(body, C.SHORT_NUMBERING, "")) <= 16))

    return let(query_key(content), of)


def is_noise(x: Column) -> Column:
    """A marker of copied material, or fewer than two readable characters; both found at the first place that tells."""
    marked = let(casefold(x), lambda v: reduce(or_, [v.contains(m) for m in C.NOISE_MARKERS]))
    two = f"(?s){C.READABLE}.*?{C.READABLE}"
    # a short beginning tells it of most texts
    return marked | ~(F.left(x, F.lit(64)).rlike(two) | x.rlike(two))


def has_link_noise(x: Column) -> Column:
    return x.rlike(C.LINK_NOISE)


def recall_evidence(core: Column, keywords: Column, searchable: Column) -> Column:
    """core and searchable are query keys; keywords plain."""
    keys = F.transform(F.array_distinct(keywords), query_key)

    def of(text: Column) -> Column:
        return let(core, lambda c: (c != "") & text.contains(c)) | (F.size(F.filter(keys, lambda k: text.contains(k))) >= 2)

    return let(searchable, of)


def needs_strict_evidence(matching_key: Column) -> Column:
    return F.length(matching_key) <= 4


def passes_primary(score: Column, overlap: Column, threshold: float = C.CONFIG.threshold) -> Column:
    return (score >= threshold) & ((score >= 0.8) | (overlap >= 0.6))


def item_type(title: Column, children: Column, subqueries: Column) -> Column:
    return (
        F.when(title.rlike(C.TASK), "TASK").when((F.size(children) > 0) | title.rlike(C.COLLECTION_QUERY), "COLLECTION")
        .when(F.size(subqueries) >= 2, "COMPOSITE").otherwise("KNOWLEDGE")
    )


def heading_kind(line: Column, chapter_line: str = C.CHAPTER_LINE, section_line: str = C.SECTION_LINE) -> Column:
    return F.when(line.rlike(chapter_line), "chapter").when(line.rlike(section_line), "section")


#: Line patterns as SQL reads them: only a line feed ends a line, and a vertical tab is no blank.
ORDERED_LINE, UNORDERED_LINE = (p.replace("\\s", "[\\t\\n\\f\\r ]").replace(".+", "[^\\n]+").replace("$", "\\z") for p in (C.ORDERED_LINE, C.UNORDERED_LINE))


def line_kind(line: Column, ordered: str = ORDERED_LINE, unordered: str = UNORDERED_LINE) -> Column:
    return F.when(line.rlike(ordered), "ordered").when(line.rlike(unordered), "unordered").otherwise("paragraph")


def line_item(line: Column, ordered: str = C.ORDERED_LINE, unordered: str = C.UNORDERED_LINE) -> Column:
    return F.when(line.rlike(ordered), F.regexp_extract(line, ordered, 1)).when(line.rlike(unordered), F.regexp_extract(line, unordered, 1)).otherwise(line)


def failure_kind(kind: Column, reason: Column) -> Column:
    low = F.lower(F.coalesce(reason, F.lit("")))
    return (
        F.when(kind == "format_warning", "format_warning").when((kind == "unmatched") | low.contains("unmatched"), "unmatched")
        .when((kind == "schema_validation") | low.contains("schema"), "schema_validation").otherwise("generation_error")
    )


def failure_label(kind: Column) -> Column:
    return F.when(kind == "format_warning", "内容已保留，建议检查").when(kind == "unmatched", "资料依据不足").when(kind == "schema_validation", "生成格式未通过检查").otherwise("生成未完成")


def failure_reason(kind: Column, reason: Column) -> Column:
    """Plain wording of a failure."""
    low = F.lower(reason)
    detail = F.btrim(F.regexp_extract(reason, "(?i)three-version item schema:\\s*(.+)$", 1))
    title = F.regexp_extract(reason, "(?i)bullet_points\\.(\\d+)\\.(?:title|(?:original|recitation|keywords)\\.title):[^;]*(?:at most 25|not exceed 25)", 1)
    return (
        F.when(kind == "format_warning", F.when(reason != "", reason).otherwise("部分内容未完全符合标准格式，已保留可读结果，建议检查。"))
        .when(kind == "unmatched", "课程资料中没有找到达到相关性要求的内容。")
        .when(low.contains("keywords content must contain between 3 and 8"), "生成的关键词数量不符合 3–8 个的格式要求。")
        .when(low.contains("at most 800 characters"), "生成的原文内容超过 800 字的长度限制。")
        .when(title != "", F.concat(F.lit("第 "), (title.cast("int") + 1).cast("string"), F.lit(" 个小标题超过旧的 25 字排版建议；修复后不会再因此丢弃有效内容。")))
        .when(low.contains("no readable content after salvage") | low.contains("no readable learning content"), "AI 两次返回的结构均损坏，且未能提取到可读正文。")
        .when((kind == "schema_validation") & (detail != ""), F.concat(F.lit("生成内容在自动修复后仍未通过结构检查："), detail))
        .when(kind == "schema_validation", "生成内容在自动修复后仍未通过结构检查，后台未保存可安全使用的结果。")
        .otherwise("生成服务未能完成这个考点。")
    )


def is_collection_title(title: Column, pattern: str = C.COLLECTION_OUTLINE) -> Column:
    return F.btrim(title).rlike(pattern)


def shown_inner_title(inner: Column, point: Column) -> Column:
    """The bullet's title unless it is empty or the point's own."""
    return F.when((compare_title(inner) != "") & (compare_title(inner) != compare_title(point)), inner)
