"""Column functions and predicates over whole tables: one query for each, named after its place in the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import predicates as P
from ..functions import text as T
from ..sources import tables
from . import sql as S
from .registry import ORACLE_SQL, QUERIES

VIEW_KEYS = {"lines": ["doc_id", "line_no"], "topics": ["project", "idx"], "chunks": ["project", "position"], "items": ["job_id", "position"], "uploads": ["doc_id"], "material": ["point", "turn"]}


def bind() -> None:
    """Columns that the definitions below share; made when a query runs, as columns need a session."""
    global line, title, chapter, body, section, _fk
    line, title, chapter, body, section = F.col("line"), F.col("title"), F.col("chapter_title"), F.col("content"), F.coalesce(F.col("section_title"), F.lit(""))
    _fk = P.failure_kind(F.coalesce(F.col("failure_type"), F.lit("")), F.col("reason"))


def over(name: str, view: str, **columns: tuple[Callable[[], Column], str]) -> None:
    keys = VIEW_KEYS[view]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bind()
        return getattr(tables, view)(spark, sf_dir).select(*keys, *[c().alias(n) for n, (c, _) in columns.items()])

    QUERIES[name] = run
    ORACLE_SQL[name] = f"{tables.with_views(view)} SELECT {', '.join(keys)}, {', '.join(f'{s} AS {n}' for n, (_, s) in columns.items())} FROM {view}"


def digest(c: Column) -> Column:
    return F.md5(c)



over("h01_canonical_query", "topics", canonical=(lambda: T.canonical_query(title), S.canonical("title")))
over("h02_query_key", "lines", key=(lambda: T.query_key(line), S.qkey("line")))
over("h03_title_key", "topics", key=(lambda: T.title_key(title), S.tkey("title")), chapter_key=(lambda: T.title_key(F.col("chapter")), S.tkey("chapter")))
over("h04_compare_title", "topics", compared=(lambda: T.compare_title(title), S.ckey("title")), displayed=(lambda: T.display_title(title), S.dkey("title")))
over(
    "h05_prepare_query", "topics", core=(lambda: T.core_phrase(title), S.core("title")), tail=(lambda: T.knowledge_tail(title), S.tail("title")), matching=(lambda: T.matching_query(title), S.matching("title")),
    n_keywords=(lambda: F.size(T.expanded_keywords(title)), "CASE " + " ".join(f"WHEN {S.qkey(S.core('title'))} = {S.lit(k)} THEN {len(v)}" for k, v in C.KEYWORDS.items()) + " ELSE 0 END"),
)
over("h08_outline_line", "lines", cleaned=(lambda: T.clean_line(line), S.clean("line")), dedupe_key=(lambda: T.dedupe_key(line), S.casefold(S.sub("line", "[^\\p{L}\\p{N}]+"))), indent=(lambda: T.indent_width(line), "length(regexp_extract(line, '^([ \\t]*)', 1)) + 3 * (length(regexp_extract(line, '^([ \\t]*)', 1)) - length(replace(regexp_extract(line, '^([ \\t]*)', 1), chr(9), '')))"),
     depth=(lambda: T.number_depth(F.concat(F.lit("1.2 "), line)), f"CASE WHEN {S.has(chr(39) + '1.2 ' + chr(39) + ' || line', C.OUTLINE_NUMBER + '.+$')} THEN greatest(1, len(regexp_extract_all(regexp_extract('1.2 ' || line, {S.lit(C.OUTLINE_NUMBER)}), '\\d+'))) ELSE 0 END"))
over("h09_chapter_number", "topics", number=(lambda: T.chapter_number(F.col("chapter")), "regexp_extract(chapter, '^第\\s*(\\d+)\\s*章', 1)::INT"), chinese=(lambda: T.chapter_number(F.concat(F.lit("第"), F.element_at(F.array(*[F.lit(x) for x in ("三", "十", "十二", "二十", "二十一", "一百零五", "一百", "两")]), (F.col("idx") % 8 + 1).cast("int")), F.lit("章 a"))), "[3, 10, 12, 20, 21, 105, 100, NULL][idx % 8 + 1]"))
over("h10_gram_overlap", "topics", overlap=(lambda: F.round(T.gram_overlap(T.query_key(title), T.query_key(F.concat("chapter", F.coalesce("parent_title", F.lit(""))))), 6), f"coalesce(round(len(list_filter({S.grams(S.qkey('title'))}, lambda x_: contains({S.qkey(chr(39) * 2 + ' || chapter || coalesce(parent_title, ' + chr(39) * 2 + ')')}, x_))) / nullif(len({S.grams(S.qkey('title'))}), 0)::DOUBLE, 6), 0)"))
over("h14_term_overlap", "chunks", shared=(lambda: T.term_overlap(body, F.coalesce(chapter, F.lit(""))), f"len(list_intersect({S.terms('content')}, {S.terms('coalesce(chapter_title, ' + chr(39) * 2 + ')')}))"))
over("h15_body_characters", "chunks", characters=(lambda: T.body_characters(F.coalesce(chapter, F.lit("")), body), f"CASE WHEN len({S.lines('content')}) = 0 THEN 0 ELSE {S.readable('coalesce(array_to_string(list_filter(' + S.lines('content') + ', lambda z_: ' + S.tkey('z_') + ' <> ' + S.tkey('coalesce(chapter_title, ' + chr(39) * 2 + ')') + '), chr(32)), ' + chr(39) * 2 + ')')} END"))
over("h16_redact_secrets", "lines", redacted=(lambda: digest(T.redact(line)), f"md5({S.sub('line', C.SECRET, C.SECRET_MASK)})"))
over("h17_safe_filename", "topics", file=(lambda: T.safe_filename(F.concat(title, F.lit(" / "), "chapter"), F.lit("全部版本"), F.to_date(F.lit("2026-01-31"))), f"rtrim(left({S.sub('trim(' + S.sub(chr(39) * 2 + ' || title || ' + S.lit(' / ') + ' || chapter', C.UNSAFE_FILENAME, '-') + ', ' + S.lit(' .-') + ')', '\\s+', ' ')}, 80), ' .-') || '-全部版本-2026-01-31.docx'"))
over("h18_excerpt", "lines", context=(lambda: F.when(line.contains("the "), T.excerpt(line, F.lit("THE "))), "CASE WHEN contains(line, 'the ') THEN (CASE WHEN greatest(0, strpos(lower(line), 'the ') - 29) > 0 THEN '…' ELSE '' END) || substring(line, greatest(0, strpos(lower(line), 'the ') - 29) + 1, least(length(line), strpos(lower(line), 'the ') + 45) - greatest(0, strpos(lower(line), 'the ') - 29)) || (CASE WHEN least(length(line), strpos(lower(line), 'the ') + 45) < length(line) THEN '…' ELSE '' END) END"))
over("h19_split_content", "material", parts=(lambda: T.split_content(F.col("kind"), body), f"CASE WHEN len(CASE WHEN kind = 'keywords' THEN {S.parts('content', C.KEYWORD_SPLIT)} ELSE {S.parts('content', C.PARAGRAPHS)} END) > 0 THEN CASE WHEN kind = 'keywords' THEN {S.parts('content', C.KEYWORD_SPLIT)} ELSE {S.parts('content', C.PARAGRAPHS)} END ELSE [content] END"))
over("h20_normal_text", "lines", normal=(lambda: digest(T.normal_newlines(F.concat(F.lit("\r\n"), line, F.lit(" \r")))), "md5(trim(replace(replace(chr(13) || chr(10) || line || ' ' || chr(13), chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10) || chr(13)))"), error=(lambda: T.safe_error(line, 60), f"left({S.blank_free('line')}, 60)"))
over("h21_keyword_list", "material", keywords=(lambda: digest(T.keyword_list(body)), f"md5(coalesce(array_to_string({S.unique(S.parts('content', C.KEYWORD_ITEMS), S.ckey)}, '、'), ''))"), n=(lambda: T.keyword_count(body), f"len({S.parts('content', C.KEYWORD_SPLIT)})"))
over("h22_reduce_title", "topics", reduced=(lambda: T.reduce_title(F.concat(title, F.lit("：一二三四五六七八九十一二三四五六七八九十"))), f"CASE WHEN length(trim(title)) + 21 > 25 AND length(trim({S.core('title')})) BETWEEN 2 AND 25 THEN trim({S.core('title')}) ELSE trim(title || '：一二三四五六七八九十一二三四五六七八九十') END"),
     joined=(lambda: T.joined_title(F.coalesce("parent_title", title), title), f"CASE WHEN {S.tkey('coalesce(parent_title, title)')} = {S.tkey('title')} THEN coalesce(parent_title, title) WHEN length(coalesce(parent_title, title) || '·' || title) <= 25 THEN coalesce(parent_title, title) || '·' || title ELSE title END"))
over("h23_date_times", "uploads", day_before=(lambda: F.col("accepted_at") - F.expr("INTERVAL 24 HOURS"), "accepted_at - INTERVAL 24 HOUR"), lease_end=(lambda: F.col("accepted_at") + F.expr("INTERVAL 1200 SECONDS"), "accepted_at + INTERVAL 1200 SECOND"), day=(lambda: F.date_format("accepted_at", "yyyy-MM-dd"), "strftime(accepted_at, '%Y-%m-%d')"))
over("h24_math", "uploads", progress=(lambda: F.least(F.lit(95), 20 + F.floor(75 * F.col("processed_pages") / F.greatest(F.col("total_pages"), F.lit(1)))), "least(95, 20 + floor(75 * processed_pages / greatest(total_pages, 1)))"), share=(lambda: F.round(F.col("processed_pages") / F.col("total_pages"), 4), "round(processed_pages / total_pages, 4)"))
over("h25_chapter_label", "chunks", label=(lambda: T.chapter_label(F.col("position"), P.is_displayable_chapter(chapter)), f"CASE WHEN {S.displayable('chapter_title')} THEN CASE WHEN position + 1 < 100 THEN lpad((position + 1)::VARCHAR, 2, '0') ELSE left((position + 1)::VARCHAR, 2) END END"), path=(lambda: T.item_path(F.col("chunk_id"), F.lit("original"), F.col("position"), F.col("page_end")), "chunk_id || '-original-block-' || position || '-item-' || page_end"))

over("b01_route_page", "chunks", route=(lambda: P.page_route(F.col("position") % 2 == 0, body), "CASE WHEN position % 2 = 0 AND length(content) < 32 THEN 'ocr' ELSE 'text' END"), short_route=(lambda: P.page_route(F.col("position") % 2 == 0, F.left(body, (F.col("position") % 64).cast("int"))), "CASE WHEN position % 2 = 0 AND length(left(content, position % 64)) < 32 THEN 'ocr' ELSE 'text' END"))
over("b02_upload_rules", "uploads", violations=(lambda: P.upload_violations(F.col("name"), F.when(F.col("doc_id") % 9 == 0, "text/plain").otherwise("application/pdf"), F.col("processed_pages") * 20000000, F.col("total_pages"), most_pages=350), "list_filter([CASE WHEN NOT ends_with(lower(name), '.pdf') THEN 'suffix' END, CASE WHEN doc_id % 9 = 0 THEN 'mime' END, CASE WHEN processed_pages * 20000000 <= 0 THEN 'empty' END, CASE WHEN processed_pages * 20000000 > 157286400 THEN 'size' END, CASE WHEN total_pages > 350 THEN 'pages' END], lambda x: x IS NOT NULL)"))
over("b03_displayable_chapter", "lines", whole=(lambda: P.is_displayable_chapter(line), S.displayable("line")), shown=(lambda: P.is_displayable_chapter(F.left(line, F.lit(12))), S.displayable("left(line, 12)")), numbered=(lambda: P.is_displayable_chapter(F.concat(F.left(line, F.lit(8)), F.lit(" / "), "line_no")), S.displayable("left(line, 8) || ' / ' || line_no")))
_first3 = f"({S.lines('content')})[1:3]"
_chapter = "coalesce(chapter_title, '')"
over("b04_heading_confirmed", "chunks", confirmed=(lambda: P.heading_confirmed(F.coalesce(chapter, F.lit("")), body, F.col("page_start"), F.col("page_end")), f"page_end - page_start <= 2 AND len(list_filter({_first3}, lambda a_: {S.tkey('a_')} = {S.tkey(_chapter)})) > 0 AND {S.readable('coalesce(array_to_string(list_concat(list_filter(' + _first3 + ', lambda a_: ' + S.tkey('a_') + ' <> ' + S.tkey(_chapter) + '), (' + S.lines('content') + ')[4:]), chr(32)), ' + chr(39) * 2 + ')')} >= 20"))
over("b05_looks_like_toc", "chunks", toc=(lambda: P.looks_like_toc(F.concat_ws("\n", chapter, F.when(F.col("position") % 3 == 0, F.concat(F.lit("第9章 "), F.col("doc"))), body)), f"len(list_distinct(list_transform(list_filter({S.lines('concat_ws(chr(10), chapter_title, CASE WHEN position % 3 = 0 THEN ' + S.lit('第9章 ') + ' || doc END, content)')}, lambda t_: {S.has('t_', C.TOC_LINE)}), lambda t_: {S.tkey('t_')}))) >= 2"))
_b0 = S.qkey("content")
_b, _t = S.qkey("left(content, (position * 7 % 60)::INT)"), S.qkey("concat_ws(' ', chapter_title, section_title)")
over("b06_structural_short", "chunks", whole=(lambda: P.is_structural_short(body, F.coalesce(chapter, F.lit("")), section), f"length({_b0}) < 50 AND (({_t} <> '' AND (contains({_t}, {_b0}) OR contains({_b0}, {_t}))) OR contains({_b0}, '目录') OR length({S.sub(_b0, C.SHORT_NUMBERING)}) <= 16)"), short=(lambda: P.is_structural_short(F.left(body, (F.col("position") * 7 % 60).cast("int")), F.coalesce(chapter, F.lit("")), section), f"length({_b}) < 50 AND (({_t} <> '' AND (contains({_t}, {_b}) OR contains({_b}, {_t}))) OR contains({_b}, '目录') OR length({S.sub(_b, C.SHORT_NUMBERING)}) <= 16)"))
over("b07_noise", "lines", whole=(lambda: P.is_noise(line), S.noise("line")), noise=(lambda: P.is_noise(F.left(line, (F.col("line_no") % 5).cast("int"))), S.noise("left(line, (line_no % 5)::INT)")), link=(lambda: P.has_link_noise(line), S.has("line", C.LINK_NOISE)))
over("b08_recall_evidence", "chunks", found=(lambda: P.recall_evidence(T.query_key(F.coalesce(chapter, F.lit(""))), F.array(F.lit("the"), F.lit("tion"), F.lit("qqq")), T.query_key(body)), f"({S.qkey(_chapter)} <> '' AND contains({S.qkey('content')}, {S.qkey(_chapter)})) OR (contains({S.qkey('content')}, 'the')::INT + contains({S.qkey('content')}, 'tion')::INT + contains({S.qkey('content')}, 'qqq')::INT) >= 2"))
over("b09_strict_short", "topics", strict=(lambda: P.needs_strict_evidence(T.query_key(T.matching_query(title))), f"length({S.qkey(S.matching('title'))}) <= 4"))
over("b10_primary_gate", "uploads", passes=(lambda: P.passes_primary(F.col("processed_pages") / 13, F.col("total_pages") / 400), "processed_pages / 13 >= 0.35 AND (processed_pages / 13 >= 0.8 OR total_pages / 400 >= 0.6)"))
over("b12_heading_kind", "lines", kind=(lambda: P.heading_kind(F.concat(F.when(F.col("line_no") % 3 == 0, "第2章 ").when(F.col("line_no") % 3 == 1, "1.2 ").otherwise(""), line)), f"CASE WHEN {S.has('(CASE line_no % 3 WHEN 0 THEN ' + S.lit('第2章 ') + ' WHEN 1 THEN ' + S.lit('1.2 ') + ' ELSE ' + chr(39) * 2 + ' END) || line', C.CHAPTER_LINE)} THEN 'chapter' WHEN {S.has('(CASE line_no % 3 WHEN 0 THEN ' + S.lit('第2章 ') + ' WHEN 1 THEN ' + S.lit('1.2 ') + ' ELSE ' + chr(39) * 2 + ' END) || line', C.SECTION_LINE)} THEN 'section' END"))
_kind = "CASE WHEN failure_type = 'format_warning' THEN 'format_warning' WHEN failure_type = 'unmatched' OR contains(lower(coalesce(reason, '')), 'unmatched') THEN 'unmatched' WHEN failure_type = 'schema_validation' OR contains(lower(coalesce(reason, '')), 'schema') THEN 'schema_validation' ELSE 'generation_error' END"
over("b14_failure_kind", "items", kind=(lambda: _fk, _kind.replace("failure_type", "coalesce(failure_type, '')")), label=(lambda: P.failure_label(_fk), f"CASE {_kind} WHEN 'format_warning' THEN '内容已保留，建议检查' WHEN 'unmatched' THEN '资料依据不足' WHEN 'schema_validation' THEN '生成格式未通过检查' ELSE '生成未完成' END".replace("failure_type", "coalesce(failure_type, '')")),
     wording=(lambda: P.failure_reason(_fk, F.coalesce(F.col("reason"), F.lit(""))), f"CASE {_kind} WHEN 'format_warning' THEN CASE WHEN coalesce(reason, '') <> '' THEN reason ELSE '部分内容未完全符合标准格式，已保留可读结果，建议检查。' END WHEN 'unmatched' THEN '课程资料中没有找到达到相关性要求的内容。' WHEN 'schema_validation' THEN '生成内容在自动修复后仍未通过结构检查，后台未保存可安全使用的结果。' ELSE '生成服务未能完成这个考点。' END".replace("failure_type", "coalesce(failure_type, '')")))
over("b15_expired", "uploads", expired=(lambda: F.col("object_key").isNotNull() & (F.col("accepted_at") < F.to_timestamp(F.lit("2000-01-01")) - F.expr("INTERVAL 24 HOURS")), "object_key IS NOT NULL AND accepted_at < TIMESTAMP '2000-01-01' - INTERVAL 24 HOUR"))
over("b16_document_flags", "uploads", can_resume=(lambda: F.col("status").isin("failed", "interrupted") & F.col("object_key").isNotNull(), "status IN ('failed', 'interrupted') AND object_key IS NOT NULL"), is_resuming=(lambda: F.col("status").isin("queued", "processing") & (F.col("processed_pages") > 0), "status IN ('queued', 'processing') AND processed_pages > 0"))
over("b17_collection_title", "topics", outline=(lambda: P.is_collection_title(title), S.has("trim(title)", C.COLLECTION_OUTLINE)), record=(lambda: P.is_collection_title(title, C.COLLECTION_RECORD), S.has("trim(title)", C.COLLECTION_RECORD)), query=(lambda: title.rlike(C.COLLECTION_QUERY), S.has("title", C.COLLECTION_QUERY)))
over("b19_abandoned", "uploads", abandoned=(lambda: (F.col("status") == "interrupted") | ((F.col("status") == "processing") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < F.to_timestamp(F.lit("1998-01-01"))))), "status = 'interrupted' OR (status = 'processing' AND (lease_expires_at IS NULL OR lease_expires_at < TIMESTAMP '1998-01-01'))"))
over("b21_quota_releasable", "uploads", releasable=(lambda: (F.col("processed_pages") == 0) & (F.col("quota_pages") > 0) & F.col("quota_released_at").isNull(), "processed_pages = 0 AND quota_pages > 0 AND quota_released_at IS NULL"))
