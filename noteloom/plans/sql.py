"""SQL twins of the column functions, for the oracles."""

from __future__ import annotations

from .. import config as C


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, put: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(put)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def blank_free(x: str) -> str:
    return f"trim({sub(x, C.BLANKS, ' ')})"


def casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def canonical(x: str) -> str:
    return blank_free(sub(f"translate({x}, {lit(C.FULL_WIDTH)}, {lit(C.HALF_WIDTH)})", C.DASHES, "-"))


def qkey(x: str) -> str:
    return casefold(sub(canonical(x), C.NON_WORD))


def tkey(x: str) -> str:
    return casefold(blank_free(sub(f"translate({x}, {lit(C.PUNCTUATION_FROM)}, {lit(C.PUNCTUATION_TO)})", C.TITLE_NUMBER)))


def ckey(x: str) -> str:
    return casefold(sub(sub(f"trim({x})", C.LEADING_NUMBER), C.NON_WORD))


def dkey(x: str) -> str:
    return f"lower({sub(sub(f'trim({x})', C.DISPLAY_NUMBER), '[^A-Za-z0-9_㐀-鿿]+')})"


def parts(x: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, {lit(pattern)}), lambda p_: trim(p_)), lambda p_: p_ <> '')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '\\r?\\n'), lambda v_: {blank_free('v_')}), lambda v_: v_ <> '')"


def core(x: str) -> str:
    return f"regexp_extract(trim({x}), '^([^:：]*)', 1)"


def tail(x: str) -> str:
    t = f"regexp_extract(trim({x}), '^[^:：]*[:：]((?s:.*))$', 1)"
    cl = parts(t, "[，,；;。]+")
    stop = f"coalesce(list_position(list_transform({cl}, lambda c_: {has('c_', '|'.join(C.EXAM_MARKERS))}), true), 0)"
    return f"coalesce(array_to_string(CASE WHEN {stop} = 0 THEN {cl} ELSE ({cl})[1:{stop} - 1] END, '、'), '')"


def matching(x: str) -> str:
    joined = f"trim(CASE WHEN {tail(x)} <> '' THEN {core(x)} || '：' || {tail(x)} ELSE {core(x)} END, ' ，,；;。：:')"
    return f"CASE WHEN {joined} <> '' THEN {joined} ELSE trim({x}) END"


def unique(xs: str, key) -> str:
    """First value of each non-empty key, in order."""
    return f"list_filter({xs}, lambda u_, i_: {key('u_')} <> '' AND list_position(list_transform({xs}, lambda w_: {key('w_')}), {key('u_')}) = i_)"


def unique_queries(xs: str) -> str:
    return unique(f"list_transform({xs}, lambda q_: {canonical('q_')})", qkey)


def readable(x: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(C.READABLE)}))"


def clean(x: str) -> str:
    c = blank_free(f"trim(trim({x}), {lit(C.OUTLINE_TRIM)})")
    return f"CASE WHEN {has(c, '^[^\\p{L}\\p{N}]*$')} THEN '' ELSE {c} END"


def noise(x: str) -> str:
    marked = " OR ".join(f"contains({casefold(x)}, {lit(m)})" for m in C.NOISE_MARKERS)
    return f"({marked} OR {readable(x)} < 2)"


def displayable(x: str) -> str:
    v = blank_free(f"coalesce({x}, '')")
    bad = " OR ".join(has(v, p) for p in (C.PAGE_RANGE, C.FILE_PAGES, C.TOC_TAIL, C.BARE_CHAPTER, C.ONLY_NUMBERING))
    return f"({v} <> '' AND {casefold(v)} NOT IN ({', '.join(map(lit, C.HIDDEN_TITLES))}) AND NOT starts_with({v}, '__') AND NOT ({bad}) AND {has(v, '[A-Za-z一-鿿]')})"


def grams(k: str) -> str:
    size = f"(CASE WHEN length({k}) >= 4 THEN 2 ELSE 1 END)"
    return f"list_distinct(list_transform(range(1, length({k}) - {size} + 2), lambda g_: substring({k}, g_, {size})))"


def terms(x: str) -> str:
    return f"list_distinct(regexp_extract_all({casefold(x)}, {lit(C.TERM)}))"
