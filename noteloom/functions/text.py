"""Text, title, query and date functions on columns; all JVM-side.  Null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def blank_free(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, C.BLANKS, " "))


def stripped(x: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.btrim(x, F.lit(C.BLANK_CHARACTERS))


def unspaced(x: Column) -> Column:
    """Without spaces of any width at both ends; tabs and line ends stay."""
    return F.btrim(x, F.lit(C.SPACE_CHARACTERS))


_ASCII = "\\A[\\x00-\\x7F]*\\z"


def _by_class(x: Column, owner: str, method: str, plain) -> Column:
    """A static method of a class that Spark brings, with a true flag; ASCII texts take the plain way.

    Spark takes such calls as not deterministic, so they stand in projections, not inside aggregates.
    """
    return let(x, lambda v: F.when(v.rlike(_ASCII), plain(v)).when(v.isNotNull(), F.reflect(F.lit(owner), F.lit(method), F.coalesce(v, F.lit("")), F.lit(True))))


def nfkc(x: Column) -> Column:
    """Compatibility composition."""
    return _by_class(x, "com.ibm.icu.text.Normalizer", "compose", lambda v: v)


def fully_folded(x: Column) -> Column:
    """Full case folding."""
    return _by_class(x, "com.ibm.icu.lang.UCharacter", "foldCase", F.lower)


def casefold(x: Column) -> Column:
    """Lower case, and ß as ss: what titles and terms need."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def canonical_query(x: Column) -> Column:
    """Compatibility forms unified, dash family to one hyphen, blanks collapsed."""
    return blank_free(F.regexp_replace(nfkc(x), C.DASHES, "-"))


def query_key(x: Column) -> Column:
    """Identity of queries; keys.key_of is the same for single strings.  Blanks and dashes go with all else that isn't of words, so the text isn't made canonical first."""
    return fully_folded(F.regexp_replace(nfkc(x), C.NON_WORD, ""))


def title_key(x: Column) -> Column:
    """Exact title identity: punctuation unified, one leading number dropped."""
    plain = F.translate(x, C.PUNCTUATION_FROM, C.PUNCTUATION_TO)
    return casefold(blank_free(F.regexp_replace(plain, C.TITLE_NUMBER, "")))


def compare_title(x: Column) -> Column:
    return casefold(F.regexp_replace(F.regexp_replace(F.btrim(x), C.LEADING_NUMBER, ""), C.NON_WORD, ""))


def display_title(x: Column) -> Column:
    """As shown by readers: repeated leading numbers dropped, letters outside ASCII and CJK too."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.btrim(x), C.DISPLAY_NUMBER, ""), "[^A-Za-z0-9_\u3400-\u9fff]+", ""))


def same_title(a: Column, b: Column) -> Column:
    return (display_title(a) != "") & (display_title(a) == display_title(b))


def trimmed_parts(x: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(x, pattern, -1), lambda p: F.btrim(p)), lambda p: p != "")


def core_phrase(x: Column) -> Column:
    return F.regexp_extract(F.btrim(x), "^([^:：]*)", 1)


def knowledge_tail(x: Column) -> Column:
    """Clauses after the first colon up to one with an exam instruction, joined by 、."""
    tail = F.regexp_extract(F.btrim(x), "^[^:：]*[:：]((?s:.*))$", 1)

    def kept(clauses: Column) -> Column:
        stop = F.array_position(F.transform(clauses, lambda c: c.rlike("|".join(C.EXAM_MARKERS))), True)
        return let(stop, lambda n: F.when(n == 0, clauses).otherwise(F.slice(clauses, 1, F.greatest(n - 1, F.lit(0)).cast("int"))))

    return F.array_join(let(trimmed_parts(tail, "[，,；;。]+"), kept), "、")


def matching_query(x: Column) -> Column:
    joined = let(knowledge_tail(x), lambda tail: F.btrim(F.when(tail != "", F.concat(core_phrase(x), F.lit("："), tail)).otherwise(core_phrase(x)), F.lit(" ，,；;。：:")))
    return let(joined, lambda j: F.when(j != "", j).otherwise(F.btrim(x)))


def prepared_core(x: Column) -> Column:
    core = F.btrim(core_phrase(x))
    return F.when(core != "", core).otherwise(matching_query(x))


def expanded_keywords(x: Column, vocabulary: dict[str, tuple[str, ...]] | None = None) -> Column:
    def listed(key: Column) -> Column:
        out = F.array().cast("array<string>")
        for core, words in (vocabulary or C.KEYWORDS).items():
            out = F.when(key == core, F.array(*[F.lit(w) for w in words])).otherwise(out)
        return out

    return let(query_key(core_phrase(x)), listed)


def unique_by(values: Column, key) -> Column:
    """First value of each non-empty key, in order."""
    pairs = F.transform(values, lambda v: F.struct(key(v).alias("k"), v.alias("v")))

    def step(state: Column, p: Column) -> Column:
        known = F.exists(state, lambda s: s["k"] == p["k"])
        return F.when((p["k"] == "") | known, state).otherwise(F.concat(state, F.array(p)))

    return F.transform(F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), step), lambda s: s["v"])


def unique_queries(values: Column) -> Column:
    return unique_by(F.transform(values, canonical_query), query_key)


def restore_suffix(parts: Column) -> Column:
    """ "a性、b性c" to "a性c", "b性c" where all parts but the last are short and end with one boundary character."""

    def restored(p: Column) -> Column:
        last = F.element_at(p, -1)
        short = F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))
        boundary = F.right(F.element_at(p, 1), F.lit(1))
        at = F.position(boundary, last)
        suffix = F.substr(last, at + 1, F.length(last))
        fits = (
            (F.length(last) >= 4) & F.lit(C.SHARED_SUFFIXES).contains(boundary) & (boundary != "")
            & F.forall(short, lambda s: (F.length(s) <= 6) & s.endswith(boundary)) & (at >= 2) & (F.length(query_key(suffix)) >= 2)
        )
        return F.when(fits, F.concat(F.transform(short, lambda s: F.concat(s, suffix)), F.array(last))).otherwise(p)

    return let(parts, lambda p: F.when(F.size(p) >= 2, restored(p)).otherwise(p))


def split_subqueries(x: Column) -> Column:
    marks = F.lit(" .。:：()（）")
    body = F.btrim(F.regexp_replace(x, C.COMPARISON, ""))
    cleaned = F.transform(F.split(body, C.CONNECTORS, -1), lambda p: F.btrim(F.regexp_replace(F.btrim(p, marks), C.INSTRUCTION, ""), marks))
    parts = restore_suffix(F.filter(cleaned, lambda p: F.length(query_key(p)) >= 2))
    return let(parts, lambda p: F.when(F.size(p) >= 2, unique_queries(p)).otherwise(F.array().cast("array<string>")))


def clean_line(x: Column) -> Column:
    """Outline line without list marks; empty if nothing but marks is left."""
    out = blank_free(F.btrim(F.btrim(x), F.lit(C.OUTLINE_TRIM)))
    return F.when(out.rlike("^[^\\p{L}\\p{N}]*$"), "").otherwise(out)


def dedupe_key(x: Column) -> Column:
    return casefold(F.regexp_replace(x, "[^\\p{L}\\p{N}]+", ""))


def indent_width(x: Column) -> Column:
    lead = F.regexp_extract(x, "^([ \\t]*)", 1)
    return F.length(lead) + 3 * (F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit(""))))


def number_depth(x: Column) -> Column:
    token = F.regexp_extract(x, C.OUTLINE_NUMBER, 0)
    return F.when(x.rlike(C.OUTLINE_NUMBER + ".+$"), F.greatest(F.lit(1), F.regexp_count(token, F.lit("\\d+")))).otherwise(0)


def outline_title(x: Column) -> Column:
    return F.when(x.rlike(C.OUTLINE_NUMBER + ".+$"), clean_line(F.regexp_replace(x, C.OUTLINE_NUMBER, ""))).otherwise(x)


def chapter_number(x: Column) -> Column:
    """Number of a chapter title in Arabic or Chinese numerals; null without one."""
    n = F.regexp_extract(x, C.NUMBERED_CHAPTER, 1)
    digits = F.translate(n, "零〇一二三四五六七八九", "00123456789")

    def below_hundred(d: Column) -> Column:
        tens, ones = F.substring_index(d, "十", 1), F.substring_index(d, "十", -1)
        digit = lambda v, empty: F.when(v.rlike("^\\d$"), v.cast("int")).otherwise(empty)
        return F.when(d == "", 0).when(d.contains("十"), digit(tens, 1) * 10 + digit(ones, 0)).when(d.rlike("^\\d+$"), d.cast("int"))

    hundreds, rest = F.substring_index(digits, "百", 1), F.regexp_replace(digits, "^[^百]*百", "")
    base = F.when(hundreds.rlike("^\\d$"), hundreds.cast("int")).otherwise(1) * 100
    return F.when(n == "", None).when(digits.contains("百"), base + below_hundred(rest)).otherwise(below_hundred(digits))


def grams(key: Column) -> Column:
    """Distinct 2-grams, 1-grams of keys under four characters."""
    size = F.when(F.length(key) >= 4, 2).otherwise(1)
    spots = F.when(F.length(key) >= size, F.sequence(F.lit(1), F.length(key) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substr(key, i, size)))


def gram_overlap(key: Column, text_key: Column) -> Column:
    share = lambda g, t: F.when(F.size(g) > 0, F.size(F.filter(g, lambda x: t.contains(x))) / F.size(g)).otherwise(0.0)
    return let(text_key, lambda t: let(grams(key), lambda g: share(g, t)))


def terms(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(casefold(x), F.lit(C.TERM), F.lit(0)))


def term_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(terms(a), terms(b)))


def readable_characters(x: Column) -> Column:
    return F.regexp_count(x, F.lit(C.READABLE))


def text_lines(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "\\r?\\n", -1), blank_free), lambda v: v != "")


def body_characters(title: Column, text: Column) -> Column:
    body = let(title_key(title), lambda key: F.filter(text_lines(text), lambda v: title_key(v) != key))
    return readable_characters(F.array_join(body, " "))


def redact(x: Column) -> Column:
    return F.regexp_replace(x, C.SECRET, C.SECRET_MASK.replace("$", "\\$"))


def safe_filename(name: Column, label: Column, day: Column, default: str = "学习材料") -> Column:
    edge = F.lit(" .-")
    cleaned = F.btrim(F.regexp_replace(name, C.UNSAFE_FILENAME, "-"), edge)
    short = F.rtrim(F.left(F.regexp_replace(F.when(cleaned != "", cleaned).otherwise(default), "\\s+", " "), F.lit(80)), edge)
    return F.concat(short, F.lit("-"), label, F.lit("-"), F.date_format(day, "yyyy-MM-dd"), F.lit(".docx"))


def excerpt(text: Column, query: Column, before: int = 28, after: int = 42) -> Column:
    at = F.position(F.lower(query), F.lower(text))
    start = F.greatest(F.lit(0), at - 1 - before)
    end = F.least(F.length(text), at - 1 + F.length(query) + after)
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substr(text, start + 1, end - start), F.when(end < F.length(text), "…").otherwise(""))


def split_content(kind: Column, text: Column) -> Column:
    parts = F.when(kind == "keywords", trimmed_parts(text, C.KEYWORD_SPLIT)).otherwise(trimmed_parts(text, C.PARAGRAPHS))
    return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))


def normal_newlines(x: Column) -> Column:
    return F.btrim(F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(" \t\n\r"))


def safe_error(x: Column, most: int = 1000) -> Column:
    return F.left(blank_free(x), F.lit(most))


def keyword_list(x: Column) -> Column:
    return F.array_join(unique_by(trimmed_parts(x, C.KEYWORD_ITEMS), compare_title), "、")


def keyword_count(x: Column) -> Column:
    return F.size(trimmed_parts(x, C.KEYWORD_SPLIT))


def reduce_title(x: Column, most: int = 25) -> Column:
    t = F.btrim(x)
    subject = F.btrim(F.regexp_extract(t, "^([^:：]*)", 1))
    return F.when((F.length(t) > most) & F.length(subject).between(2, most), subject).otherwise(t)


def joined_title(parent: Column, child: Column, most: int = 25) -> Column:
    both = F.concat(parent, F.lit("·"), child)
    return F.when(title_key(parent) == title_key(child), parent).when(F.length(both) <= most, both).otherwise(child)


def chapter_label(position: Column, resolved: Column) -> Column:
    return F.when(resolved, F.lpad((position + 1).cast("string"), 2, "0"))


def item_path(bullet: Column, version: Column, block: Column, item: Column) -> Column:
    return F.concat_ws("-", bullet, version, F.lit("block"), block.cast("string"), F.lit("item"), item.cast("string"))


def merge_content(kind: Column, a: Column, b: Column) -> Column:
    """Ordered union of pieces without regard to case."""
    words = F.transform(F.split(F.concat_ws("、", a, b), C.KEYWORD_SPLIT, -1), blank_free)
    parts = F.transform(F.split(F.concat_ws("\n\n", a, b), C.PARAGRAPHS, -1), blank_free)
    return F.when(kind == "keywords", F.array_join(unique_by(words, casefold), "、")).otherwise(F.array_join(unique_by(parts, casefold), "\n\n"))
