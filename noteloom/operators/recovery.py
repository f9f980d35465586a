"""Texts of the three versions out of generated output that isn't JSON.

Only what stands behind an explicit ``content`` key inside a version counts: keys may be bare or in either kind of quotes,
values quoted either way, lists of quoted strings or bare words, and the last may end with the output.  A version reaches
to the next version's key.  Readable values are paired by their order, since what belonged together is no longer known;
citations aren't recovered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..functions import predicates as P
from ..functions import text as T

KINDS = ("original", "recitation", "keywords")
#: Keys as they may be written; a version's is found inside other text too.
_VERSION = re.compile(r"""(?i)(?:["'](original|recitation|keywords)["']|(original|recitation|keywords))\s*:\s*""")
_KEY = re.compile(r"""(?:["']([^"']+)["']|([A-Za-z_][A-Za-z0-9_]*))\s*:\s*""")
_VALUE = re.compile(r"""(?s)"((?:[^"\\]|\\.)*)|'((?:[^'\\]|\\.)*)|\[([^\]]*)|([^,}\r\n]*)""")
_ITEM = re.compile(r"""(?s)(["'])(.*?)(?<!\\)\1""")
_ESCAPE = re.compile(r"""\\(["'nrt\\])""")
_MEANT = {"n": "\n", "r": "\n", "t": " "}


def unescaped(value: str) -> str:
    """As JSON if it is a JSON string's inside, else with the usual escapes."""
    try:
        return json.loads(f'"{value}"')
    except ValueError:
        return _ESCAPE.sub(lambda m: _MEANT.get(m[1], m[1]), value)


def value_at(text: str, at: int) -> str:
    double, single, items, bare = _VALUE.match(text, at).groups()
    if items is not None:
        return "、".join(v for m in _ITEM.finditer(items) if (v := unescaped(m[2]).strip()))
    return bare.strip() if bare is not None else unescaped(double if double is not None else single)


def scanned(raw: str | None) -> Iterator[tuple[str, str]]:
    """(version, first value of a content key in its part) for every version that has one."""
    found = list(_VERSION.finditer(raw or ""))
    ends = [m.start() for m in found[1:]] + [len(raw or "")]
    for m, end in zip(found, ends, strict=False):
        part = raw[m.end() : end]
        values = (value_at(part, k.end()) for k in _KEY.finditer(part) if (k[1] or k[2]).lower() == "content")
        value = next((v for v in values if v), None)
        if value is not None:
            yield (m[1] or m[2]).lower(), value


def scan(raw: Column) -> Column:
    """What ``scanned`` finds, as a column.  Taken as not deterministic, so that a filter on what is made of it doesn't scan again."""

    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "value": v} for k, v in scanned(t)] for t in texts], dtype=object)

    return of.asNondeterministic()(raw)


def plain_text(x: Column) -> Column:
    """Without blanks at both ends, runs of blanks and tabs as one blank; most texts have none of these."""
    return T.let(T.stripped(x), lambda v: F.when(v.contains("  ") | v.contains("\t"), F.regexp_replace(v, "[ \t]+", " ")).otherwise(v))


def keyword_text(x: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(T.stripped(x), C.KEYWORD_ITEMS, -1), T.stripped), lambda p: p != ""), "、")


def recovered_texts(found: Column) -> Column:
    """Array of (original, recitation, keywords), empty texts where one is missing, of what ``scan`` found; null without readable ones."""
    text = F.transform(found, lambda f: F.struct(f["kind"].alias("kind"), F.when(f["kind"] == "keywords", keyword_text(f["value"])).otherwise(plain_text(f["value"])).alias("value")))

    def paired(readable: Column) -> Column:
        each = [F.transform(F.filter(readable, lambda f: f["kind"] == k), lambda f: f["value"]).alias(k) for k in KINDS]  # noqa: B023
        return F.transform(F.arrays_zip(*each), lambda z: F.struct(*[F.coalesce(z[k], F.lit("")).alias(k) for k in KINDS]))

    return T.let(T.let(F.filter(text, lambda f: ~P.is_noise(f["value"])), paired), lambda filled: F.when(F.size(filled) > 0, filled))
