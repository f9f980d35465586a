"""The query key of a single string, as text.query_key gives it for columns."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_NON_WORD = re.compile(r"[^\w]+")


@lru_cache(maxsize=1 << 16)
def key_of(value: str) -> str:
    # dashes and blanks go with all else that isn't of words
    return _NON_WORD.sub("", unicodedata.normalize("NFKC", value)).casefold()


def folded(value: str) -> str:
    """text.casefold of a single string."""
    return value.lower().replace("ß", "ss")
