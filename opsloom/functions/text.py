"""Small column helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


# fixed values: every character that counts as white space
_WHITE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
          "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column) -> Column:
    """Drop all white space at both ends (plain ``trim`` only drops blanks)."""
    return F.trim(col, F.lit(_WHITE))


def any_of(text: Column, words: Iterable[str]) -> Column:
    """True when the text holds at least one of the words."""
    return reduce(or_, (text.contains(w) for w in words))


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def first_match(text: Column, choices: Iterable[tuple[str, str]]) -> Column:
    """Value of the first word found in the text, in the given order."""
    return F.coalesce(*[F.when(text.contains(word), F.lit(value)) for word, value in choices])


def words_found(text: Column, words: Iterable[str], prefix: str = "") -> Column:
    """Array of the words that the text holds, in list order."""
    return F.array_compact(F.array(*[F.when(text.contains(w), F.lit(prefix + w)) for w in words]))


def distinct_sorted(*arrays: Column) -> Column:
    """Distinct values of several arrays in a stable order."""
    joined = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    return F.sort_array(F.array_distinct(joined))


def first_group(text: Column, pattern: str, group: int = 1, guard: Column | None = None) -> Column:
    """Group of the first match, null when there is none.

    ``guard`` is a cheap test that must hold for any match; it keeps the regex
    off the rows that cannot match.
    """
    found = F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return found if guard is None else F.when(guard, found)


def clip(text: Column, size: int, ellipsis: str = "...") -> Column:
    """Text cut to ``size`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(ellipsis))).otherwise(text)


def text_key(text: Column) -> Column:
    return F.md5(text)


def normalize_service(text: Column) -> Column:
    """``Service B1``, ``service_b1`` and the like become ``service-b1``."""
    return F.regexp_replace(F.lower(text), r"service[\s_-]*([a-z]\d*)", "service-$1")
