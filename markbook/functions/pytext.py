"""String helpers with the whitespace, digit and word rules of Python text.

Java's regex classes are ASCII by default; the classes below cover the same characters as
Python's ``\\w``, ``\\d`` and ``str.strip``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"
LETTER_CHOICE = rf"(?<!{WORD})[A-E](?!{WORD})"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (keeps expression trees small)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column, chars: str = SPACE) -> Column:
    return F.btrim(c, F.lit(chars))


def strip_value(c: Column) -> Column:
    """``strip`` for a value at hand (a column, a bound value or a field of one), which is read up to four times.

    Most texts have nothing to strip, and one look at both ends is cheaper than a search of the long list of blanks.
    """
    blank = F.left(c, F.lit(1)).isin(list(SPACE)) | F.right(c, F.lit(1)).isin(list(SPACE))
    return F.when(blank, strip(c)).otherwise(c)


def rstrip(c: Column, chars: str = SPACE) -> Column:
    return F.rtrim(c, F.lit(chars))


def lstrip(c: Column, chars: str = SPACE) -> Column:
    return F.ltrim(c, F.lit(chars))


def replace(c: Column, old: str, new: str = "") -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def without(c: Column, mark: str) -> Column:
    """A value at hand without ``mark``, which most values do not hold."""
    return F.when(c.contains(mark), replace(c, mark)).otherwise(c)


def replace_all(c: Column, pairs) -> Column:
    """Plain text replacements, applied in the given order."""
    for old, new in pairs:
        c = replace(c, old, new)
    return c


def before(c: Column, mark: str) -> Column:
    """Text before the first ``mark``, or everything."""
    return F.substring_index(c, mark, 1)


def after_last(c: Column, mark: str) -> Column:
    """Text after the last ``mark``, or everything."""
    return F.substring_index(c, mark, -1)


def pieces(c: Column, mark: str, limit: int = -1) -> Column:
    """Split on plain text."""
    return F.split(c, re.escape(mark), limit)


def count_of(c: Column, mark: str) -> Column:
    """Number of non-overlapping occurrences of ``mark``."""
    return F.floor((F.length(c) - F.length(replace(c, mark))) / len(mark)).cast("int")


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def last_of(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def quoted(c: Column) -> Column:
    """Text in quotes as Python shows it: double quotes where it holds single ones only."""

    def run(t):
        plain = replace_all(t, [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])
        single = F.concat(F.lit("'"), replace(plain, "'", "\\'"), F.lit("'"))
        double = F.concat(F.lit('"'), plain, F.lit('"'))
        return F.when(t.contains("'") & ~t.contains('"'), double).otherwise(single)

    return let(c, run)


def first_of(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))
