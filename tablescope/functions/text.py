"""Text normalisation as native column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tablescope import fixed_values as fv

# White space other than the plain blank, as Python's str.isspace sees it.
OTHER_SPACES = (
    r"\t-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Characters NFKC leaves alone in any combination with each other, apart from
# the order of vowel signs, which normalize_text deletes anyway. A row made of
# these only never needs Python. tests/test_text.py checks every one of them.
NFKC_STABLE = (
    r"\x00-\x7f\u00c0-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e"
    r"\u0400-\u0481\u060c\u061b\u061f\u0621-\u063f\u0641-\u0652\u0660-\u0674"
    r"\u0679-\u06bf\u06c1\u06c3-\u06d2\u06d4\u06f0-\u06ff"
    r"\u200c-\u200f\u2010\u2012-\u2016\u2018-\u2023\u20ac\ufeff"
    r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5"
)

_FROM = fv.LETTERS_FROM + fv.PERSIAN_DIGITS + fv.ARABIC_DIGITS + fv.INVISIBLE_MARKS + fv.DIACRITICS
_TO = fv.LETTERS_TO + fv.ASCII_DIGITS + fv.ASCII_DIGITS


def _nfkc(col: Column) -> Column:
    # Nested, so that it is shipped by value and executors need not have this package.
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")

    return F.pandas_udf(nfkc, StringType())(col)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    Keeps long regular-expression chains from being written out again at every
    use, which would make the generated code too large to compile. A fold over
    nothing hands its first value to ``body`` without an array made for each row.
    """
    return F.aggregate(F.array(), value, lambda kept, _: kept, body)


def is_ascii(col: Column) -> Column:
    """True for pure ASCII text: as many bytes as characters."""
    return F.octet_length(col) == F.char_length(col)


def to_ascii_digits(col: Column) -> Column:
    """Persian and Arabic-Indic digits as ASCII digits."""
    return let(col, lambda text: F.when(is_ascii(text), text).otherwise(
        F.translate(text, fv.PERSIAN_DIGITS + fv.ARABIC_DIGITS, fv.ASCII_DIGITS * 2)))


def needs_nfkc(col: Column) -> Column:
    """True where Unicode compatibility forms may occur, so NFKC has to look."""
    return ~is_ascii(col) & col.rlike(f"[^{NFKC_STABLE}]")


def _collapse_spaces(text: Column) -> Column:
    """Each run of white space as one blank, none around.

    The cheap tests decide whether the regular expression has to run at all.
    """
    other = F.when(is_ascii(text), text.rlike(r"[\t-\r\x1c-\x1f]")).otherwise(text.rlike(f"[{OTHER_SPACES}]"))
    uneven = text.contains("  ") | other
    return F.trim(F.when(uneven, F.regexp_replace(text, f"[ {OTHER_SPACES}]+", " ")).otherwise(text))


def compatible_forms(col: Column) -> Column:
    """NFKC by an Arrow function that only sees the rows which need it."""
    return F.coalesce(_nfkc(F.when(needs_nfkc(col), col)), col)


def normalize_text(col: Column, unicode_forms: bool = True) -> Column:
    """Spell equivalent labels alike.

    Unifies letter variants, deletes vowel signs and invisible marks, turns
    digits into ASCII and collapses white space. With ``unicode_forms`` the rows
    that may hold compatibility forms are put into NFKC by an Arrow function;
    all other rows travel to it as NULL and stay on the JVM side.
    """
    if unicode_forms:
        col = compatible_forms(col)
    plain = let(col, lambda text: F.when(is_ascii(text), text).otherwise(F.translate(text, _FROM, _TO)))
    return let(plain, _collapse_spaces)


def empty_to_null(col: Column) -> Column:
    return let(col, lambda text: F.when(text != "", text))


def contains_any(col: Column, words) -> Column:
    """Literal, case-insensitive test for any of ``words``."""
    return F.lower(col).rlike("|".join(re.escape(word) for word in words))


# --- column names: schema metadata, so plain driver functions -----------------

_NAME_TABLE = str.maketrans(_FROM[:len(_TO)], _TO, _FROM[len(_TO):])


def normalize_column_name(name: str) -> str:
    text = unicodedata.normalize("NFKC", str(name)).translate(_NAME_TABLE)
    return " ".join(text.split())


def slugify_column_name(name: str) -> str:
    """Lower-case, underscore separated form in which names are matched."""
    return re.sub("[^0-9a-z\u0600-\u06ff]+", "_", normalize_column_name(name).lower()).strip("_")


def has_hint(name: str, hints) -> bool:
    slug = slugify_column_name(name)
    return any(hint in slug for hint in hints)
