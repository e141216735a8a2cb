"""Dirty-text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "missing" in the case-study text columns.
MISSING_TOKENS = ("null", "")

LEADING_NUMBER = r"^\s*(-?[0-9]+(\.[0-9]+)?)"
LIST_SEPARATOR = r",\s*"


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def null_if_token(c, tokens=MISSING_TOKENS) -> Column:
    """NULL when the value is one of ``tokens`` (or already NULL)."""
    c = _c(c)
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def leading_number(c, to_type: str = "decimal(10,2)") -> Column:
    """The number a text starts with ('23.4 km' -> 23.4, '25mins' -> 25); NULL if none."""
    digits = F.regexp_extract(_c(c), LEADING_NUMBER, 1)
    return F.when(digits == "", F.lit(None)).otherwise(digits).try_cast(to_type)


def split_list(c, sep: str = LIST_SEPARATOR, tokens=MISSING_TOKENS) -> Column:
    """Delimited text -> array<string>; missing spellings give NULL."""
    clean = null_if_token(c, tokens)
    return F.when(clean.isNull(), F.lit(None)).otherwise(F.split(F.trim(clean), sep))


def split_typed_list(c, sep: str = LIST_SEPARATOR, member_type: str = "int", tokens=MISSING_TOKENS) -> Column:
    """Delimited text -> array of a type (members that do not parse become NULL)."""
    return F.transform(split_list(c, sep, tokens), lambda x: F.trim(x).try_cast(member_type))


def split_int_list(c, sep: str = LIST_SEPARATOR, tokens=MISSING_TOKENS) -> Column:
    """Delimited text -> array<int> (members that are not numbers become NULL)."""
    return split_typed_list(c, sep, "int", tokens)


def decode(c, mapping: dict, default: str | None = None) -> Column:
    """Map values through a small fixed dictionary (a CASE chain), else ``default``."""
    c = _c(c)
    out = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out
