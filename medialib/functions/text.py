"""String expressions: all built-in functions, so they stay inside codegen."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def contains_any(col, words) -> Column:
    """True when any of the words occurs as a substring."""
    return reduce(lambda a, b: a | b, [_c(col).contains(w) for w in words])


def starts_with_any(col, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [_c(col).startswith(p) for p in prefixes])


def first_upper(col) -> Column:
    """Upper-case the first letter only (``initcap`` would touch every word)."""
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def strip_extension(col) -> Column:
    """Drop the last dot and what follows; no dot leaves the text as it is."""
    return F.regexp_replace(_c(col), r"\.[^.]*$", "")


def blank(col) -> Column:
    return F.trim(F.coalesce(_c(col), F.lit(""))) == ""


def blank_to_null(col) -> Column:
    return F.when(~blank(col), _c(col))


def tag_list(col) -> Column:
    """Comma list to array: trimmed, empty entries dropped."""
    parts = F.split(F.coalesce(_c(col), F.lit("")), ",")
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def word_tokens(col, pattern: str, min_len: int) -> Column:
    """Lower-cased pieces between matches of ``pattern``, short ones dropped."""
    return F.filter(F.split(F.lower(_c(col)), pattern), lambda t: F.length(t) >= min_len)


UNICODE_BREAK = r"[^\p{L}\p{Nd}]+"
ASCII_BREAK = r"[^a-z0-9]+"
