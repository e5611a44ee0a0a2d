"""Hierarchical keys as arrays of segments. Comparisons are by segment, so [a, b] is above [a, b, c] but not above [a, bc]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def segments(text: Column | str, separator: str = "/") -> Column:
    """Non-empty parts between separators."""
    return F.filter(F.split(col(text), f"\\Q{separator}\\E"), lambda x: x != "")


def url_path(url: Column | str) -> Column:
    """Host and path segments of a url, without scheme, query and fragment; null counts as empty."""
    bare = F.regexp_replace(F.coalesce(col(url), F.lit("")), "[?#].*$", "")
    return segments(F.regexp_replace(bare, "^[a-z]+://", ""))


def prefixes(path: Column | str) -> Column:
    """All prefixes, from the root (empty) to the path itself."""
    p = col(path)
    return F.transform(F.sequence(F.lit(0), F.size(p)), lambda n: F.slice(p, F.lit(1), n))


def is_under(path: Column | str, scope: Column | str) -> Column:
    """Whether scope is path or one of its ancestors. For joins use prefixes() and an equality instead."""
    p, s = col(path), col(scope)
    return F.slice(p, F.lit(1), F.size(s)) == s


def common_length(a: Column | str, b: Column | str) -> Column:
    """Number of leading segments that both share."""
    a, b = col(a), col(b)
    steps = F.sequence(F.lit(0), F.least(F.size(a), F.size(b)))
    return F.array_max(F.filter(steps, lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)))


def group_key(path: Column | str, scope: Column | str, extra: int = 0) -> Column:
    """path cut one segment (and extra more) below where it leaves scope."""
    p = col(path)
    return F.slice(p, F.lit(1), common_length(p, scope) + 1 + extra)


def has_suffix(path: Column | str, suffix: Column | str) -> Column:
    """Whether path ends with suffix; an empty suffix ends everything."""
    p, s = col(path), col(suffix)
    inside = F.size(s) <= F.size(p)
    return F.when(inside, F.slice(p, F.greatest(F.size(p) - F.size(s) + 1, F.lit(1)), F.size(s)) == s).otherwise(False)


def parent(path: Column | str) -> Column:
    """All but the last segment; the root's parent is the root."""
    p = col(path)
    return F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))
