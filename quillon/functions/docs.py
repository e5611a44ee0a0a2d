"""Expressions on documentation text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.paths import col


def one_space(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def squeezed(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\s+", "")


def first_paragraph(text: Column | str) -> Column:
    """Lines up to the first blank one or heading, joined by spaces; empty if the text starts with a heading."""
    lines = F.split(F.regexp_replace(col(text), r"^\s+", ""), "\n")
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(r"^\s*$|^#{1,6} ")), True)
    kept = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    return one_space(F.array_join(kept, " "))


def first_sentence(paragraph: Column | str) -> Column:
    """Up to the first full stop before a space or the end that does not belong to e.g. or i.e.; without one, all of it."""
    p = col(paragraph)
    return F.coalesce(F.nullif(F.regexp_extract(p, r"^(.*?(?<!e\.g)(?<!i\.e)[.])(?: |\z)", 1), F.lit("")), p)


def summary(text: Column | str) -> Column:
    """First sentence of the first paragraph; null if there is none."""
    return F.nullif(first_sentence(first_paragraph(text)), F.lit(""))


def heading_level(line: Column | str) -> Column:
    """1 to 6 for a heading, else 0."""
    return F.length(F.regexp_extract(col(line), "^(#{1,6}) ", 1))


def is_documented(lines: Column | str) -> Column:
    """Whether any of an array of lines has a character that is not white space."""
    return F.exists(col(lines), lambda x: x.rlike(r"\S"))


def topic(title: Column | str) -> Column:
    """The task that a heading `How to ...` names, in lower case; else null."""
    return F.nullif(F.trim(F.regexp_extract(F.lower(col(title)), r"^how to (.+)$", 1)), F.lit(""))


def facts(lines: Column | str, prefixes: list[str]) -> Column:
    """Trimmed lines that start with one of prefixes and a colon."""
    trimmed = F.transform(col(lines), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(x, F.concat(p, F.lit(":")))))


def matches_topic(name: Column | str, query: str) -> Column:
    """2 if name is query (lower-cased), 1 if it contains all of query's words, else 0."""
    words = F.array(*map(F.lit, query.lower().split())).cast("array<string>")
    low = F.lower(col(name))
    return F.when(low == query.lower(), 2).when(F.forall(words, lambda w: F.contains(low, w)), 1).otherwise(0)


def without_generics(path: Column | str) -> Column:
    """a<b<c>>::d as a::d. Four rounds take off four levels of nesting."""
    out = col(path)
    for _ in range(4):
        out = F.regexp_replace(out, "<[^<>]*>", "")
    return out


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))
