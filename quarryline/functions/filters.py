"""Predicates of searches and reports as column expressions: optional filters, ranges, paths, message kinds, validity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def field_matches(c: Column, wanted: str | None) -> Column:
    """Whether a field holds the wanted text, whatever its case; no wish accepts all, a null field then too."""
    return F.lit(True) if wanted is None else F.coalesce(F.lower(c).contains(wanted.lower()), F.lit(False))


def flag_matches(c: Column, wanted: bool | None) -> Column:
    """Whether a flag is as wanted; null counts as not set."""
    return F.lit(True) if wanted is None else F.coalesce(c.cast("boolean"), F.lit(False)) == wanted


def within(c: Column, after: Column | None = None, before: Column | None = None) -> Column:
    """Whether a time lies in a range, both ends included; an open end accepts all."""
    bounds = [c >= after] * (after is not None) + [c <= before] * (before is not None)
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def path_matches(c: Column, wanted: str) -> Column:
    """The path itself, or one below it; a wish without slash may also be any part of the path.

    Case, back slashes and a closing slash make no difference; an empty wish accepts all.
    """
    plain = lambda x: F.regexp_replace(F.lower(F.replace(F.trim(x), F.lit("\\"), F.lit("/"))), "/+$", "")
    own, want = plain(c), wanted.strip().replace("\\", "/").lower().rstrip("/")
    if not want:
        return F.lit(True)
    hit = (own == want) | own.startswith(want + "/")
    return F.coalesce(hit if "/" in want else hit | own.contains(want), F.lit(False))


def parsed_time(c: Column) -> Column:
    """A time from RFC 3339 or a plain date (its midnight, UTC); null for all else."""
    text = F.trim(c)
    stamp = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    day = text.rlike(r"^\d{4}-\d\d-\d\d$")
    return F.when(stamp, F.try_to_timestamp(F.regexp_replace(F.upper(text), "Z$", "+00:00"))).when(day, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("timestamp")


def system_like(role: Column, text: Column) -> Column:
    """Messages that no person or model wrote: roles of the program, or a text that begins with a reminder tag."""
    return ~role.isin("user", "assistant") | F.coalesce(F.ltrim(text).startswith("<system-reminder>"), F.lit(False))


def tool_only(text: Column, calls: Column) -> Column:
    """Messages with tool calls and no text."""
    return (F.coalesce(F.size(calls), F.lit(0)) > 0) & (F.coalesce(F.trim(text), F.lit("")) == "")


def retrievable(status: Column, deprecated: Column, valid_from: Column, valid_to: Column, now: Column) -> Column:
    """Active, not deprecated, and within [from, to); an open end is unbounded."""
    no = F.lit(False)
    return (F.coalesce(status == "active", no)) & ~F.coalesce(deprecated, no) & F.coalesce(now >= valid_from, F.lit(True)) & F.coalesce(now < valid_to, F.lit(True))


#: Labels that name no priced model (fixed values).
FREE_LABELS = [
    r"^mock$",
    r"^unknown$",
    r"^default$",
    r"^auto(/.*)?$",
    r"^pool[0-9]*$",
    r"^free$",
    r"^openrouter/free$",
    r":free$",
    r"-free$",
    r"^ollama/",
    r":cloud$",
    r"^qwen[0-9.]*(-coder)?:[0-9]+b$",
    r"^qwen[0-9][0-9.]*:[0-9]+b$",
    r"-coding-plan/",
    r"-token-plan",
]


def free_label(c: Column) -> Column:
    return F.lower(c).rlike("|".join(f"(?:{p})" for p in FREE_LABELS))
