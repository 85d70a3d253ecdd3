"""Scores as column expressions: decay of confidence, relevance, freshness steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-lives in days by category (fixed values); others 45.
HALF_LIFE = {"correction": 365.0, "preference": 90.0, "fact": 30.0, "entity": 60.0}
OTHER_HALF_LIFE = 45.0


def _pick(c: Column, table: dict[str, float], otherwise: float) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(c == name, value) if out is None else out.when(c == name, value)
    return out.otherwise(otherwise)


def decayed_confidence(confidence: Column, age_days: Column, category: Column, uses: Column) -> Column:
    """min(1, c e^(-0.693 age / half-life) (1 + 0.1 ln(uses + 1))), whole days."""
    decay = F.exp(-F.floor(age_days) / _pick(category, HALF_LIFE, OTHER_HALF_LIFE) * 0.693)
    return F.least(F.lit(1.0), confidence * decay * (1 + 0.1 * F.log(uses + 1.0)))


def relevance(age_hours: Column, uses: Column, base: Column, trust: Column, strength: Column) -> Column:
    """Recency, use and category weight times trust, plus 5 ln(strength); a strength of 0 counts as none (null)."""
    return (100.0 / (1 + age_hours / 24.0) + F.sqrt(uses) * 10 + base) * trust + F.when(strength > 0, F.log(strength)) * 5


def freshness(seen: Column, changed: Column) -> Column:
    """How far a sight of a file still holds: 1 if it hasn't changed since, less the longer after it did.

    Steps at 5 whole seconds, 10 minutes and 6 hours; .7 where the sight's time isn't known, .72 where the change's isn't.
    """
    age = (F.unix_micros(changed.cast("timestamp")) - F.unix_micros(seen.cast("timestamp"))) / 1e6
    return F.when(seen.isNull(), 0.7).when(changed.isNull(), 0.72).when(age <= 0, 1.0).when(age < 6, 0.92).when(age < 660, 0.68).when(age < 25_200, 0.45).otherwise(0.25)


def exposure(body: Column, structure: Column, position: Column, messages: Column, cutoff: Column) -> tuple[Column, Column]:
    """Confidences in a file's body and structure after how far back it was seen: the last 15 % of a session's messages
    count in full, then .88 from 60 % on, .72 before, .42 in the compacted part (before `cutoff`)."""
    ratio = F.when(messages <= 1, 1.0).otherwise((position + 1) / messages)
    factor = F.when(F.coalesce(position < cutoff, F.lit(False)), 0.42).when(ratio >= 0.85, 1.0).when(ratio >= 0.6, 0.88).otherwise(0.72)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return clamp(body * factor), clamp(structure * (0.75 + 0.25 * factor))
