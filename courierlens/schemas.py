"""Ladders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score thresholds of the threat levels, most severe first.
THREAT_LEVELS = (("critical", 0.85), ("high", 0.65), ("medium", 0.40), ("low", 0.15))
LEVEL_RANK = {"safe": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITIES = ("info", "low", "medium", "high", "critical")


def threat_level(score: Column) -> Column:
    """The level of a score in [0, 1]."""
    level = F.lit("safe")
    for name, least in reversed(THREAT_LEVELS):
        level = F.when(score >= least, name).otherwise(level)
    return F.when(score.isNull(), None).otherwise(level)


def rank(value: Column, ladder: dict[str, int]) -> Column:
    """The place of a name on a ladder; null for other names."""
    out = F.lit(None).cast("int")
    for name, place in ladder.items():
        out = F.when(value == name, place).otherwise(out)
    return out


def severity_step(value: Column, steps: int = 1) -> Column:
    """A severity raised by some steps, the last one at most."""
    place = rank(value, {s: i for i, s in enumerate(SEVERITIES)})
    return F.when(place.isNotNull(), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.least(place + steps, F.lit(len(SEVERITIES) - 1)) + 1))
