"""Column functions that score notes: heat, recency, importance, validity, decay, return on investment."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-lives in days, decay factors and worth by category; boosts and decay factors by importance; boosts by temperature.
HALF_LIFE = {"conversation": 7, "decision": 30, "fact": 90, "insight": 30, "observation": 14, "plan": 7, "preference": 60, "reflection": 30}
DECAY_BY_CATEGORY = {"conversation": 2.0, "decision": 0.5, "fact": 0.25, "insight": 1 / 1.5, "observation": 1.0, "plan": 1 / 0.7, "preference": 0.25, "reflection": 1.0}
WORTH = {"conversation": 0.3, "decision": 1.5, "fact": 2.0, "insight": 1.2, "observation": 1.0, "plan": 0.5, "preference": 1.8, "reasoning": 1.3, "reflection": 0.8}
IMPORTANCE_BOOST = {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.7}
DECAY_BY_IMPORTANCE = {"critical": 0.5, "high": 0.75, "medium": 1.0, "low": 1.5}
TEMPERATURE_BOOST = {"hot": 1.5, "warm": 1.0, "cold": 0.5}


def lookup(key: Column, values: dict[str, float], default: float) -> Column:
    if not values:
        return F.lit(float(default))
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(float(default)))


def rrf(rank: Column, k: int = 60) -> Column:
    """The reciprocal-rank term of a rank from 1; 0 for a row that the arm doesn't have."""
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))


def heat_boost(heat: Column) -> Column:
    return 0.5 + F.least(F.greatest(heat, F.lit(0)), F.lit(16)) / 16


def recency(days: Column, half_life) -> Column:
    return 1 / (1 + days / half_life)


def validity(alpha: Column, beta: Column) -> Column:
    return alpha / (alpha + beta)


def validity_state(share: Column) -> Column:
    return F.when(share <= 0.40, "quarantined").when(share <= 0.60, "stale").otherwise("fresh")


def validity_factor(share: Column) -> Column:
    """0 for quarantined, half for stale."""
    return F.when(share <= 0.40, 0.0).when(share <= 0.60, 0.5).otherwise(1.0)


def centrality_boost(inbound: Column, weight: float = 0.15, full: int = 25) -> Column:
    return 1 + weight * F.least(F.lit(1.0), F.log1p(inbound) / math.log1p(full))


def heat_score(
    days_since_update: Column,
    days_since_access: Column,
    accesses: Column,
    inbound: Column,
    days_since_created: Column | None = None,
    has_open_task: Column | None = None,
    is_open_task: Column | None = None,
) -> Column:
    """0 to 16: how recently a note was updated (4 at most) and read (3), how often it was read (3), links to it (3), open tasks (3).

    A note that was never read gets 1 for a creation within a week instead.
    """

    def steps(value: Column, points: list[tuple[int, int]], recent: bool) -> Column:
        out = None
        for bound, n in points:
            hit = value <= bound if recent else value >= bound
            out = F.when(hit, n) if out is None else out.when(hit, n)
        return out.otherwise(0)

    score = steps(days_since_update, [(1, 4), (3, 3), (7, 2), (30, 1)], True) + steps(days_since_access, [(1, 3), (3, 2), (7, 1)], True)
    score = score + steps(accesses, [(20, 3), (10, 2), (3, 1)], False) + steps(inbound, [(10, 3), (5, 2), (1, 1)], False)
    if days_since_created is not None:
        score = score + F.when(days_since_access.isNull() & (days_since_created <= 7), 1).otherwise(0)
    for flag, n in ((has_open_task, 2), (is_open_task, 1)):
        if flag is not None:
            score = score + F.when(flag, n).otherwise(0)
    return score


def temperature(heat: Column) -> Column:
    return F.when(heat >= 10, "hot").when(heat >= 4, "warm").otherwise("cold")


def decayed(heat: Column, days: Column, category: Column, importance: Column) -> Column:
    base = F.when(days > 30, 2).when(days > 7, 1).otherwise(0)
    return F.greatest(F.lit(0.0), heat - base * lookup(category, DECAY_BY_CATEGORY, 1.0) * lookup(importance, DECAY_BY_IMPORTANCE, 1.0))


def roi(days: Column, accesses: Column, category: Column, length: Column) -> Column:
    """Tokens that a note is expected to save in a quarter, less those it costs."""
    chance = F.exp(-0.05 * days) * (1 + 0.1 * F.least(accesses, F.lit(50)))
    return 600 * chance * 3 * lookup(category, WORTH, 1.0) - (F.ceil(length / 4) + 50)


def half_up(value: Column, digits: int = 0) -> Column:
    return F.floor(value * 10**digits + 0.5) / 10**digits
