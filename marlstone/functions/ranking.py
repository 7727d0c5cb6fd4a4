"""Rank modifiers and arm weights as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Priors of the quality tiers, recency floor, half-lives in days, and the fusion constant.
TIER_PRIOR = {"curated": 1.15, "authored": 1.0, "generated": 0.9, "raw": 0.8}
RECENCY_FLOOR, HALF_LIFE_CURATED, HALF_LIFE = 0.6, 365.0, 180.0
RRF_K = 60


def modifier(tier: Column, age_days: Column) -> Column:
    """Tier prior times a recency that falls to a floor; unknown age is old."""
    prior = F.lit(1.0)
    for t, p in TIER_PRIOR.items():
        prior = F.when(tier == t, p).otherwise(prior)
    half = F.when(tier == "curated", HALF_LIFE_CURATED).otherwise(HALF_LIFE)
    recency = RECENCY_FLOOR + (1 - RECENCY_FLOOR) * F.pow(F.lit(2.0), -F.greatest(age_days, F.lit(0)) / half)
    return prior * F.when(age_days.isNull(), RECENCY_FLOOR).otherwise(recency)


def arm_weight(arm: Column, route: Column) -> Column:
    code_first = route.isin("symbol", "path", "exact")
    return F.when(arm.startswith("fts_code"), F.when(code_first, 1.0).otherwise(0.6)).when(arm.startswith("fts_prose"), F.when(code_first, 0.6).otherwise(1.0)).otherwise(1.0)


def rrf(weight: Column, rank0: Column) -> Column:
    return weight / (RRF_K + rank0 + 1)
