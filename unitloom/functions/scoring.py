"""Weights and signals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
KIND_WEIGHT = {
    "var_chain": 1.25, "coverage_chain": 0.70, "cover": 0.80, "guarded_dispatch": 1.35,
    "predicate_accept": 1.20, "postprocess_tail": 1.10, "iterator_backbone": 0.95,
    "anchor_bridge": 1.25, "context": 1.15, "anchor": 1.05, "api_hybrid": 0.95,
    "ret_forward": 0.90, "straight": 0.85, "skeleton": 0.75, "anchor_micro": 0.70,
}


def unit_prior(kind: Column, quality: Column, role: Column, penalty: Column) -> Column:
    weight = F.lit(1.0)
    for k, v in KIND_WEIGHT.items():
        weight = F.when(kind == k, v).otherwise(weight)
    q = F.coalesce(F.nullif(quality, F.lit(0.0)), F.lit(1.0))
    q = F.least(F.lit(1.5), F.greatest(F.lit(0.35), q))
    primary = F.when(F.coalesce(F.nullif(role, F.lit("")), F.lit("primary")) == "primary", 1.0).otherwise(0.25)
    g = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(penalty, F.lit(0.0))))
    return weight * q * primary * F.greatest(F.lit(0.45), 1 - 0.5 * g)


def rank_affinity(rank: Column) -> Column:
    """Inner product: the distance term is 1 whatever the distance, rank decay alone is left. Ranks from 0."""
    return 1 / F.sqrt(rank + 1)


def l2_affinity(rank: Column, distance: Column, best: Column) -> Column:
    return F.exp(-F.greatest(F.lit(0.0), distance - best) / F.greatest(best * 2.5, F.lit(1e-4))) / F.sqrt(rank + 1)


def posting_signal(best: Column, support: Column, buckets: Column) -> Column:
    s = 0.58 * (1 - F.exp(-1.6 * best)) + 0.30 * (1 - F.exp(-0.85 * support)) + 0.12 / F.sqrt(F.greatest(F.lit(1), buckets))
    return F.when((best <= 0) & (support <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))


def posting_order(best: Column, support: Column) -> Column:
    return 0.70 * best + 0.30 * F.when(support <= 0, 0.0).otherwise(1 - F.exp(-0.85 * support))


def query_weight(idf: Column, df: Column, length: Column, hot: Column) -> Column:
    df_term = F.greatest(F.lit(0.15), 1 - 2.5 * df)
    post_term = 1 / F.sqrt(F.greatest(F.lit(1.0), length / 32.0))
    w = idf * F.greatest(F.lit(0.18), df_term * post_term)
    stop = (length >= 128) & (df >= 0.18)
    w = F.when(stop, w * F.greatest(F.lit(0.18), F.sqrt(df_term * post_term))).otherwise(w)
    return F.least(F.lit(0.55), w) * hot


def candidate_cap(n: Column) -> Column:
    return F.greatest(F.lit(500), F.ceil(6 * F.sqrt(n))).cast("long")
