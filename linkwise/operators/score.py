"""Scoring: match weight and probability per pair, threshold filter.

Trained parameters enter the plan as literals (one ``CASE`` per comparison),
so scoring is a single projection with no join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwise.operators.train import Model
from linkwise.plans.spec import Comparison


def level_weight(c: Comparison, m, u) -> Column:
    """log2(m/u) of the pair's level; 0 for the null level."""
    g = F.col(c.gamma)
    expr = None
    for k in range(c.n_levels):
        w = F.lit(math.log2(float(m[k]) / float(u[k])))
        expr = F.when(g == k, w) if expr is None else expr.when(g == k, w)
    return expr.otherwise(F.lit(0.0))


def term_frequencies(records: DataFrame, column: str) -> DataFrame:
    """Relative frequency of every value of ``column`` (A19): a partial
    aggregate per value divided by the non-null total (a single number)."""
    present = records.where(F.col(column).isNotNull())
    total = present.count()
    counts = present.groupBy(column).agg(F.count(F.lit(1)).alias("_nv"))
    return counts.select(F.col(column).alias("value"), (F.col("_nv") / F.lit(max(total, 1))).alias("tf"))


def with_term_frequencies(profiles: DataFrame, columns: list[str]) -> DataFrame:
    """Profiles with ``tf_<col>``: the share of records holding their value, from the profiles'
    counts. Pairs formed from them carry both sides' figures without a join on a hot value."""
    for c in columns:
        held = profiles.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum("n").alias("_nv"))
        total = held.agg(F.sum("_nv").alias("t")).collect()[0]["t"] or 1
        tf = held.select(F.col(c).alias(f"_v_{c}"), (F.col("_nv") / F.lit(total)).alias(f"tf_{c}"))
        profiles = profiles.join(tf, F.col(c) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    return profiles


def match_weight(model: Model, tf_columns: list[str] = ()) -> Column:
    prior = model.prior
    w = F.lit(math.log2(prior / (1.0 - prior)))
    for c in model.comparisons:
        w = w + level_weight(c, model.m[c.column], model.u[c.column])
        if c.column in tf_columns and c.term_frequency:
            top = c.n_levels - 1
            u_top = float(model.u[c.column][top])
            tf = F.greatest(F.col(f"tf_{c.column}_l"), F.col(f"tf_{c.column}_r"))
            w = w + F.when((F.col(c.gamma) == top) & tf.isNotNull(), F.log2(F.lit(u_top) / tf)).otherwise(0.0)
    return w


def probability(weight: Column) -> Column:
    """2^w / (1 + 2^w), written to stay finite for large |w|."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(2.0), -weight))


def score(gammas: DataFrame, model: Model, tf_columns: list[str] = ()) -> DataFrame:
    """Add ``match_weight`` and ``match_probability``."""
    w = match_weight(model, tf_columns)
    return gammas.withColumn("match_weight", w).withColumn("match_probability", probability(F.col("match_weight")))


def above_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    """Pairs with probability at or above ``threshold``."""
    return scored.where(F.col("match_probability") >= F.lit(float(threshold)))
