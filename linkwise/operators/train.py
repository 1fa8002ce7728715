"""Fellegi-Sunter training: u from random pairs, m by EM on pattern counts.

* u for ``exact`` comparisons has a closed form over value counts
  (sum of C(n_v, 2) over C(n, 2)) and needs no pairs; other comparisons use a
  random pair sample of bounded size (``random_pairs``).
* The patterns of a session whose comparisons are all exact are counted without pairs (``exact_patterns``); with one
  fuzzy comparison and large blocks, the pairs near in it are formed and the others counted (``near_patterns``).
* EM runs on agreement-pattern counts, which Spark aggregates. A small table goes to the
  driver; a table of more than ``DRIVER_PATTERNS`` possible rows stays in Spark, where each
  iteration is one aggregate to a single row. Both give the same updates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwise.operators.blocking import rule_pairs
from linkwise.operators.compare import compare
from linkwise.operators.exact_patterns import exact_patterns, possible
from linkwise.operators.near_patterns import near_patterns, spares_pairs
from linkwise.plans.spec import BlockingRule, Comparison, MatchSpec
from linkwise.session import materialize

PROBABILITY_FLOOR = 1e-6
#: Possible agreement patterns up to which the counts are brought to the driver.
DRIVER_PATTERNS = 100_000
HASH_RANGE = 2**32
#: Parts in which the one bucket of an all-pairs sample is joined.
SINGLE_BUCKET_PARTS = 16


def id_hash(column, seed: str):
    """32 mixed bits of an id; different seeds give independent values (md5, so any SQL engine can repeat it)."""
    digest = F.md5(F.concat(column.cast("string"), F.lit(f"/{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def sampling_plan(n_records: int, max_pairs: int) -> tuple[float, int]:
    """(share of records kept, number of buckets) for about ``max_pairs``.

    All pairs when they fit the budget; otherwise about 2*max_pairs records
    are kept and spread over buckets so that pairs ~= max_pairs in expectation.
    """
    total = n_records * (n_records - 1) // 2
    if total <= max_pairs:
        return 1.0, 1
    kept = min(n_records, 2 * max_pairs)
    buckets = max(1, math.ceil(kept * kept / (2.0 * max_pairs)))
    return kept / n_records, buckets


def random_pairs(records: DataFrame, columns: list[str], max_pairs: int,
                 n_records: int | None = None) -> DataFrame:
    """Random record pairs (``<col>_l``, ``<col>_r``), about ``max_pairs``.

    Whether a record is kept and which bucket it joins are independent hashes of
    ``unique_id``, so every pair of records has the same chance; the same ids give
    the same sample on every run and retry. Buckets are small (an equi-join without a
    hot key). When all pairs fit the budget there is one bucket, which is joined in
    ``SINGLE_BUCKET_PARTS`` parts.
    """
    n = n_records if n_records is not None else records.count()
    fraction, buckets = sampling_plan(n, max_pairs)
    uid = F.col("unique_id")
    sample = records.select("unique_id", *columns).where(id_hash(uid, "keep") < F.lit(int(fraction * HASH_RANGE)))
    sample = sample.withColumn("_bucket", F.pmod(id_hash(uid, "bucket"), F.lit(buckets)))
    parts = SINGLE_BUCKET_PARTS if buckets == 1 else 1
    l = sample.withColumn("_part", F.pmod(id_hash(uid, "part"), F.lit(parts)).cast("int")).alias("l")
    r = sample.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).alias("r")
    joined = l.join(r, (F.col("l._bucket") == F.col("r._bucket")) & (F.col("l._part") == F.col("r._part"))
                    & (F.col("l.unique_id") < F.col("r.unique_id")))
    cols = [F.col("l.unique_id").alias("unique_id_l"), F.col("r.unique_id").alias("unique_id_r")]
    for c in columns:
        cols += [F.col(f"l.{c}").alias(f"{c}_l"), F.col(f"r.{c}").alias(f"{c}_r")]
    return joined.select(*cols)


def u_exact(records: DataFrame, comparison: Comparison) -> DataFrame:
    """Closed-form u of an exact comparison: (column, u_exact, u_else)."""
    c = F.col(comparison.column)
    valid = c.isNotNull()
    if comparison.blank_as_null:
        valid = valid & (c != F.lit(""))
    counts = records.where(valid).groupBy(comparison.column).agg(F.count(F.lit(1)).alias("nv"))
    agg = counts.agg(
        F.sum(F.col("nv") * (F.col("nv") - 1) / 2).alias("same"),
        F.sum("nv").alias("n"),
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2
    u = F.when(pairs > 0, F.col("same") / pairs)
    return agg.select(F.lit(comparison.column).alias("column"), u.alias("u_exact"), (1 - u).alias("u_else"))


def level_shares(gammas: DataFrame, comparisons: list[Comparison], weight: str | None = None) -> dict[str, np.ndarray]:
    """Share of each level among non-null pairs, per comparison (one aggregate)."""
    w = F.col(weight) if weight else F.lit(1)
    aggs = []
    for c in comparisons:
        for k in range(c.n_levels):
            aggs.append(F.sum(F.when(F.col(c.gamma) == k, w).otherwise(0)).alias(f"{c.gamma}__{k}"))
    row = gammas.agg(*aggs).collect()[0]
    out = {}
    for c in comparisons:
        v = np.array([float(row[f"{c.gamma}__{k}"] or 0) for k in range(c.n_levels)])
        total = v.sum()
        out[c.column] = v / total if total > 0 else np.full(c.n_levels, np.nan)
    return out


def estimate_u(records: DataFrame, comparisons: list[Comparison], max_pairs: int,
               n_records: int | None = None) -> dict[str, np.ndarray]:
    """u per comparison and level (index = gamma); floored, summing to 1."""
    out: dict[str, np.ndarray] = {}
    exact = [c for c in comparisons if c.kind == "exact"]
    other = [c for c in comparisons if c.kind != "exact"]
    if exact:
        parts = [u_exact(records, c) for c in exact]
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p)
        for row in merged.collect():
            ue = row["u_exact"]
            out[row["column"]] = np.array([np.nan, np.nan]) if ue is None else np.array([1.0 - ue, ue])
    if other:
        cols = list(dict.fromkeys(c.column for c in other))
        sample = compare(random_pairs(records, cols, max_pairs, n_records), other)
        out.update(level_shares(sample, other))
    return {k: floored(np.where(np.isnan(v), 0.0, v)) for k, v in out.items()}


def floored(shares: np.ndarray) -> np.ndarray:
    """Shares of at least ``PROBABILITY_FLOOR`` that sum to 1."""
    v = np.maximum(shares, PROBABILITY_FLOOR)
    return v / v.sum()


def pattern_counts(gammas: DataFrame, comparisons: list[Comparison]) -> DataFrame:
    """Agreement patterns and how many record pairs show each."""
    return gammas.groupBy(*[c.gamma for c in comparisons]).agg(F.sum("pair_count").alias("pair_count"))


def start_m(c: Comparison) -> np.ndarray:
    """Exact level 0.95; the other levels share 0.05."""
    m = np.full(c.n_levels, 0.05 / (c.n_levels - 1))
    m[-1] = 0.95
    return m


@dataclass
class EMResult:
    m: dict[str, np.ndarray]
    lam: float
    iterations: int
    converged: bool
    history: list[float] = field(default_factory=list)


def next_m(old: np.ndarray, mass: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """Shares of the posterior mass; a level that no pair shows keeps its value."""
    if mass.sum() <= 0:
        return old
    kept = np.where(observed > 0, 0.0, old)
    return kept + (1.0 - kept.sum()) * mass / mass.sum()


def em_loop(sums, comparisons: list[Comparison], max_iterations: int, convergence: float, lam: float,
            m: dict[str, np.ndarray] | None, observed: dict[str, np.ndarray], total: float) -> EMResult:
    """EM with fixed u. ``sums(m, lam)`` gives the posterior mass of all pairs, of each
    level of each comparison, and the log likelihood."""
    m = {c.column: np.asarray((m or {}).get(c.column, start_m(c)), float).copy() for c in comparisons}
    history: list[float] = []
    it, converged = 0, False
    if total <= 0:
        return EMResult(m, lam, 0, False, history)
    for it in range(1, max_iterations + 1):
        matched, masses, likelihood = sums(m, lam)
        history.append(likelihood)
        new_m = {c.column: next_m(m[c.column], masses[c.column], observed[c.column]) for c in comparisons}
        new_lam = matched / total
        delta = max([abs(new_lam - lam)] + [float(np.max(np.abs(new_m[k] - m[k]))) for k in m])
        m, lam = new_m, new_lam
        if delta < convergence:
            converged = True
            break
    return EMResult(m, lam, it, converged, history)


def expectation_maximisation(patterns: pd.DataFrame, comparisons: list[Comparison],
                             u: dict[str, np.ndarray], max_iterations: int = 20,
                             convergence: float = 0.001, lam: float = 0.5,
                             m: dict[str, np.ndarray] | None = None) -> EMResult:
    """EM over a small table of pattern counts; u is fixed, m and lambda are estimated."""
    counts = patterns["pair_count"].to_numpy(dtype=float)
    gam = {c.column: patterns[c.gamma].to_numpy(dtype=int) for c in comparisons}

    def by_level(weights):
        return {c.column: np.array([weights[gam[c.column] == k].sum() for k in range(c.n_levels)]) for c in comparisons}

    def sums(m, lam):
        pm, pu = np.full(len(counts), lam), np.full(len(counts), 1.0 - lam)
        for c in comparisons:
            g = gam[c.column]
            at = np.clip(g, 0, None)
            pm = np.where(g >= 0, pm * m[c.column][at], pm)
            pu = np.where(g >= 0, pu * u[c.column][at], pu)
        both = pm + pu
        post = counts * np.divide(pm, both, out=np.zeros_like(pm), where=both > 0)
        return float(post.sum()), by_level(post), float(np.sum(counts * np.log(np.where(both > 0, both, 1.0))))

    return em_loop(sums, comparisons, max_iterations, convergence, lam, m, by_level(counts), float(counts.sum()))


def expectation_maximisation_spark(patterns: DataFrame, comparisons: list[Comparison], u: dict[str, np.ndarray],
                                   max_iterations: int = 20, convergence: float = 0.001, lam: float = 0.5,
                                   m: dict[str, np.ndarray] | None = None) -> EMResult:
    """The same EM over a pattern table of any size: one aggregate per iteration."""

    def level_value(c, values):
        expr = F.lit(1.0)
        for k in range(c.n_levels):
            expr = F.when(F.col(c.gamma) == k, F.lit(float(values[k]))).otherwise(expr)
        return expr

    def by_level(weight):
        return [F.sum(F.when(F.col(c.gamma) == k, weight).otherwise(0.0)).alias(f"{c.gamma}__{k}")
                for c in comparisons for k in range(c.n_levels)]

    def split(row):
        return {c.column: np.array([float(row[f"{c.gamma}__{k}"] or 0.0) for k in range(c.n_levels)])
                for c in comparisons}

    def sums(m, lam):
        pm, pu = F.lit(float(lam)), F.lit(1.0 - float(lam))
        for c in comparisons:
            pm, pu = pm * level_value(c, m[c.column]), pu * level_value(c, u[c.column])
        post = F.when(F.col("_pm") + F.col("_pu") > 0, F.col("pair_count") * F.col("_pm") / (F.col("_pm") + F.col("_pu")))
        likelihood = F.when(F.col("_pm") + F.col("_pu") > 0, F.col("pair_count") * F.log(F.col("_pm") + F.col("_pu")))
        row = patterns.withColumns({"_pm": pm, "_pu": pu}).agg(
            F.sum(post).alias("matched"), F.sum(likelihood).alias("likelihood"), *by_level(post)).collect()[0]
        return float(row["matched"] or 0.0), split(row), float(row["likelihood"] or 0.0)

    first = patterns.agg(F.sum("pair_count").alias("total"), *by_level(F.col("pair_count"))).collect()[0]
    return em_loop(sums, comparisons, max_iterations, convergence, lam, m, split(first), float(first["total"] or 0.0))


@dataclass
class Model:
    comparisons: list[Comparison]
    m: dict[str, np.ndarray]
    u: dict[str, np.ndarray]
    prior: float
    sessions: list[dict] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)

    def parameters(self, spark: SparkSession) -> DataFrame:
        """(column, kind, gamma, m, u, weight) as a small DataFrame."""
        rows = []
        for c in self.comparisons:
            for k in range(c.n_levels):
                mk, uk = float(self.m[c.column][k]), float(self.u[c.column][k])
                rows.append((c.column, c.kind, k, mk, uk, math.log2(mk / uk)))
        return spark.createDataFrame(rows, "column string, kind string, gamma int, m double, u double, weight double")


class NoEstimate(ValueError):
    """The data give a training rule nothing to estimate from."""


def training_rules(spec: MatchSpec, columns: list[str]) -> list[str]:
    """The effective rules that read only columns at hand."""
    return [r for r in spec.effective_training_rules() if all(c in columns for c in BlockingRule(r).columns())]


def session_profiles(profiles: DataFrame, rule: str, included: list[Comparison]) -> DataFrame:
    """Profiles summed over what the session does not read, so its join sees each combination of key and
    compared values once."""
    needed = list(dict.fromkeys(BlockingRule(rule).columns() + [c.column for c in included]))
    return profiles.groupBy(*needed).agg(F.min("rep_id").alias("rep_id"), F.sum("n").alias("n"))


def session_patterns(profiles: DataFrame, rule: str, included: list[Comparison], spec: MatchSpec) -> DataFrame:
    """Pattern counts of a rule's pairs."""
    pairs = rule_pairs(session_profiles(profiles, rule, included), rule, list(dict.fromkeys(c.column for c in included)),
                       salt_block_size=spec.salt_block_size)
    return pattern_counts(compare(pairs, included), included)


def patterns_without_pairs(profiles: DataFrame, rule: BlockingRule, included: list[Comparison], spec: MatchSpec) -> pd.DataFrame | None:
    """The session's pattern counts where they can be had without forming all of its pairs, else None."""
    if possible(rule, included):
        return exact_patterns(profiles, rule, included)
    if math.prod(c.n_levels + 1 for c in included) > DRIVER_PATTERNS:
        return None
    merged = session_profiles(profiles, rule.sql, included)
    if not spares_pairs(merged, rule, included, [], spec.salt_block_size):
        return None
    return near_patterns(materialize(merged, "session"), rule, included, salt_block_size=spec.salt_block_size)


def em_session(profiles: DataFrame, rule: str, comparisons: list[Comparison], u: dict[str, np.ndarray],
               spec: MatchSpec) -> tuple[EMResult, list[Comparison]]:
    """One EM session on the pairs of ``rule``; its key columns are left out.

    Raises ``NoEstimate`` if no comparison is left or the rule finds no pair.
    """
    keys = set(BlockingRule(rule).equi_keys())
    included = [c for c in comparisons if c.column not in keys]
    if not included:
        raise NoEstimate("every comparison is a key of the rule")
    limits = (spec.max_iterations, spec.em_convergence)
    counted = patterns_without_pairs(profiles, BlockingRule(rule), included, spec)
    if counted is not None:
        result = expectation_maximisation(counted, included, u, *limits)
    elif math.prod(c.n_levels + 1 for c in included) <= DRIVER_PATTERNS:
        result = expectation_maximisation(session_patterns(profiles, rule, included, spec).toPandas(), included, u, *limits)
    else:
        patterns = materialize(session_patterns(profiles, rule, included, spec), "patterns")
        result = expectation_maximisation_spark(patterns, included, u, *limits)
    if not result.iterations:
        raise NoEstimate("the rule finds no pairs")
    return result, included


def train(records: DataFrame, profiles: DataFrame, spec: MatchSpec, n_records: int | None = None) -> Model:
    """u by sampling, then one EM session per training rule.

    A rule whose columns are absent or that leaves nothing to estimate is named in ``skipped``;
    any other failure is raised. m per level is the median over the sessions that
    estimated it, brought back to a sum of 1, else its start value.
    """
    comparisons = [c for c in spec.comparisons if c.column in records.columns]
    u = estimate_u(records, comparisons, spec.max_pairs_for_training, n_records)
    estimates: dict[str, list[np.ndarray]] = {c.column: [] for c in comparisons}
    usable = training_rules(spec, profiles.columns)
    sessions, skipped = [], [f"{r}: a column is absent" for r in spec.effective_training_rules() if r not in usable]
    for rule in usable:
        try:
            result, included = em_session(profiles, rule, comparisons, u, spec)
        except NoEstimate as exc:
            skipped.append(f"{rule}: {exc}")
            continue
        sessions.append({"rule": rule, "iterations": result.iterations, "lambda": result.lam,
                         "converged": result.converged})
        for c in included:
            estimates[c.column].append(result.m[c.column])
    m = {c.column: floored(np.median(np.vstack(estimates[c.column]), axis=0) if estimates[c.column] else start_m(c))
         for c in comparisons}
    return Model(comparisons, m, u, spec.prior_match, sessions, skipped)
