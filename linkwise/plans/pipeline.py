"""End-to-end compositions.

Tables that later steps read many times (prepared records, profiles, scored
pairs) are written under the shared checkpoint folder and read back, so every
step starts from files and a lost executor never replays the whole plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwise.operators.blocking import candidate_pairs, profile_table
from linkwise.operators.cluster import assign_clusters, profile_clusters
from linkwise.operators.compare import available_comparisons, compare
from linkwise.operators.prepare import assert_batch_ok, prepare
from linkwise.operators.quality import QualityReport, analyze
from linkwise.operators.reach import reachable_pairs
from linkwise.operators.score import score, with_term_frequencies
from linkwise.operators.stats import cluster_statistics, clusters_by_size
from linkwise.operators.train import Model, train
from linkwise.plans.spec import MatchSpec
from linkwise.session import materialize, temporary_tables
from linkwise.sources.reader import load


@dataclass
class Prepared:
    records: DataFrame
    quarantine: DataFrame

    @property
    def profile(self) -> QualityReport:
        """The quality profile of the records, planned when it is asked for."""
        return analyze(self.records)


@dataclass
class DedupResult:
    results: DataFrame
    statistics: DataFrame
    clusters_by_size: DataFrame
    scored: DataFrame
    model: Model
    profiles: DataFrame
    warnings: list[str] = field(default_factory=list)


def prepare_data(raw: DataFrame, id_column: str | None = None, fail_fast: bool = True,
                 persist: bool = True) -> Prepared:
    """Batch check, row validation with quarantine, normalization; the quality profile on request."""
    if fail_fast:
        assert_batch_ok(raw)
    records, quarantine = prepare(raw, id_column)
    if persist:
        records = materialize(records, "prepared")
    return Prepared(records, quarantine)


def build_profiles(records: DataFrame, spec: MatchSpec, persist: bool = True) -> tuple[DataFrame, list[str]]:
    cols = [c for c in spec.profile_columns() if c in records.columns]
    profiles = profile_table(records, cols)
    if persist:
        profiles = materialize(profiles, "profiles")
    return profiles, cols


def score_pairs(records: DataFrame, profiles: DataFrame, spec: MatchSpec, model: Model,
                threshold: float | None = None) -> DataFrame:
    """Blocked pairs of every rule, compared and scored (C1, C3); with a ``threshold`` those alone that can reach it."""
    comps, _ = available_comparisons(spec.comparisons, records.columns)
    tf_cols = [c.column for c in comps if c.term_frequency]
    profiles = with_term_frequencies(profiles, tf_cols)
    columns = [c.column for c in comps] + [f"tf_{c}" for c in tf_cols]
    pairs = (candidate_pairs(profiles, spec, columns) if threshold is None
             else reachable_pairs(profiles, spec, model, threshold, columns, tf_cols))
    out = score(compare(pairs, comps), model, tf_cols)
    keep = ["rep_id_l", "rep_id_r", "pair_count", "match_key"] + [c.gamma for c in comps] + [
        "match_weight", "match_probability"]
    return out.select(*keep)


def deduplicate(records: DataFrame, profiles: DataFrame, profile_columns: list[str], spec: MatchSpec,
                model: Model, threshold: float | None = None, persist: bool = True) -> DedupResult:
    """Score, threshold, cluster, attach and count (C4). ``None`` = spec threshold.

    ``scored`` holds the pairs that can reach the threshold; ``score_pairs`` without one gives all.
    """
    t = spec.match_threshold if threshold is None else threshold

    def steps(done) -> tuple[DataFrame, DataFrame]:
        scored = done(score_pairs(records, profiles, spec, model, t), "scored")
        clusters = profile_clusters(scored, t)
        # statistics and reports then read one table instead of repeating the joins
        return scored, done(assign_clusters(records, profiles, clusters, profile_columns), "results")

    if persist:
        with temporary_tables(records.sparkSession) as keep:
            scored, results = steps(lambda df, name: keep(materialize(df, name)))
    else:
        scored, results = steps(lambda df, name: df)
    return DedupResult(results, cluster_statistics(results), clusters_by_size(results), scored, model, profiles)


def run_deduplication(raw: DataFrame, spec: MatchSpec, id_column: str | None = None,
                      threshold: float | None = None, persist: bool = True) -> DedupResult:
    """Full pipeline on a raw DataFrame."""
    def steps() -> DedupResult:
        prep = prepare_data(raw, id_column, persist=persist)
        profiles, cols = build_profiles(prep.records, spec, persist)
        model = train(prep.records, profiles, spec)
        result = deduplicate(prep.records, profiles, cols, spec, model, threshold, persist)
        _, absent = available_comparisons(spec.comparisons, prep.records.columns)
        result.warnings = [*spec.warnings, *absent, *model.skipped]
        return result

    if not persist:
        return steps()
    with temporary_tables(raw.sparkSession) as keep:
        result = steps()
        for frame in (result.results, result.scored, result.profiles):
            keep(frame)
    return result


def run_file(path: str, spark, spec: MatchSpec, id_column: str | None = None, **kw) -> DedupResult:
    """``run_deduplication`` on a file of any supported format."""
    return run_deduplication(load(spark, path), spec, id_column, **kw)


def quality_only(raw: DataFrame):
    """Load -> profile raw columns without normalization."""
    return analyze(raw)


def results_with_flags(result: DedupResult, min_cluster_size: int | None = None) -> DataFrame:
    """Results limited to clusters of at least ``min_cluster_size``."""
    out = result.results
    if min_cluster_size is not None:
        out = out.where(F.col("cluster_size") >= min_cluster_size)
    return out
