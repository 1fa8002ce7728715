"""Training: fair pair sample, all sessions, the same EM in Spark and in the driver."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkwise.operators import train as T
from linkwise.operators.blocking import profile_table
from linkwise.operators.prepare import prepare
from linkwise.plans.spec import BlockingRule, Comparison, MatchSpec, spec_fuzzy
from linkwise.sources.fixture import provider_records

from .conftest import SF_SMALL


@pytest.mark.parametrize("n, step", [(1_500, 10), (15_000, 10), (150_000, 7), (150_000, 2**33 + 1)])
def test_pair_sample_is_fair(spark, n, step):
    """Shares of agreeing pairs are those of all pairs, whatever the ids' spacing."""
    records = spark.range(n).select((F.col("id") * step).alias("unique_id"), (F.col("id") % 7).alias("city"),
                                    (F.col("id") % 20).alias("name"))
    budget = 50_000
    row = T.random_pairs(records, ["city", "name"], budget, n).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("city_l") == F.col("city_r")).cast("int")).alias("city"),
        F.avg((F.col("name_l") == F.col("name_r")).cast("int")).alias("name")).collect()[0]
    assert abs(row["n"] - budget) < 0.05 * budget
    for column, k in (("city", 7), ("name", 20)):
        sizes = np.bincount(np.arange(n) % k).astype(float)
        exact = (sizes * (sizes - 1)).sum() / (n * (n - 1.0))
        assert abs(row[column] - exact) < 5 * np.sqrt(exact * (1 - exact) / row["n"])


def test_small_tables_give_all_pairs(spark):
    records = spark.range(120).select(F.col("id").alias("unique_id"))
    pairs = T.random_pairs(records, [], 10_000).collect()
    assert len(pairs) == len({(p.unique_id_l, p.unique_id_r) for p in pairs}) == 120 * 119 // 2


@pytest.fixture(scope="module")
def records(spark):
    return prepare(provider_records(spark, SF_SMALL), "rid")[0].cache()


def test_default_rules_train_all_sessions(records):
    spec = MatchSpec((BlockingRule("l.npi = r.npi"),), (Comparison("street_address", "levenshtein"),))
    model = T.train(records, profile_table(records, spec.profile_columns()), spec)
    assert len(model.sessions) == 3 and not model.skipped
    assert all(abs(v.sum() - 1) < 1e-9 for v in [*model.m.values(), *model.u.values()])


def test_many_patterns_train_in_spark(records, monkeypatch):
    """A pattern table beyond the driver's bound is worked on in Spark, with the same result."""
    columns = ("given_name", "family_name", "street_address", "city", "state", "postal_code", "phone")
    spec = MatchSpec((BlockingRule("l.npi = r.npi"),), tuple(Comparison(c, "name") for c in columns[:4]), max_iterations=4)
    profiles = profile_table(records, spec.profile_columns())
    driver = T.train(records, profiles, spec)
    monkeypatch.setattr(T, "DRIVER_PATTERNS", 1)
    spread = T.train(records, profiles, spec)
    assert len(driver.sessions) == len(spread.sessions) == 3
    for c in columns[:4]:
        assert np.allclose(driver.m[c], spread.m[c], atol=1e-9)
    assert [s["iterations"] for s in driver.sessions] == [s["iterations"] for s in spread.sessions]


def test_levels_that_no_pair_shows_keep_their_value():
    c = Comparison("a", "levenshtein", (1, 2))
    patterns = pd.DataFrame({"gamma_a": [0, 3], "pair_count": [10, 30]})
    u = {"a": np.array([0.9, 0.05, 0.03, 0.02])}
    m = T.expectation_maximisation(patterns, [c], u, 5, 0.0).m["a"]
    assert m[1:3] == pytest.approx(T.start_m(c)[1:3]) and m.sum() == pytest.approx(1)


def test_a_rule_without_pairs_is_named_and_other_errors_are_raised(spark, records, monkeypatch):
    single = records.limit(1).cache()
    spec = MatchSpec((BlockingRule("l.npi = r.npi"),), (Comparison("city", "exact"),))
    model = T.train(single, profile_table(single, spec.profile_columns()), spec)
    assert len(model.skipped) == 3 and "no pairs" in model.skipped[0]

    def lost(*args, **kw):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(T, "session_patterns", lost)
    with pytest.raises(RuntimeError, match="executor lost"):
        T.train(records, profile_table(records, spec.profile_columns()), spec)


def test_term_frequencies_on_profiles_match_the_records(records):
    from linkwise.operators.score import term_frequencies, with_term_frequencies

    spec = spec_fuzzy()
    profiles = with_term_frequencies(profile_table(records, spec.profile_columns()), ["family_name"])
    got = {r.family_name: r.tf_family_name for r in profiles.collect()}
    want = {r.value: r.tf for r in term_frequencies(records, "family_name").collect()}
    assert got == pytest.approx(want)
