"""Threshold-aware blocking: never another cluster, far fewer pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwise.operators import reach as R
from linkwise.operators.blocking import candidate_pairs, profile_table
from linkwise.operators.compare import compare
from linkwise.operators.score import above_threshold, score, with_term_frequencies
from linkwise.operators.train import Model, floored
from linkwise.plans.spec import BlockingRule, Comparison, MatchSpec

COMPS = (Comparison("a", "exact", term_frequency=True), Comparison("b", "levenshtein"), Comparison("c", "postcode"),
         Comparison("d", "exact", blank_as_null=True), Comparison("e", "jaro_winkler"))


def random_model(rng):
    m, u = {}, {}
    for c in COMPS:
        m[c.column] = floored(np.sort(np.array([rng.random() ** 3 for _ in range(c.n_levels)])))
        u[c.column] = floored(np.sort(np.array([rng.random() ** 4 for _ in range(c.n_levels)]))[::-1])
    return Model(list(COMPS), m, u, 10 ** -rng.uniform(1, 4))


def records(rng, n=140):
    pick = rng.choice
    return [(i, pick(["x"] * 8 + ["y", "z", "rare" + str(i // 2)]), pick(["oak", "oaks", "pine", None]),
             pick(["12345", "12399", "1", "", "90000", None]), pick(["", "p", "q", None]), pick(["jon", "john", "ann"]))
            for i in range(n)]


def linked(pairs, model, threshold):
    found = above_threshold(score(compare(pairs, COMPS), model, ["a"]), threshold)
    return sorted((r.rep_id_l, r.rep_id_r, r.pair_count, r.match_key, round(r.match_weight, 9)) for r in found.collect())


@pytest.mark.parametrize("seed", range(3))
def test_no_pair_above_the_threshold_is_lost(spark, seed):
    rng = random.Random(seed)
    rows = records(rng)
    df = spark.createDataFrame(rows, "unique_id long, a string, b string, c string, d string, e string")
    rules = (BlockingRule("l.a = r.a AND (l.b = r.b OR l.e = r.e)"), BlockingRule("l.e = r.e"))
    spec = MatchSpec(rules, COMPS, salt_block_size=50_000 if seed % 2 else 20)
    profiles = with_term_frequencies(profile_table(df, ["a", "b", "c", "d", "e"]), ["a"]).cache()
    columns = ["a", "b", "c", "d", "e", "tf_a"]
    all_pairs = candidate_pairs(profiles, spec, columns).cache()
    model = random_model(rng)
    for threshold in (0.5, 0.99):
        some = R.reachable_pairs(profiles, spec, model, threshold, columns, ["a"])
        assert linked(some, model, threshold) == linked(all_pairs, model, threshold)
    profiles.unpersist()


def test_requirements_are_the_weakest_combinations():
    two = [[R.State(None, -2, 1), R.State("l.x = r.x", 5, 0.1)], [R.State(None, -1, 1), R.State("p", 1, 0.5), R.State("l.y = r.y", 6, 0.01)]]
    assert R.requirements(two, 0.0, 4.0) == [(0, 2), (1, 0)]
    assert R.chosen_keys(two, [(0, 2), (1, 0)]) == ["l.y = r.y", "l.x = r.x"]
    assert R.requirements(two, 0.0, -3.0) == [(0, 0)] and R.chosen_keys(two, [(0, 0)]) is None
    assert R.requirements(two, 0.0, 50.0) == [] and R.chosen_keys(two, []) == []
    assert R.requirements(two, 0.0, 6.0) == [(1, 1)] and R.chosen_keys(two, [(1, 1)]) == ["l.x = r.x"]


def test_rules_of_alternatives_are_bracketed():
    assert R.with_key("l.a = r.a AND (l.b = r.b OR l.c = r.c)", "K") == "l.a = r.a AND (l.b = r.b OR l.c = r.c) AND K"
    assert R.with_key("l.a = r.a or l.b = r.b", "K") == "(l.a = r.a or l.b = r.b) AND K"


def test_pairs_of_a_common_name_do_not_grow_with_its_square(spark):
    """One name holds a third of all records; agreement on it alone is far below the threshold."""
    comps = (Comparison("name", "exact"), Comparison("npi", "exact"), Comparison("zip", "postcode"))
    spec = MatchSpec((BlockingRule("l.name = r.name"),), comps)
    model = Model(list(comps), {"name": np.array([0.05, 0.95]), "npi": np.array([0.05, 0.95]), "zip": np.array([0.02, 0.02, 0.06, 0.9])},
                  {"name": np.array([0.7, 0.3]), "npi": np.array([0.999, 0.001]), "zip": np.array([0.9, 0.09, 0.009, 0.001])}, 1e-4)
    n = {}
    for size in (300, 3000):
        df = spark.range(size).select(
            F.col("id").alias("unique_id"), F.when(F.col("id") % 3 == 0, "smith").otherwise(F.concat(F.lit("n"), F.col("id"))).alias("name"),
            (F.col("id") - F.col("id") % 6).cast("string").alias("npi"),
            F.lpad((F.col("id") * 7919 % 100_000).cast("string"), 5, "0").alias("zip"))
        prof = profile_table(df, ["name", "npi", "zip"])
        n[size] = R.reachable_pairs(prof, spec, model, 0.95, ["name", "npi", "zip"]).count()
    assert 0 < n[300] and n[3000] <= 12 * n[300] and n[3000] < 1000 * 999 / 2 / 20
