"""Pattern counts without pairs against the pair join."""

import random

import pytest

from linkwise.operators import exact_patterns as X
from linkwise.operators.blocking import profile_table
from linkwise.operators.train import em_session, session_patterns
from linkwise.plans.spec import BlockingRule, Comparison, MatchSpec

COMPS = [Comparison("b", "exact"), Comparison("c", "exact", blank_as_null=True), Comparison("d", "exact")]
SPEC = MatchSpec((BlockingRule("l.a = r.a"),), tuple(COMPS))


def profiles(spark, gaps, n=300, seed=1):
    rng = random.Random(seed)
    blank = [None, ""] if gaps else []
    rows = [(i, rng.choice(["k"] * 4 + ["l", "m", None]), rng.choice(["x", "y"]), rng.choice(["p", "q", *blank]),
             rng.choice(["s", "t", "u", *blank[:1]])) for i in range(n)]
    return profile_table(spark.createDataFrame(rows, "unique_id long, a string, b string, c string, d string"), ["a", "b", "c", "d"])


@pytest.mark.parametrize("gaps, rule", [(False, "l.a = r.a"), (True, "l.a = r.a"), (True, "r.b = l.b AND l.a = r.a")])
def test_same_counts_as_the_pair_join(spark, gaps, rule):
    prof = profiles(spark, gaps)
    comps = [c for c in COMPS if f".{c.column} " not in rule + " "]
    joined = {tuple(r) for r in session_patterns(prof, rule, comps, SPEC).collect()}
    counted = X.exact_patterns(prof, BlockingRule(rule), comps)
    assert {tuple(r) for r in counted.itertuples(index=False)} == joined and len(joined) >= 3


def test_the_plan_has_no_join(spark):
    prof = profiles(spark, True)
    sets = X.column_sets(COMPS, {"c", "d"})
    assert len(sets) == 2 * 3 * 3
    assert "Join" not in X.set_totals(prof, BlockingRule("l.a = r.a"), COMPS, sets)._jdf.queryExecution().toString()


def test_only_plain_rules_and_exact_comparisons(spark, monkeypatch):
    assert X.is_plain(BlockingRule("l.a = r.a and r.b=l.b"))
    for sql in ("l.a = r.a AND length(l.b) > 2", "l.a = r.b", "l.a = l.a", "l.a = r.a OR l.b = r.b"):
        assert not X.is_plain(BlockingRule(sql))
    assert not X.possible(BlockingRule("l.a = r.a"), [Comparison("b", "name")])
    monkeypatch.setattr(X, "MAX_SETS", 8)
    assert X.possible(BlockingRule("l.a = r.a"), COMPS)
    assert X.exact_patterns(profiles(spark, True), BlockingRule("l.a = r.a"), COMPS) is None


def test_em_is_the_same_either_way(spark, monkeypatch):
    from linkwise.operators import train as T

    prof, u = profiles(spark, True), {c.column: T.floored(T.np.array([0.6, 0.4])) for c in COMPS}
    short, _ = em_session(prof, "l.a = r.a", COMPS, u, SPEC)
    monkeypatch.setattr(T, "possible", lambda *a: False)
    long, _ = em_session(prof, "l.a = r.a", COMPS, u, SPEC)
    assert short.iterations == long.iterations and abs(short.lam - long.lam) < 1e-12
    assert all(abs(short.m[c] - long.m[c]).max() < 1e-12 for c in short.m)


def test_a_block_of_a_third_of_all_records(spark):
    from pyspark.sql import functions as F

    big = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("a"),
                                      (F.col("id") % 1000).cast("string").alias("b"), F.lit(1).alias("n"))
    got = X.exact_patterns(big, BlockingRule("l.a = r.a"), [Comparison("b", "exact")])
    same = 1000 * 100 * 99 // 2
    assert {tuple(r) for r in got.itertuples(index=False)} == {(1, same), (0, 100_000 * 99_999 // 2 - same)}
