import numpy as np
import pandas as pd

from linkwise.operators.train import expectation_maximisation, sampling_plan, start_m
from linkwise.plans.spec import Comparison


def _synthetic(seed=3, n=20000, lam=0.1):
    rng = np.random.default_rng(seed)
    comps = [Comparison("a", "exact"), Comparison("b", "levenshtein", (1, 2)), Comparison("c", "exact")]
    m = {"a": np.array([0.1, 0.9]), "b": np.array([0.05, 0.05, 0.1, 0.8]), "c": np.array([0.2, 0.8])}
    u = {"a": np.array([0.95, 0.05]), "b": np.array([0.85, 0.1, 0.04, 0.01]), "c": np.array([0.7, 0.3])}
    match = rng.random(n) < lam
    rows = {}
    for c in comps:
        p_m, p_u = m[c.column], u[c.column]
        g = np.where(match, rng.choice(len(p_m), n, p=p_m), rng.choice(len(p_u), n, p=p_u))
        g[rng.random(n) < 0.05] = -1
        rows[c.gamma] = g
    df = pd.DataFrame(rows)
    pats = df.groupby(list(df.columns)).size().rename("pair_count").reset_index()
    return comps, m, u, pats


def test_em_recovers_parameters_and_sums_to_one():
    comps, m, u, pats = _synthetic()
    res = expectation_maximisation(pats, comps, u, max_iterations=200, convergence=1e-7, lam=0.5)
    assert abs(res.lam - 0.1) < 0.02
    for c in comps:
        assert abs(res.m[c.column].sum() - 1) < 1e-9
        assert np.max(np.abs(res.m[c.column] - m[c.column])) < 0.06


def test_em_likelihood_never_falls():
    comps, m, u, pats = _synthetic(seed=5)
    res = expectation_maximisation(pats, comps, u, max_iterations=50, convergence=0.0, lam=0.3,
                                   m={c.column: start_m(c) for c in comps})
    h = res.history
    assert all(b >= a - 1e-6 for a, b in zip(h, h[1:]))


def test_sampling_plan_bounds_pairs():
    assert sampling_plan(100, 10_000) == (1.0, 1)
    frac, buckets = sampling_plan(1_000_000, 50_000)
    kept = frac * 1_000_000
    assert abs(kept * kept / (2 * buckets) - 50_000) / 50_000 < 0.01
