"""Patterns of one fuzzy comparison from its near pairs against the join of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwise.functions.similarity import character_marks
from linkwise.operators import near_patterns as P
from linkwise.operators import train as T
from linkwise.operators.blocking import candidate_pairs, profile_table, rule_pairs
from linkwise.operators.compare import compare
from linkwise.plans.spec import BlockingRule, Comparison, MatchSpec

OTHERS = [Comparison("k", "name"), Comparison("npi", "exact"), Comparison("zip", "postcode"), Comparison("phone", "exact", blank_as_null=True)]
RULES = (BlockingRule("l.npi = r.npi"), BlockingRule("l.k = r.k"))


def street(rng):
    text = f"{rng.randrange(100, 400)} {rng.choice(['oak', 'elm', 'lake', 'walnut'])} {rng.choice(['street', 'road'])}"
    if rng.random() < 0.3:
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "x", "é", "𝒳x", text[at:at + 1] * 2]) + text[at + 1:]
    return rng.choice([text] * 20 + ["", None, "7"])


def profiles(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice(["1", "2", *map(str, range(10, 150))]), street(rng),
             rng.choice(["12345", "12399", "19999", "22222", "12", "1", "", None]), rng.choice(["p", "q", "", None])) for i in range(n)]
    columns = ["k", "npi", "street", "zip", "phone"]
    return profile_table(spark.createDataFrame(rows, "unique_id long, k string, npi string, street string, zip string, phone string"), columns)


FUZZY = [Comparison("street", "levenshtein", (1, 2, 3)), Comparison("street", "jaro_winkler", (0.93, 0.96)),
         Comparison("street", "name"), Comparison("street", "levenshtein", (2,), blank_as_null=True)]


@pytest.mark.parametrize("fuzzy", FUZZY)
def test_same_counts_as_the_pair_join(spark, fuzzy):
    prof, comps = profiles(spark), [fuzzy, *OTHERS]
    pairs = compare(rule_pairs(prof, RULES[1], [c.column for c in comps], RULES[:1]), comps)
    joined = {tuple(r) for r in T.pattern_counts(pairs, comps).collect()}
    found = P.near_patterns(prof, RULES[1], comps, list(RULES[:1]))
    assert {tuple(int(x) for x in r) for r in found.itertuples(index=False)} == joined
    assert len({r[0] for r in joined}) == fuzzy.n_levels + 1 and len(joined) > 50


def test_marks_differ_by_two_bits_an_edit_at_most():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice("aab0 é𝒳") for _ in range(rng.randrange(1, 30)))
        at, new = rng.randrange(len(text)), rng.choice(["", "z", "a", "𝒳"])
        other, longer = text[:at] + new + text[at + 1:], text[:at] + "q" + text[at:]
        a, b, c = character_marks([text, other, longer])
        assert int(np.bitwise_count(a ^ b)) <= 2 and int(np.bitwise_count(a ^ c)) <= 1
    assert list(character_marks(["", "aa"])) [0] == 0


def block(spark, n):
    """One name of ``n`` records, whose streets are seldom near."""
    rng = random.Random(7)
    streets = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(14)) for _ in range(n)]
    rows = [(i, "n", str(i), streets[i if i % 10 else 0], str(10000 + i * 37 % 90000), str(i % 50)) for i in range(n)]
    return profile_table(spark.createDataFrame(rows, "unique_id long, k string, npi string, street string, zip string, phone string"),
                         ["k", "npi", "street", "zip", "phone"])


def test_a_session_forms_only_near_pairs(spark, monkeypatch):
    """A name shared by all records: the session's pairs are counted, not formed."""
    prof, n = block(spark, 600), 600
    comps = [Comparison("npi", "exact"), Comparison("k", "exact"), Comparison("street", "jaro_winkler", (0.95, 0.99)), Comparison("phone", "exact")]
    spec = MatchSpec((RULES[1],), tuple(comps))
    u = {c.column: T.floored(np.linspace(0.9, 0.1, c.n_levels)) for c in comps}
    long = T.expectation_maximisation(T.session_patterns(prof, RULES[1].sql, [comps[0], *comps[2:]], spec).toPandas(), [comps[0], *comps[2:]], u)
    formed = []

    def counting(pairs, comparisons):
        formed.append(pairs.count())
        return compare(pairs, comparisons)

    monkeypatch.setattr(T, "compare", counting)
    monkeypatch.setattr(P, "compare", counting)
    short, _ = T.em_session(prof, RULES[1].sql, comps, u, spec)
    assert formed[0] * 10 < n * (n - 1) // 2
    assert short.iterations == long.iterations and abs(short.lam - long.lam) < 1e-12
    assert all(abs(short.m[c] - long.m[c]).max() < 1e-12 for c in short.m)


def test_patterns_of_all_rules_form_only_near_pairs(spark, monkeypatch):
    prof, n = block(spark, 600), 600
    comps = [Comparison("npi", "exact"), Comparison("street", "levenshtein", (1, 2, 3)), Comparison("zip", "postcode")]
    spec, formed = MatchSpec(RULES, tuple(comps)), []
    every = compare(candidate_pairs(prof, spec, [c.column for c in comps]), comps).groupBy(*[c.gamma for c in comps]).agg(F.sum("pair_count"))

    def counting(pairs, comparisons):
        formed.append(pairs.count())
        return compare(pairs, comparisons)

    monkeypatch.setattr(P, "compare", counting)
    assert sorted(P.candidate_patterns(prof, spec, comps).collect()) == sorted(every.collect())
    assert sum(formed) * 10 < n * (n - 1) // 2
