import random

import duckdb
import pytest

import numpy as np
import pyarrow as pa

from linkwise.functions import similarity as S
from linkwise.functions.similarity import jaro_winkler

GOLDEN = [
    ("martha", "marhta", 0.944444, 0.961111),
    ("dixon", "dicksonx", 0.766667, 0.813333),
    ("smith", "smyth", 0.866667, 0.893333),
    ("abcdefgh", "abcdzzzz", 0.666667, 0.666667),
    ("a", "", 0.0, 0.0),
    ("", "", 0.0, 0.0),
]


@pytest.mark.parametrize("a,b,j,jw", GOLDEN)
def test_golden(a, b, j, jw):
    assert round(plain_jaro(a, b), 6) == j
    assert round(jaro_winkler(a, b), 6) == jw


def test_matches_duckdb_on_random_pairs():
    rnd = random.Random(7)
    alphabet = "abcdefg hij"
    pairs = [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 10))),
              "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 10)))) for _ in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE p(a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs)
    for a, b, d in con.execute("SELECT a, b, jaro_winkler_similarity(a, b) FROM p").fetchall():
        assert abs(jaro_winkler(a, b) - d) < 1e-9, (a, b)


def test_udf_in_spark(spark):
    from pyspark.sql import functions as F

    from linkwise.functions.similarity import jaro_winkler_similarity

    df = spark.createDataFrame([(a, b) for a, b, _, _ in GOLDEN] + [(None, "x")], "a string, b string")
    got = [r[0] for r in df.select(jaro_winkler_similarity(F.col("a"), F.col("b"))).collect()]
    assert [None if g is None else round(g, 6) for g in got] == [jw for *_, jw in GOLDEN] + [None]


def random_values(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("ABCDE é") for _ in range(rnd.randint(0, 9))) for _ in range(n)]


def test_bound_is_never_below_the_similarity(spark):
    from pyspark.sql import functions as F

    from linkwise.functions.similarity import jaro_winkler_bound

    rows = [(a, b) for a, b in zip(random_values(4000, 1), random_values(4000, 2)) if a != b]
    got = spark.createDataFrame(rows, "l string, r string").select("l", "r", jaro_winkler_bound(F.col("l"), F.col("r")).alias("b"))
    below = [(r.l, r.r, r.b, jaro_winkler(r.l, r.r)) for r in got.collect() if r.b < jaro_winkler(r.l, r.r) - 1e-12]
    assert not below


def plain_jaro(a, b):
    """The definition, character by character."""
    if not a or not b:
        return 0.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    free, hits = [True] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                hits.append(ch)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if not free[j]]
    moved = sum(x != y for x, y in zip(hits, other)) // 2
    return (len(hits) / len(a) + len(hits) / len(b) + (len(hits) - moved) / len(hits)) / 3.0


def plain(a, b):
    sim = plain_jaro(a, b)
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return sim + same * 0.1 * (1.0 - sim) if sim > 0.7 else sim


def test_arrays_give_the_definition_s_values(monkeypatch):
    values = random_values(60, 5) + ["", "A" * 70, "A" * 69 + "B", "😀é", "é😀"]
    l, r = (x.ravel() for x in np.meshgrid(np.arange(len(values)), np.arange(len(values))))
    expected = [plain(values[i], values[j]) for i, j in zip(l, r)]
    assert S.jaro_winkler_pairs(values, values, l, r).tolist() == expected
    monkeypatch.setattr(S, "CELLS", 64)
    assert S.jaro_winkler_pairs(values, values, l, r).tolist() == expected


def test_batch_scores_each_distinct_pair_once(monkeypatch):
    calls = []
    real = S.jaro_winkler_pairs
    monkeypatch.setattr(S, "jaro_winkler_pairs", lambda *a: calls.append(len(a[2])) or real(*a))
    left, right = pa.array(["JON", "JON", None, "ANN", "JON"] * 1000), pa.array(["JOHN", "JOHN", "X", None, "JAN"] * 1000)
    got = S.jaro_winkler_batch(left, right).to_pylist()
    assert calls == [2] and got[:5] == [plain("JON", "JOHN")] * 2 + [None, None, plain("JON", "JAN")]
    assert S.jaro_winkler_batch(pa.array([None], pa.string()), pa.array(["a"])).to_pylist() == [None]


def test_levels_with_bound_and_equal_values(spark):
    from linkwise.operators.compare import compare
    from linkwise.plans.spec import Comparison

    a, b = random_values(40, 3), random_values(40, 4)
    rows = [(i, a[i % 40], b[i % 40 if i % 3 else 0], a[(i + i % 2) % 40], a[i % 40]) for i in range(2000)]
    rows += [(-1, None, "X", None, None), (-2, "JOHN", "JOHN", "JON", "JOHN")]
    pairs = spark.createDataFrame(rows, "id int, x_l string, x_r string, y_l string, y_r string").repartition(4)
    comps = [Comparison("x", "jaro_winkler"), Comparison("y", "name")]

    def level(c, l, r):
        if l is None or r is None:
            return -1
        if l == r:
            return c.n_levels - 1
        cuts = [cut for _, cut in c.similarity_levels()]
        return max([len(cuts) - i for i, cut in enumerate(cuts) if jaro_winkler(l, r) >= cut], default=0)

    got = {r.id: (r.gamma_x, r.gamma_y) for r in compare(pairs, comps).collect()}
    assert got == {r[0]: (level(comps[0], r[1], r[2]), level(comps[1], r[3], r[4])) for r in rows}



def test_short_values_go_by_words(monkeypatch):
    values = random_values(80, 9) + ["", "A" * 63, "A" * 62 + "B", "BA" * 31, "😀é", "é😀"]
    l, r = (x.ravel() for x in np.meshgrid(np.arange(len(values)), np.arange(len(values))))
    monkeypatch.setattr(S, "jaro_winkler_matrix", None)
    assert S.jaro_winkler_pairs(values, values, l, r).tolist() == [plain(values[i], values[j]) for i, j in zip(l, r)]


def test_candidates_compare_as_their_pairs_do(spark):
    """Numbers worked out once a value, and no comparison of a rule's key columns, give the levels of the plain way."""
    import random

    from linkwise.operators.blocking import candidate_pairs, profile_table
    from linkwise.operators.compare import compare, compare_candidates
    from linkwise.plans.spec import BlockingRule, Comparison, MatchSpec

    rng = random.Random(7)
    streets = ["12 oak road", "12 oak rd", "112 oak road", "12 ook raod", "21 élm 𝒳 lane", "21 élm 𝒴 lane", "21 elm lane", "7", "", None]
    zips = ["12345", "12399", "12", "12é45", "12é99", "1", "é", "22222", "", None]
    rows = [(i, rng.choice(["ann", "anna", "bob", "bobby", "dwayne", "duane", "", None]), rng.choice(["a", "b", None]), rng.choice(streets), rng.choice(zips),
             rng.choice(["p", "q", "", None])) for i in range(400)]
    columns = ["name", "family", "street", "zip", "phone"]
    prof = profile_table(spark.createDataFrame(rows, "unique_id long, " + ", ".join(f"{c} string" for c in columns)), columns)
    rules = (BlockingRule("l.phone = r.phone"), BlockingRule("l.family = r.family AND l.name = r.name"), BlockingRule("l.family = r.family"))
    for blank in (False, True):
        comps = [Comparison("name", "name", blank_as_null=blank), Comparison("street", "levenshtein", (1, 3), blank_as_null=blank),
                 Comparison("zip", "postcode", blank_as_null=blank), Comparison("phone", "exact", blank_as_null=blank)]
        spec = MatchSpec(rules, tuple(comps))
        names = ["rep_id_l", "rep_id_r", "pair_count", "match_key", *[c.gamma for c in comps]]
        plain = compare(candidate_pairs(prof, spec, columns), comps)
        found = compare_candidates(prof, spec, comps)
        assert found.columns == names
        assert sorted(found.collect()) == sorted(plain.select(*names).collect())
        for c in comps:
            assert {r[0] for r in found.select(c.gamma).distinct().collect()} == set(range(-1, c.n_levels))
