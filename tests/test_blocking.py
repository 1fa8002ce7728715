from itertools import combinations

from pyspark.sql import functions as F

from linkwise.operators.blocking import profile_table, rule_pairs
from linkwise.plans.catalog import FUZZY_COLS, prepared

from .conftest import SF_SMALL


def _brute(records, key):
    rows = records.select("unique_id", *key).collect()
    n = 0
    for a, b in combinations(rows, 2):
        if all(a[k] is not None and a[k] == b[k] for k in key):
            n += 1
    return n


def test_profile_pairs_count_record_pairs(spark):
    rec = prepared(spark, SF_SMALL)
    prof = profile_table(rec, FUZZY_COLS)
    for rule, key in (("l.npi = r.npi", ["npi"]),
                      ("l.family_name = r.family_name AND l.given_name = r.given_name", ["family_name", "given_name"])):
        pairs = rule_pairs(prof, rule, [])
        assert pairs.agg(F.sum("pair_count")).first()[0] == _brute(rec, key)


def test_salting_keeps_the_same_pairs(spark):
    rec = prepared(spark, SF_SMALL)
    prof = profile_table(rec, FUZZY_COLS)
    rule = "l.family_name = r.family_name AND l.given_name = r.given_name"
    plain = {tuple(r) for r in rule_pairs(prof, rule, []).select("rep_id_l", "rep_id_r", "pair_count").collect()}
    salted = {tuple(r) for r in rule_pairs(prof, rule, [], salt_block_size=1).select(
        "rep_id_l", "rep_id_r", "pair_count").collect()}
    assert plain == salted and plain


def test_copies_collapse_into_one_profile(spark):
    rows = [(i, "1000000004", "john", "smith") for i in range(50)] + [(99, "1000000012", "mary", "jones")]
    df = spark.createDataFrame(rows, "unique_id long, npi string, given_name string, family_name string")
    prof = profile_table(df, ["npi", "given_name", "family_name"])
    assert prof.count() == 2
    pairs = rule_pairs(prof, "l.npi = r.npi", []).collect()
    assert len(pairs) == 1 and pairs[0]["pair_count"] == 50 * 49 // 2


def test_rule_without_key_is_refused(spark):
    rec = prepared(spark, SF_SMALL)
    prof = profile_table(rec, FUZZY_COLS)
    try:
        rule_pairs(prof, "l.npi <> r.npi", [])
        refused = False
    except ValueError:
        refused = True
    assert refused
