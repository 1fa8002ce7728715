"""Steps whose cost must grow with the records, not with the pairs of a block."""

from pyspark.sql import functions as F

from linkwise.operators.cluster import profile_clusters
from linkwise.operators.prepare import prepare
from linkwise.plans import catalog
from linkwise.sources.fixture import provider_records


def customers(spark, folder, n):
    spark.range(n).select(F.col("id").alias("c_custkey")).write.mode("overwrite").parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_rules_hold_no_copies_of_the_expressions_behind_their_fields(spark, tmp_path):
    raw = provider_records(spark, customers(spark, tmp_path, 50))

    def computed(df):
        return df._jdf.queryExecution().optimizedPlan().toString().lower().count("cast(substr")

    assert computed(prepare(raw, "rid")[0]) <= 2 * computed(raw)


def test_clusters_come_from_the_pairs_that_can_reach_the_threshold(spark, tmp_path):
    d = customers(spark, tmp_path, 4000)
    every, (_, _, found) = catalog.scored_exact(spark, d), catalog.linked_exact(spark, d)
    link = F.col("match_probability") >= catalog.SCORE_THRESHOLD
    columns = ["rep_id_l", "rep_id_r", "pair_count", "match_key", "match_probability"]
    assert sorted(every.where(link).select(*columns).collect()) == sorted(found.where(link).select(*columns).collect())
    assert found.count() * 5 < every.count()
    assert profile_clusters(found, catalog.SCORE_THRESHOLD).count() == profile_clusters(every, catalog.SCORE_THRESHOLD).count() > 700


def test_tasks_of_a_join_follow_its_pairs(spark, monkeypatch):
    from linkwise.operators import blocking as B

    rows = [(i, 1 + i % 2, "a" if i < 300 else f"b{i % 9}", "" if i % 3 else "1234567890") for i in range(600)]
    profiles = spark.createDataFrame([*rows, (600, 1, None, "1234567890")], "rep_id bigint, n bigint, x string, phone string")
    rule = "l.x = r.x AND length(l.phone) >= 10"
    plain = B.rule_pairs(profiles, rule, ["phone"])
    monkeypatch.setattr(B, "PAIRS_PER_SALT", 500)
    monkeypatch.setattr(B, "PAIRS_PER_TASK", 200)
    hot, n_hot, pairs = B.block_work(profiles, B.BlockingRule(rule), ["x"], 50_000)
    assert n_hot == 10 - 9 + sum(r["_ns"] > 1 for r in hot.where("x <> 'a'").collect()) and pairs == (100 * 300 + sum(
        len([1 for y in rows if y[2] == f"b{k}"]) * len([1 for y in rows if y[2] == f"b{k}" and y[3]]) for k in range(9))) / 2
    split = B.rule_pairs(profiles, rule, ["phone"])
    assert sorted(split.collect()) == sorted(plain.collect())
    assert split.rdd.getNumPartitions() == -(-int(pairs) // 200)


def test_pairs_of_a_names_block_stay_out_of_python(spark, tmp_path):
    """the names rule makes given names equal, so its pairs, nearly all there are, need no similarity of them."""
    found = catalog.queries()["j14_levels"](spark, customers(spark, tmp_path, 200))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("jaro_winkler_udf(") == 2 and len(catalog.FUZZY.blocking_rules) == 3
