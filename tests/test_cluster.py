import random

from linkwise.operators.cluster import connected_components


def _union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rnd = random.Random(11)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(250)]
    edges += [(i, i + 1) for i in range(400, 460)]  # a long chain
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    want = _union_find(edges)
    assert got == want


def test_pipeline_clusters_sum_to_records(spark):
    from linkwise.plans.catalog import exact_results

    from .conftest import SF_SMALL

    res = exact_results(spark, SF_SMALL)
    sizes = res.groupBy("cluster_id").count().collect()
    assert sum(r["count"] for r in sizes) == res.count() == 180


def _task_rows(df):
    """Rows by partition, none empty left out."""
    from pyspark.sql import functions as F

    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_hot_centre_is_split(spark):
    """One node with all the leaves: same components, no task far above the others."""
    from pyspark.sql import functions as F

    from linkwise.operators import cluster as C

    n = 200_000
    edges = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).unionByName(
        spark.range(0, 1000).select((F.col("id") + n + 5).alias("src"), (F.col("id") + n + 6).alias("dst")))
    got = connected_components(edges, hot_size=1000)
    assert got.groupBy("component").count().orderBy("component").collect() == [(0, n + 1), (n + 5, 1001)]
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    hot = C.hot_groups(C.node_degrees(both), ["u"], "degree", 1000)
    assert hot.collect() == [(0, n // 1000)]
    mins = both.groupBy("u").agg(F.min("v").alias("m"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = _task_rows(C.join_groups(both, mins, ["u"], hot, ["v"], "inner"))
        assert rows[-1] <= 3 * rows[len(rows) // 2] and sum(rows) == n + 1000
        assert _task_rows(C.join_groups(both, mins, ["u"], None, ["v"], "inner"))[-1] >= n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_random_components_with_every_node_hot(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(120)] + [(0, i) for i in range(200, 260)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long"),
                                                                  hot_size=1).collect()}
    assert got == _union_find(edges)


def test_hot_profile_and_hot_cluster(spark):
    """A third of all records share one profile and most profiles share one cluster."""
    from linkwise.operators.blocking import profile_table
    from linkwise.operators.cluster import assign_clusters, with_primary

    rows = [(i, None if i % 3 == 0 else f"name{i % 7}", "x" if i % 3 == 0 else "") for i in range(900)]
    rows += [(10_000, "solo", "a"), (10_001, "solo", "b"), (10_002, None, None), (10_003, "", None), (10_004, None, "")]
    records = spark.createDataFrame(rows, "unique_id long, given_name string, family_name string").repartition(5)
    profiles = profile_table(records, ["given_name", "family_name"])
    reps = {(r.given_name, r.family_name): r.rep_id for r in profiles.collect()}
    named = [v for k, v in reps.items() if k[0] and k[0].startswith("name")]
    clusters = spark.createDataFrame([(v, min(named), 0.99) for v in named] + [(reps[None, "x"], reps[None, "x"], 0.97)],
                                     "rep_id long, cluster_rep long, cluster_match_probability double")
    plain = None
    for hot_size in (50, 10**6):
        out = with_primary(assign_clusters(records, profiles, clusters, ["given_name", "family_name"], hot_size))
        got = sorted((r.unique_id, r.cluster_id, r.cluster_size, r.match_probability, r.is_primary) for r in out.collect())
        assert len(got) == len(rows)
        plain = plain or got
        assert got == plain
    by_id = {r[0]: r for r in plain}
    assert by_id[3][1:4] == (0, 300, 0.97) and by_id[1][1:4] == (min(named), 600, 0.99)
    assert all(by_id[i][1:] == (i, 1, None, True) for i in range(10_000, 10_005))
    assert sum(r[4] for r in plain) == 2 + 5


def test_records_meet_profiles_by_key_alone(spark):
    from linkwise.plans.catalog import exact_results

    from .conftest import SF_SMALL

    plan = exact_results(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and not any("given_name" in j or "npi" in j for j in joins)
