"""Connected components and cluster assignment.

Components use the alternating large-star / small-star algorithm (Kiveris et
al. 2014): every round is two ``groupBy`` + join passes over the edge list, and
the edge list is checkpointed to the shared checkpoint folder each round so
lineage stays short and a lost executor re-reads files. It ends when the
edges form stars around each component's smallest node. Joins on a centre, a profile or a
cluster that many rows share are split by salts (``join_groups``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwise.session import ensure_checkpoint_dir, materialize

#: Rows of one key that a task joins at most.
HOT_SIZE = 100_000
#: Bytes up to which a table of hot keys is broadcast.
HOT_BYTES = 16_000_000


def _normalize(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v, self-loops and repeats removed."""
    return edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).where(F.col("u") != F.col("v")).distinct()


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], hot: DataFrame | None, spread_by: list[str],
                how: str = "left") -> DataFrame:
    """Rows with the columns of their group (one row per key in ``groups``).

    ``hot`` (keys, ``_salts``) names the groups that many rows belong to: their rows go to as many tasks,
    by a hash of ``spread_by``, and the group's row is repeated for each. None: no group is hot.
    """
    if hot is None:
        return rows.join(groups, keys, how)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")).drop("_salts")
    repeated = groups.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1))).drop("_salts")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def hot_groups(sizes: DataFrame, keys: list[str], size_column: str, limit: int) -> DataFrame | None:
    """(keys, ``_salts``) of groups of more than ``limit`` rows, None if there is none.

    There are at most rows / ``limit`` of them; the table is broadcast up to ``HOT_BYTES``.
    """
    hot = sizes.where(F.col(size_column) > limit).select(*keys, F.ceil(F.col(size_column) / limit).cast("int").alias("_salts"))
    n = hot.count()
    if not n:
        return None
    return F.broadcast(hot) if n * 16 * (len(keys) + 1) <= HOT_BYTES else hot


def _large_star(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = both.where(F.col("v") > F.col("u"))
    return _normalize(join_groups(up, mins, ["u"], hot, ["v"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    mins = edges.groupBy("u").agg(F.min("v").alias("m"))
    leaves = join_groups(edges, mins, ["u"], hot, ["v"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _normalize(leaves.unionByName(mins.select("u", F.col("m").alias("v"))))


def node_degrees(edges: DataFrame) -> DataFrame:
    """(u, down, degree): edges of each node to smaller ones and all its edges."""
    return edges.select("u", F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("down"))).groupBy("u").agg(
        F.sum("down").alias("down"), F.count(F.lit(1)).alias("degree"))


def _state(edges: DataFrame, limit: int) -> tuple[bool, bool]:
    """(the edges are stars around smallest nodes, some node has more than ``limit`` edges), from one aggregate."""
    inner = (F.col("down") > 1) | ((F.col("down") > 0) & (F.col("degree") > F.col("down")))
    row = node_degrees(edges).agg(F.count_if(inner).alias("inner"), F.max("degree").alias("most")).collect()[0]
    return row["inner"] == 0, (row["most"] or 0) > limit


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", hot_size: int = HOT_SIZE) -> DataFrame:
    """(node, component) for every node on an edge; component = smallest node.

    Rounds go on until the edges are stars; each round brings every node closer
    to its component's smallest one, so the loop ends for any chain length. A node of more than
    ``hot_size`` edges is worked on as salted sub-centres.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = _normalize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))).checkpoint(eager=True)
    stars, hot = _state(e, hot_size)
    while not stars:
        e = _large_star(e, _hot_nodes(e, hot, hot_size))
        if hot:
            # its centres differ from the ones before, so they are looked for again
            e = e.checkpoint(eager=True)
            hot = _state(e, hot_size)[1]
        e = _small_star(e, _hot_nodes(e, hot, hot_size)).checkpoint(eager=True)
        stars, hot = _state(e, hot_size)
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(centres)


def _hot_nodes(edges: DataFrame, hot: bool, limit: int) -> DataFrame | None:
    return hot_groups(node_degrees(edges), ["u"], "degree", limit) if hot else None


def profile_clusters(scored: DataFrame, threshold: float) -> DataFrame:
    """Per linked profile: ``rep_id`` -> ``cluster_rep`` and its best in-cluster
    probability.

    Profiles joined to others take their component's smallest id; a profile
    linked only to its own copies takes its own ``rep_id``.
    """
    linked = scored.where(F.col("match_probability") >= F.lit(float(threshold)))
    edges = linked.where(F.col("rep_id_l") != F.col("rep_id_r")).select(
        F.col("rep_id_l").alias("src"), F.col("rep_id_r").alias("dst"))
    comp = connected_components(edges).select(F.col("node").alias("rep_id"), "component")
    ends = linked.select(F.col("rep_id_l").alias("rep_id"), "match_probability").unionByName(
        linked.select(F.col("rep_id_r").alias("rep_id"), "match_probability"))
    best = ends.groupBy("rep_id").agg(F.max("match_probability").alias("cluster_match_probability"))
    return best.join(comp, "rep_id", "left").select(
        "rep_id", F.coalesce("component", "rep_id").alias("cluster_rep"), "cluster_match_probability")


def profile_key(columns: list[str]) -> list[Column]:
    """128 bits that stand for a record's profile, nulls told from blanks."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "_key1"), (2, "_key2"))]


def linked_profiles(profiles: DataFrame, clusters: DataFrame, profile_columns: list[str], hot_size: int = HOT_SIZE) -> DataFrame:
    """Linked profiles by key with their cluster, its probability and its number of records.

    Cluster sizes (W1) are sums of the profiles' counts, so no record is counted again.
    """
    sized = profiles.select("rep_id", "n", *profile_key(profile_columns)).join(clusters, "rep_id")
    sizes = sized.groupBy("cluster_rep").agg(F.sum("n").alias("cluster_size"), F.count(F.lit(1)).alias("_profiles"))
    hot = hot_groups(sizes, ["cluster_rep"], "_profiles", hot_size)
    return join_groups(sized, sizes.drop("_profiles"), ["cluster_rep"], hot, ["rep_id"], "inner").drop("rep_id")


def assign_clusters(records: DataFrame, profiles: DataFrame, clusters: DataFrame,
                    profile_columns: list[str], hot_size: int = HOT_SIZE) -> DataFrame:
    """Every record with ``cluster_id``, ``match_probability`` and ``cluster_size`` (J8, W1, W3); unlinked records are
    their own cluster.

    Records meet their profile through its 128-bit key. A profile of more than ``hot_size``
    records, as its count says, is split among tasks.
    """
    linked = materialize(linked_profiles(profiles, clusters, profile_columns, hot_size), "linked-profiles")
    keys = ["_key1", "_key2"]
    hot = hot_groups(linked, keys, "n", hot_size)
    out = join_groups(records.select("*", *profile_key(profile_columns)), linked.drop("n"), keys, hot, ["unique_id"])
    return out.withColumns({"cluster_id": F.coalesce("cluster_rep", "unique_id"),
                            "cluster_size": F.coalesce("cluster_size", F.lit(1).cast("bigint"))}).withColumnRenamed(
        "cluster_match_probability", "match_probability").drop("cluster_rep", *keys)


def with_primary(results: DataFrame) -> DataFrame:
    """``is_primary`` (W2): per cluster the most complete record, verified
    address and phone first, then the smallest id. Found with a ``min`` over a
    struct per cluster of several records (partial aggregation) and joined back by the record's id, so
    the records of a huge cluster never meet."""
    fields = [c for c in ("npi", "group_npi", "group_name", "given_name", "middle_name", "family_name",
                          "street_address", "city", "state", "postal_code", "phone", "specialty")
              if c in results.columns]
    filled = sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in fields), F.lit(0))
    verified = sum((F.when(F.col(c) == "verified", 1).otherwise(0)
                    for c in ("address_status", "phone_status") if c in results.columns), F.lit(0))
    key = F.struct((-filled).alias("a"), (-verified).alias("b"), F.col("unique_id").alias("c"))
    best = results.where("cluster_size > 1").groupBy("cluster_id").agg(F.min(key).alias("best")).select(
        F.col("best.c").alias("unique_id"), F.lit(True).alias("_first"))
    out = results.join(best, "unique_id", "left")
    return out.withColumn("is_primary", (F.col("cluster_size") == 1) | F.col("_first").isNotNull()).drop("_first")
