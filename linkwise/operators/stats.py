"""Cluster statistics and report tables.

Sizes come from one ``groupBy(cluster_id)`` (partial aggregation), everything
else from that size table, which has one row per cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwise.functions.constants import SAMPLE_DISPLAY_COLUMNS


def cluster_sizes(results: DataFrame) -> DataFrame:
    return results.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))


def cluster_statistics(results: DataFrame) -> DataFrame:
    """One row: total_records, unique_clusters, duplicates_found,
    duplication_rate, largest_cluster_size, average_cluster_size (A11)."""
    s = cluster_sizes(results).agg(
        F.coalesce(F.sum("cluster_size"), F.lit(0)).cast("bigint").alias("total_records"),
        F.count(F.lit(1)).alias("unique_clusters"),
        F.max("cluster_size").alias("largest_cluster_size"),
        F.avg("cluster_size").alias("average_cluster_size"),
    )
    dup = F.col("total_records") - F.col("unique_clusters")
    return s.select(
        "total_records", "unique_clusters", dup.alias("duplicates_found"),
        F.when(F.col("total_records") > 0, dup / F.col("total_records")).otherwise(F.lit(0.0)).alias("duplication_rate"),
        "largest_cluster_size", "average_cluster_size",
    )


def clusters_by_size(results: DataFrame) -> DataFrame:
    """(cluster_size, n_clusters, total_records) ordered by size."""
    return cluster_sizes(results).groupBy("cluster_size").agg(F.count(F.lit(1)).alias("n_clusters")).withColumn(
        "total_records", F.col("cluster_size") * F.col("n_clusters")
    ).orderBy("cluster_size")


def statistics_long(results: DataFrame) -> DataFrame:
    """Statistics as rows (category, metric, value string)."""
    general = cluster_statistics(results)
    metrics = [c for c in general.columns]
    long = general.select(F.explode(F.array(*[
        F.struct(F.lit("General").alias("category"), F.lit(m).alias("metric"), F.col(m).cast("string").alias("value"))
        for m in metrics
    ])).alias("r")).select("r.*")
    sizes = clusters_by_size(results).select(
        F.lit("clusters_by_size").alias("category"), F.col("cluster_size").cast("string").alias("metric"),
        F.col("n_clusters").cast("string").alias("value"))
    return long.unionByName(sizes)


def summary_table(results: DataFrame) -> DataFrame:
    """Five rows (metric, value) with the rate as ``x.xx%``."""
    s = cluster_statistics(results)
    return s.select(F.explode(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("Total Records").alias("metric"), F.col("total_records").cast("string").alias("value")),
        F.struct(F.lit(2).alias("ord"), F.lit("Unique Clusters").alias("metric"), F.col("unique_clusters").cast("string").alias("value")),
        F.struct(F.lit(3).alias("ord"), F.lit("Duplicates Found").alias("metric"), F.col("duplicates_found").cast("string").alias("value")),
        F.struct(F.lit(4).alias("ord"), F.lit("Duplication Rate").alias("metric"), F.format_string("%.2f%%", F.col("duplication_rate") * 100).alias("value")),
        F.struct(F.lit(5).alias("ord"), F.lit("Largest Cluster").alias("metric"), F.coalesce(F.col("largest_cluster_size"), F.lit(0)).cast("string").alias("value")),
    )).alias("r")).select("r.ord", "r.metric", "r.value")


def size_histogram(results: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width histogram of cluster sizes (A15): (bin, lower, upper, n).

    The range is one small aggregate read back as two numbers; the largest
    size falls into the last bin."""
    sizes = cluster_sizes(results)
    lo, hi = sizes.agg(F.min("cluster_size"), F.max("cluster_size")).first()
    if lo is None:
        return sizes.select(F.lit(0).alias("bin"), F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper"),
                            F.lit(0).cast("bigint").alias("n_clusters")).limit(0)
    width = (hi - lo) / bins
    if hi == lo:
        b = F.lit(1)
    else:
        b = F.least(F.floor((F.col("cluster_size") - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins))
    counted = sizes.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_clusters"))
    return counted.select(
        "bin", (F.lit(float(lo)) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
        (F.lit(float(lo)) + F.col("bin") * F.lit(width)).alias("upper"), "n_clusters")


def sample_clusters(results: DataFrame, max_rows: int = 100) -> DataFrame:
    """First ``max_rows`` records of multi-record clusters, biggest first."""
    multi = results.where(F.col("cluster_size") > 1)
    ordered = multi.orderBy(F.desc("cluster_size"), "cluster_id", "unique_id").limit(max_rows)
    return ordered.select(*[c for c in SAMPLE_DISPLAY_COLUMNS if c in results.columns])
