"""Corpus pipeline: toxicity, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``.

Null texts count as empty; rows with a null id pass every stage (they cannot be
linked to a group); an empty table passes through as an empty one. Columns beyond
those of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwise.llm import catalog, decontaminate, pii, simhash, toxicity
from linkwise.llm.common import table
from linkwise.session import drop_path, materialize, temporary_tables


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    score = toxicity.probability(toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.coalesce("text", F.lit(""))) < 0.5)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash group, once.

    The ids that go are anti-joined, so the join's smaller side grows with the
    duplicates alone; only rows whose id occurs again are brought together.
    """
    found = materialize(simhash.near_duplicates(docs, shingle=3, max_bits=2), "pipeline-groups")
    gone = found.where("component <> id").select(F.col("id").alias("gone_id")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    again = found.where("component = id").groupBy(F.col("id").alias("again_id")).agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("again_id")
    once = left.join(again, left["doc_id"] == again["again_id"], "left_anti")
    repeated = left.join(again, left["doc_id"] == again["again_id"], "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return catalog.packed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", keep_one_of_group),
    ("benchmark decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("best-fit packing", pack),
]

#: Learned scores and tokenizers have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way goes when its result is written, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    with temporary_tables(spark) as keep:
        before = None
        for name, stage in STAGES[:-1]:
            with temporary_tables(spark) as keep_stage:
                docs = keep_stage(materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-")))
            if before:
                drop_path(spark, before)
            before = docs.written_to
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
