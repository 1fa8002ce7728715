"""Shared small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside operators; it sorts after every id.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, so that no other column can clash; null text is empty,
    a null id is ``NULL_ID`` until ``out_id`` turns it back."""
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def out_id(name: str = "doc_id"):
    return F.when(F.col("id") != F.lit(NULL_ID), F.col("id")).alias(name)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total characters of a text column: one scan, used to size partitions."""
    row = docs.agg(F.sum(F.length(docs[text_col])).alias("n")).collect()[0]
    return int(row["n"] or 0)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def crc_fold(id_col, folds: int = 5):
    """crc32 of the id's decimal text modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(folds)
