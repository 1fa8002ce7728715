"""CSV records with line feeds inside quotes, read by many tasks.

Whether a line feed ends a record depends on how many quotes stand before it in the file. The file
is read as lines, in splits. A first pass counts the quotes of each split, a running sum by
file tells each split whether it begins inside quotes, and the second pass
puts the lines of a split together to records. What a split cuts off at either end are
fragments, two a split at most, which are joined in the order of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Splits up to which their states (a row of a path, an offset and a flag each) are broadcast.
BROADCAST_SPLITS = 500_000
SPLIT = ["file", "start"]
PARTS_DDL = "file string, start long, kind string, text string"
WHOLE, TAIL, MIDDLE, HEAD = "whole", "tail", "middle", "head"


def lines(spark: SparkSession, path) -> DataFrame:
    """(file, start, value): the lines of each split, in order within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def split_states(text: DataFrame) -> DataFrame:
    """(file, start, inside): whether each split begins inside quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    counts = text.groupBy(*SPLIT).agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    return counts.select(*SPLIT, (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and fragments of each split; the first record of a file is its header and is left out."""
    split, inside, first, held, out = None, False, False, [], []

    def close() -> None:
        """The open rest of a split."""
        if held:
            out.append((*split, MIDDLE if first and inside else HEAD, "\n".join(held)))
            held.clear()

    for batch in batches:
        for file, start, value, begins_inside in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, start) != split:
                close()
                split, inside, first, opened = (file, start), begins_inside, True, begins_inside
            held.append(value)
            opened ^= value.count('"') % 2 == 1
            if not opened:
                text = "\n".join(held)
                if first and inside:
                    out.append((*split, TAIL, text))
                elif not (first and start == 0):
                    out.append((*split, WHOLE, text))
                first = False
                held.clear()
        if out:
            yield _parts(out)
            out = []
    close()
    if out:
        yield _parts(out)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "start", "kind", "text"])


def quoted_records(spark: SparkSession, path) -> DataFrame | None:
    """(text): the records of CSV files without their headers, empty ones left out; None if there are
    too many splits."""
    text = lines(spark, path)
    states = split_states(text)
    if states.count() > BROADCAST_SPLITS:
        # a shuffle would undo the order of the lines
        return None
    parts = text.join(F.broadcast(states), SPLIT).select(*SPLIT, "value", "inside").mapInArrow(_put_together, PARTS_DDL)
    cut = parts.where(F.col("kind") != WHOLE)
    in_order = W.partitionBy("file").orderBy("start", F.when(F.col("kind") == HEAD, 1).otherwise(0))
    numbered = cut.withColumn("record", F.sum((F.col("kind") == HEAD).cast("int")).over(in_order)).withColumn(
        "place", F.row_number().over(in_order))
    pieces = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p"))
    joined = pieces.select(F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    rows = parts.where(F.col("kind") == WHOLE).select("text").unionByName(joined)
    return rows.select(F.regexp_replace("text", "\r$", "").alias("text")).where("text <> ''")
