"""Sinks: format-dispatching save (CSV, Parquet, JSON) and the report tables.

Output paths are directories of part files written in parallel; the format is
picked from the suffix.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwise.sources.reader import CSV_DIALECT

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".pq": "parquet"}


class OutputError(RuntimeError):
    """A sink could not be written."""


def save(df: DataFrame, path: str, statistics: DataFrame | None = None, mode: str = "overwrite", **options) -> None:
    """Write ``df`` by suffix (K1): CSV with header (K2), snappy Parquet (K3),
    JSON Lines records plus a metadata/statistics document (K4)."""
    fmt = FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if fmt is None:
        raise OutputError(f"Unsupported output format: {os.path.splitext(path)[1]}")
    try:
        if fmt == "csv":
            df.write.mode(mode).options(**(CSV_DIALECT | options)).csv(path)
        elif fmt == "parquet":
            df.write.mode(mode).options(compression="snappy", **options).parquet(path)
        else:
            df.write.mode(mode).options(**options).json(os.path.join(path, "records"))
            stamp = F.lit(_dt.datetime.now(_dt.timezone.utc).isoformat()).alias("generated_at")
            # counted from what was written, so the result is not computed twice
            written = df.sparkSession.read.json(os.path.join(path, "records"), schema="`_` string")
            meta = written.agg(F.count(F.lit(1)).alias("record_count")).select(stamp, "record_count")
            if statistics is not None:
                one = statistics.limit(1).select(F.lit(1).alias("_k"), F.struct(*statistics.columns).alias("statistics"))
                meta = meta.withColumn("_k", F.lit(1)).join(one, "_k", "left").drop("_k")
            meta.coalesce(1).write.mode(mode).json(os.path.join(path, "metadata"))
    except OutputError:
        raise
    except Exception as exc:
        raise OutputError(f"Failed to save output to {path}: {exc}") from exc


def save_report(results: DataFrame, statistics_long: DataFrame, summary: DataFrame, path: str,
                fmt: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """The three report tables (results, statistics, summary) as sibling
    outputs (K5)."""
    out = {}
    for name, frame in (("results", results), ("statistics", statistics_long), ("summary", summary)):
        target = os.path.join(path, f"{name}.{fmt}")
        save(frame, target, mode=mode)
        out[name] = target
    return out
