"""Sources: format-dispatching load, CSV / JSON / Parquet scans, multi-file load.

All columns come back as strings so every format behaves alike; Spark keeps
column pruning and filter pushdown on the scan.
"""

from __future__ import annotations

import os
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwise.functions.constants import CSV_NULL_TOKENS
from linkwise.sources.quoted import quoted_records

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".pq": "parquet"}


#: Options of one format's reader.
OWN_OPTIONS = {"csv": {"multi_line"}, "json": {"lines"}, "parquet": {"columns"}}


class DataLoadError(RuntimeError):
    """A source could not be read."""


def _suffix(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def as_strings(df: DataFrame) -> DataFrame:
    """Cast every column to string in one projection."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def null_tokens(df: DataFrame, tokens=CSV_NULL_TOKENS) -> DataFrame:
    """Turn the NA tokens into null in every string column (one projection)."""
    return df.select(*[
        F.when(F.col(c).isin(*tokens), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
        for c in df.columns
    ])


#: One dialect on both sides: quotes doubled inside quotes, blanks kept.
CSV_DIALECT = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}
SURPLUS = "__surplus"


def is_split(spark: SparkSession, path) -> bool:
    """Whether some file is larger than one split (sizes alone are looked at)."""
    files = spark.read.format("binaryFile").load(path).agg(F.max("length").alias("n")).collect()[0]["n"] or 0
    return files > spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def read_csv(spark: SparkSession, path, multi_line: bool = True, **options) -> DataFrame:
    """Header CSV, all strings, the NA token list -> null.

    Quoted fields may hold commas, doubled quotes and line feeds. A row with more
    fields than the header fails the read with the row's first field in the message; missing
    fields are null. Files larger than a split are put together from lines by many tasks (``quoted``),
    smaller ones are read whole. ``multi_line=False`` is for files without line feeds inside fields.
    """
    opts = CSV_DIALECT | {"multiLine": str(multi_line).lower(), "mode": "PERMISSIVE", "inferSchema": "false"}
    opts.update({k: str(v) for k, v in options.items()})
    names = spark.read.options(**opts).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, SURPLUS]])
    # other dialects and more splits than can be told apart are read whole, a task a file
    splits = multi_line and opts["quote"] == opts["escape"] == '"' and is_split(spark, path)
    records = quoted_records(spark, path) if splits else None
    if records is None:
        rows = spark.read.options(**opts).schema(schema).csv(path)
    else:
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)
        rows = records.select(F.from_csv("text", F.lit(ddl), opts | {"header": "false"}).alias("r")).select("r.*")
    error = F.raise_error(F.concat(F.lit("CSV row has more fields than the header: "),
                                   F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))))
    whole = F.when(F.col(SURPLUS).isNotNull(), error.cast("boolean")).otherwise(F.lit(True))
    return null_tokens(rows.where(whole).drop(SURPLUS))


def read_json(spark: SparkSession, path, lines: bool = False, **options) -> DataFrame:
    """A JSON array of records (or JSON Lines with ``lines=True``), all strings (S3)."""
    opts = {"multiLine": str(not lines).lower(), "primitivesAsString": "true"}
    opts.update({k: str(v) for k, v in options.items()})
    return spark.read.options(**opts).json(path)


def read_parquet(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """Parquet cast to strings; ``columns`` selects (and prunes the scan)."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if columns:
        df = df.select(*columns)
    return as_strings(df)


@contextmanager
def load_errors(path: str):
    """Every failure of Spark while a source is opened becomes a ``DataLoadError``."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise DataLoadError(f"File not found: {path}") from exc
        raise DataLoadError(f"Failed to load file {path}: {exc}") from exc


def format_of(path: str) -> str:
    fmt = FORMATS.get(_suffix(path))
    if fmt is None:
        raise DataLoadError(f"Unsupported file format: {_suffix(path)}. Supported formats: {', '.join(FORMATS)}")
    return fmt


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pick the reader by file suffix."""
    fmt = format_of(path)
    with load_errors(path):
        if fmt == "csv":
            return read_csv(spark, path, **options)
        if fmt == "json":
            return read_json(spark, path, **options)
        return read_parquet(spark, path, **options)


def options_for(fmt: str, options: dict) -> dict:
    """The options that a format knows: its own ones, and for text formats all that no other one owns."""
    own = OWN_OPTIONS[fmt]
    others = {k for f, names in OWN_OPTIONS.items() if f != fmt for k in names}
    return {k: v for k, v in options.items() if k in own or (fmt != "parquet" and k not in others)}


def load_multiple(spark: SparkSession, paths: list[str], concat: bool = True, **options):
    """Several files; concatenated by column name with missing columns null.

    Every file is read as ``load`` reads it alone and every failure is a ``DataLoadError``; an option goes to
    the formats that know it. Parquet files are grouped by the schema of their footers: files of one
    schema share a scan, each group is cast to strings on its own, so types and columns may differ.
    """
    if not concat:
        return [load(spark, p, **options_for(format_of(p), options)) for p in paths]
    if not paths:
        raise DataLoadError("No files to load")
    frames, scans = [], {}
    for path in paths:
        fmt = format_of(path)
        if fmt != "parquet":
            frames.append(load(spark, path, **options_for(fmt, options)))
            continue
        with load_errors(path):
            scans.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    for some in scans.values():
        with load_errors(", ".join(some)):
            frames.append(read_parquet(spark, some, **options_for("parquet", options)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
