"""Validation, quarantine and the prepared (normalized) record table.

All steps are projections and filters over one scan: legacy names are mapped
at plan time from ``df.columns``, rule messages are an ``array<string>`` column,
and the prepared table is a single ``select``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwise.functions import validate as V
from linkwise.functions.constants import (
    BATCH_REQUIRED_COLUMNS,
    LEGACY_FIELD_NAMES,
    MODEL_NULL_TOKENS,
)
from linkwise.functions.normalize import (
    normalize_address,
    normalize_name,
    normalize_phone,
    normalize_postal_code,
    normalize_state,
)

MODEL_FIELDS = [
    "npi", "group_npi", "group_name", "specialty", "first_name", "middle_name", "last_name",
    "address_type", "address_line_1", "address_line_2", "city", "state", "postal_code", "phone",
    "address_status", "phone_status",
]


class DataValidationError(ValueError):
    """The batch check found problems that fail the whole load."""


def content_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a row's values (null told apart from blank)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in (columns or df.columns)]
    return F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)


def with_unique_id(df: DataFrame, id_column: str | None = None, copies: int = 100_000) -> DataFrame:
    """Add a bigint ``unique_id``.

    With ``id_column`` the given key is used. Otherwise the id is the first 60 bits of
    SHA-256(content key, ordinal), the ordinal counting the copies of a row: the same rows get
    the same ids however files are split, shuffled or read again. Copies are alike, so they are counted
    (partial aggregation) and written out again by their count; more than ``copies`` of a
    row are written out by several tasks.
    """
    if id_column:
        return df.withColumn("unique_id", F.col(id_column).cast("bigint"))
    names = df.columns
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))

    def ordinals(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(start, end - 1)).alias("__ordinal")

    few = counted.where(F.col("__n") <= copies).select(*names, ordinals(F.lit(0).cast("bigint"), F.col("__n")))
    many = counted.where(F.col("__n") > copies).select(
        *names, "__n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(copies).cast("bigint"))).alias("__from"))
    ranges = many.repartition(*[F.col(c) for c in names], F.col("__from")).select(
        *names, ordinals(F.col("__from"), F.least("__n", F.col("__from") + copies)))
    numbered = few.unionByName(ranges)
    named = F.sha2(F.concat_ws(":", content_key(df, names), "__ordinal").cast("binary"), 256)
    uid = F.conv(F.substring(named, 1, 15), 16, 10).cast("bigint")
    return numbered.withColumn("unique_id", uid).drop("__ordinal")


def _source_column(columns: list[str], field: str) -> str | None:
    """Legacy name wins over the model name when both are present."""
    legacy = [old for old, new in LEGACY_FIELD_NAMES.items() if new == field]
    for name in legacy + [field]:
        if name in columns:
            return name
    return None


def model_columns(df: DataFrame) -> dict[str, Column | None]:
    """Model field -> input column (renamed, ``null``/``NULL`` -> null, string)."""
    out: dict[str, Column | None] = {}
    for field in MODEL_FIELDS:
        src = _source_column(df.columns, field)
        if src is None:
            out[field] = None
            continue
        c = F.col(src).cast("string")
        out[field] = F.when(c.isin(*MODEL_NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)
    return out


def to_model(df: DataFrame) -> DataFrame:
    """Rename legacy columns and clean null tokens (P1, P2); ids are kept."""
    model = model_columns(df)
    keep = [c for c in ("unique_id",) if c in df.columns]
    cols = [F.col(c) for c in keep]
    for field, c in model.items():
        cols.append((c if c is not None else F.lit(None).cast("string")).alias(field))
    return df.select(*cols)


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, whose expressions later filters and projections read as values.

    A filter on the error list is otherwise pushed below the projections that ``df`` consists of, and every
    rule then holds its own copy of the expressions behind its fields. Generated columns are not looked through.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def validate_rows(df: DataFrame) -> DataFrame:
    """Model fields plus ``errors array<string>`` (empty = valid row).

    The renamed / null-cleaned fields are projected once; the rules then read
    those columns by name, so each field expression is evaluated once per row
    instead of once per rule.
    """
    model = model_columns(df)
    keep = [F.col(c) for c in ("unique_id",) if c in df.columns]
    projected = computed_once(df.select(*keep, *[
        (c if c is not None else F.lit(None).cast("string")).alias(f) for f, c in model.items()
    ]))
    present = {f: (None if c is None else F.col(f)) for f, c in model.items()}
    checked = projected.withColumn("errors", V.row_errors(present))
    # enum defaults apply only when the column is absent
    return computed_once(checked.withColumns({
        field: V.enum_value(None if model[field] is None else F.col(field), default)
        for field, (_allowed, default) in V.ENUMS.items()
    }))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their error list)."""
    ok = F.size("errors") == 0
    return validated.where(ok).drop("errors"), validated.where(~ok)


def batch_check(df: DataFrame) -> DataFrame:
    """Fail-fast batch check as a one-column DataFrame of messages.

    Required columns come from ``df.columns`` at plan time; the counts are one
    aggregate over the scan.
    """
    missing = sorted(set(BATCH_REQUIRED_COLUMNS) - set(df.columns))
    msgs = []
    if missing:
        msgs.append(F.lit(f"Missing required columns: {', '.join(missing)}"))
    npi = F.col("npi").cast("string") if "npi" in df.columns else None
    aggs = [F.count(F.lit(1)).alias("n")]
    if npi is not None:
        aggs.append(F.count_if(npi.isNull() | ~npi.rlike(V.TEN_DIGITS)).alias("bad_npi"))
    else:
        aggs.append(F.lit(0).cast("bigint").alias("bad_npi"))
    counts = df.agg(*aggs)
    return counts.select(
        F.explode(F.filter(F.array(
            *msgs,
            F.when(F.col("n") == 0, F.lit("Input data is empty")),
            F.when(F.col("bad_npi") > 0, F.format_string("Found %d invalid NPI values", F.col("bad_npi"))),
        ), lambda m: m.isNotNull())).alias("message")
    )


def assert_batch_ok(df: DataFrame) -> None:
    """Raise ``DataValidationError`` with every batch message (one small action)."""
    msgs = [r["message"] for r in batch_check(df).collect()]
    if msgs:
        raise DataValidationError("Data validation failed: " + "; ".join(msgs))


def validate_schema(df: DataFrame, required_columns: list[str] | None = None,
                    column_types: dict[str, str] | None = None) -> DataFrame:
    """Missing columns and type differences as a DataFrame of messages."""
    spark = df.sparkSession
    msgs = []
    if required_columns:
        missing = sorted(set(required_columns) - set(df.columns))
        if missing:
            msgs.append(f"Missing required columns: {', '.join(missing)}")
    types = dict(df.dtypes)
    for column, expected in (column_types or {}).items():
        if column in types and types[column] != expected:
            msgs.append(f"Column '{column}' has type {types[column]}, expected {expected}")
    return spark.createDataFrame([(m,) for m in msgs], "message string")


def prepared_columns(df: DataFrame) -> list[Column]:
    """The 15 prepared columns over a validated model frame."""
    blank = F.lit("")
    return [
        F.col("unique_id"),
        F.col("npi"),
        F.coalesce(F.col("group_npi"), blank).alias("group_npi"),
        normalize_name("group_name").alias("group_name"),
        normalize_name("first_name").alias("given_name"),
        normalize_name("middle_name").alias("middle_name"),
        normalize_name("last_name").alias("family_name"),
        normalize_address("address_line_1").alias("street_address"),
        normalize_address("city").alias("city"),
        normalize_state(F.upper(F.col("state"))).alias("state"),
        normalize_postal_code("postal_code").alias("postal_code"),
        normalize_phone("phone").alias("phone"),
        F.coalesce(F.col("specialty"), blank).alias("specialty"),
        F.col("address_status"),
        F.col("phone_status"),
    ]


def prepare(raw: DataFrame, id_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw records -> (prepared table, quarantine) (C8 without profiling).

    ``raw`` may already carry ``unique_id``; otherwise it is added here.
    """
    if "unique_id" not in raw.columns:
        raw = with_unique_id(raw, id_column)
    valid, quarantine = split_valid(validate_rows(raw))
    return valid.select(*prepared_columns(valid)), quarantine
