"""Row validation rules as boolean / error-message column expressions.

Each rule returns a ``Column`` holding an error message, or null when the row
passes. ``row_errors`` gathers them into one ``array<string>`` so a single
projection both validates and explains.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkwise.functions.constants import (
    ADDRESS_STATUS_VALUES,
    ADDRESS_TYPE_VALUES,
    DEFAULT_ADDRESS_STATUS,
    DEFAULT_ADDRESS_TYPE,
    DEFAULT_PHONE_STATUS,
    FIELD_LENGTHS,
    NPI_LUHN_PREFIX,
    PHONE_STATUS_VALUES,
)

# ``$`` in Java regex also matches before a final newline; ``\z`` does not.
TEN_DIGITS = r"^[0-9]{10}\z"
STATE_PATTERN = r"^[A-Z]{2}\z"
POSTAL_PATTERN = r"^[0-9]{5}(-[0-9]{4})?\z"
PHONE_PATTERN = r"^[0-9]{10,}\z"


def npi_format_ok(c: Column) -> Column:
    return c.rlike(TEN_DIGITS)


def npi_checksum_ok(c: Column) -> Column:
    """Luhn over prefix 80840 + the ten digits (false when not ten digits)."""
    return npi_format_ok(c) & F.call_function("luhn_check", F.concat(F.lit(NPI_LUHN_PREFIX), c))


def _msg(failed: Column, text: str) -> Column:
    return F.when(failed, F.lit(text))


def npi_errors(c: Column, field: str, required: bool) -> list[Column]:
    missing = c.isNull()
    out = []
    if required:
        out.append(_msg(missing, f"{field}: required"))
    out.append(_msg(~missing & ~npi_format_ok(c), f"{field}: must be exactly 10 digits"))
    out.append(_msg(~missing & npi_format_ok(c) & ~npi_checksum_ok(c), f"{field}: invalid checksum"))
    return out


def length_errors(c: Column, field: str) -> list[Column]:
    lo, hi = FIELD_LENGTHS[field]
    out = []
    if lo is not None:
        out.append(_msg(c.isNull() | (F.length(c) < lo), f"{field}: shorter than {lo}"))
    if hi is not None:
        out.append(_msg(F.length(c) > hi, f"{field}: longer than {hi}"))
    return out


def state_errors(c: Column) -> list[Column]:
    return [_msg(c.isNull() | ~F.upper(c).rlike(STATE_PATTERN), "state: must be two letters")]


def postal_errors(c: Column) -> list[Column]:
    return [_msg(c.isNull() | ~c.rlike(POSTAL_PATTERN), "postal_code: must be 5 or 5-4 digits")]


def phone_errors(c: Column) -> list[Column]:
    return [_msg(c.isNotNull() & ~c.rlike(PHONE_PATTERN), "phone: must be at least 10 digits")]


def enum_errors(c: Column | None, field: str, allowed: list[str]) -> list[Column]:
    """A present column must hold an allowed value (case-folded); null fails."""
    if c is None:
        return []
    return [_msg(c.isNull() | ~F.lower(c).isin(allowed), f"{field}: not one of {','.join(allowed)}")]


def enum_value(c: Column | None, default: str) -> Column:
    """Case-folded value; the default only when the column is absent."""
    return F.lit(default) if c is None else F.lower(c)


ENUMS = {
    "address_type": (ADDRESS_TYPE_VALUES, DEFAULT_ADDRESS_TYPE),
    "address_status": (ADDRESS_STATUS_VALUES, DEFAULT_ADDRESS_STATUS),
    "phone_status": (PHONE_STATUS_VALUES, DEFAULT_PHONE_STATUS),
}


def row_errors(model: dict[str, Column | None]) -> Column:
    """All rule messages for a row of model fields; empty array = valid.

    ``model`` maps each model field to its column, or ``None`` when the input
    has no such column.
    """
    def get(name: str) -> Column:
        c = model.get(name)
        return F.lit(None).cast("string") if c is None else c

    checks: list[Column] = []
    checks += npi_errors(get("npi"), "npi", required=True)
    checks += npi_errors(get("group_npi"), "group_npi", required=False)
    for field in FIELD_LENGTHS:
        checks += length_errors(get(field), field)
    checks += state_errors(get("state"))
    checks += postal_errors(get("postal_code"))
    checks += phone_errors(get("phone"))
    for field, (allowed, _default) in ENUMS.items():
        checks += enum_errors(model.get(field), field, allowed)
    return F.filter(F.array(*checks), lambda e: e.isNotNull())
