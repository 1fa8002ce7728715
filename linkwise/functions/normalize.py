"""Normalization as Spark column expressions (JVM-side, whole-stage codegen).

Every function takes a ``Column`` (or column name) and returns a ``Column``;
nothing leaves the JVM. ``normalize(df, {column: kind})`` applies several at
once in a single projection.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwise.functions.constants import ADDRESS_ABBREVIATIONS, NAME_ABBREVIATIONS, STATE_CODES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def _strip(c: Column) -> Column:
    # ``trim`` only removes ' '; strip every kind of whitespace at both ends
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _expand_words(c: Column, mapping: dict[str, str]) -> Column:
    """lower -> non-alphanumerics to space -> whole-word lookup -> collapse.

    After the cleanup only ``[a-z0-9]`` runs separated by whitespace remain, so a
    whole-word regex replacement equals a per-token map lookup.
    """
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")
    text = _strip(F.regexp_replace(text, r"\s+", " "))
    lookup = _literal_map(mapping)
    tokens = F.transform(F.split(text, " "), lambda t: F.coalesce(F.try_element_at(lookup, t), t))
    return F.array_join(tokens, " ")


def normalize_name(c) -> Column:
    """null/"" -> ""; lower; punctuation -> space; title/suffix words expanded."""
    return _expand_words(_col(c), NAME_ABBREVIATIONS)


def normalize_address(c, number_words: bool = False) -> Column:
    """As ``normalize_name`` with street, unit and direction words.

    ``number_words=True`` first turns English number words into digits
    (see ``linkwise.functions.numbers``); it is off by default.
    """
    c = _col(c)
    if number_words:
        from linkwise.functions.numbers import words_to_digits

        c = words_to_digits(F.lower(c))
    return _expand_words(c, ADDRESS_ABBREVIATIONS)


def normalize_phone(c) -> Column:
    """Digits only; null -> ""."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[^0-9]", "")


def normalize_postal_code(c) -> Column:
    """Digits only, first five; null -> ""."""
    return F.substring(normalize_phone(c), 1, 5)


def normalize_state(c) -> Column:
    """Full state name -> code; anything else upper-cased as is; null -> ""."""
    key = _strip(F.lower(F.coalesce(_col(c), F.lit(""))))
    return F.upper(F.coalesce(F.try_element_at(_literal_map(STATE_CODES), key), key))


NORMALIZERS = {
    "name": normalize_name,
    "address": normalize_address,
    "phone": normalize_phone,
    "postal_code": normalize_postal_code,
    "state": normalize_state,
}


def normalize_field(c, field_type: str) -> Column:
    """Dispatch on the field type; unknown types raise ``ValueError``."""
    fn = NORMALIZERS.get(field_type)
    if fn is None:
        raise ValueError(f"Unknown field type: {field_type}")
    return fn(c)


def normalize(df: DataFrame, kinds: dict[str, str], suffix: str = "") -> DataFrame:
    """Normalize several columns in one projection.

    ``kinds`` maps column -> field type; with ``suffix`` the results are added
    as ``<column><suffix>``, otherwise the columns are replaced.
    """
    return df.withColumns({f"{name}{suffix}": normalize_field(name, kind) for name, kind in kinds.items()})
