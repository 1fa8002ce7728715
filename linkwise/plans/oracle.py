"""DuckDB SQL text that recomputes the engine's results independently.

Used only for the correctness check: each builder returns SQL over the raw
tables (``customer`` etc. registered as views). The Spark side never runs it.
"""

from __future__ import annotations

from linkwise.functions.constants import (
    ADDRESS_ABBREVIATIONS,
    NAME_ABBREVIATIONS,
    STATE_CODES,
)
from linkwise.plans.spec import BlockingRule, Comparison
from linkwise.sources.fixture import odd_view_sql, provider_view_sql


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(x: str, mapping: dict[str, str]) -> str:
    t = f"lower(coalesce({x}, ''))"
    t = f"regexp_replace({t}, '[^a-z0-9\\s]', ' ', 'g')"
    t = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    for k, v in mapping.items():
        t = f"regexp_replace({t}, '\\b{k}\\b', '{v}', 'g')"
    return t


def name(x: str) -> str:
    return words(x, NAME_ABBREVIATIONS)


def address(x: str) -> str:
    return words(x, ADDRESS_ABBREVIATIONS)


def phone(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def postal(x: str) -> str:
    return f"substr({phone(x)}, 1, 5)"


def state(x: str) -> str:
    k = f"regexp_replace(lower(coalesce({x}, '')), '^\\s+|\\s+$', '', 'g')"
    cases = " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in STATE_CODES.items())
    return f"upper(CASE {k} {cases} ELSE {k} END)"


def luhn_ok(s: str) -> str:
    terms = []
    for pos in range(1, 10):
        d = f"CAST(substr({s}, {pos}, 1) AS INT)"
        terms.append(f"(CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)" if pos % 2 else d)
    return f"((10 - ({' + '.join(terms)} + 24) % 10) % 10 = CAST(substr({s}, 10, 1) AS INT))"


def ten(s: str) -> str:
    return f"regexp_full_match({s}, '[0-9]{{10}}')"


def _nt(c: str) -> str:
    return f"CASE WHEN {c} IN ('null', 'NULL') THEN NULL ELSE {c} END"


RAW = f"raw AS ({provider_view_sql()})"
ODD = f"raw AS ({odd_view_sql()})"

MODEL = f"""model AS (
  SELECT rid, {_nt('npi')} AS npi, {_nt('gnpi')} AS group_npi, {_nt('group_name')} AS group_name,
         {_nt('primary_spec_desc')} AS specialty, {_nt('firstname')} AS first_name,
         {_nt('middlename')} AS middle_name, {_nt('lastname')} AS last_name,
         {_nt('address1')} AS address_line_1, {_nt('city')} AS city, {_nt('state')} AS state,
         {_nt('zipcode')} AS postal_code, {_nt('phone')} AS phone,
         {_nt('address_status')} AS address_status, {_nt('phone_status')} AS phone_status
  FROM raw)"""

_LEN = [("first_name", 1, 50), ("middle_name", None, 50), ("last_name", 1, 50), ("address_line_1", 1, 100),
        ("city", 1, 50), ("group_name", None, 255), ("specialty", None, 100)]


def _messages() -> list[str]:
    m = [
        "CASE WHEN npi IS NULL THEN 'npi: required' END",
        f"CASE WHEN npi IS NOT NULL AND NOT {ten('npi')} THEN 'npi: must be exactly 10 digits' END",
        f"CASE WHEN npi IS NOT NULL AND {ten('npi')} AND NOT {luhn_ok('npi')} THEN 'npi: invalid checksum' END",
        f"CASE WHEN group_npi IS NOT NULL AND NOT {ten('group_npi')} THEN 'group_npi: must be exactly 10 digits' END",
        f"CASE WHEN group_npi IS NOT NULL AND {ten('group_npi')} AND NOT {luhn_ok('group_npi')} THEN 'group_npi: invalid checksum' END",
    ]
    for f, lo, hi in _LEN:
        if lo is not None:
            m.append(f"CASE WHEN {f} IS NULL OR length({f}) < {lo} THEN '{f}: shorter than {lo}' END")
        m.append(f"CASE WHEN length({f}) > {hi} THEN '{f}: longer than {hi}' END")
    m += [
        "CASE WHEN state IS NULL OR NOT regexp_full_match(upper(state), '[A-Z]{2}') THEN 'state: must be two letters' END",
        "CASE WHEN postal_code IS NULL OR NOT regexp_full_match(postal_code, '[0-9]{5}(-[0-9]{4})?') THEN 'postal_code: must be 5 or 5-4 digits' END",
        "CASE WHEN phone IS NOT NULL AND NOT regexp_full_match(phone, '[0-9]{10,}') THEN 'phone: must be at least 10 digits' END",
        "CASE WHEN address_status IS NULL OR lower(address_status) NOT IN ('verified','inconclusive','invalid','no') THEN 'address_status: not one of verified,inconclusive,invalid,no' END",
        "CASE WHEN phone_status IS NULL OR lower(phone_status) NOT IN ('verified','inconclusive','invalid','no') THEN 'phone_status: not one of verified,inconclusive,invalid,no' END",
    ]
    return m


CHECKED = f"checked AS (SELECT *, concat_ws('; ', {', '.join(_messages())}) AS errors FROM model)"

PREPARED = f"""prepared AS (
  SELECT rid AS unique_id, npi, coalesce(group_npi, '') AS group_npi, {name('group_name')} AS group_name,
         {name('first_name')} AS given_name, {name('middle_name')} AS middle_name,
         {name('last_name')} AS family_name, {address('address_line_1')} AS street_address,
         {address('city')} AS city, {state('upper(state)')} AS state, {postal('postal_code')} AS postal_code,
         {phone('phone')} AS phone, coalesce(specialty, '') AS specialty,
         lower(address_status) AS address_status, lower(phone_status) AS phone_status
  FROM checked WHERE errors = '')"""

BASE = [RAW, MODEL, CHECKED, PREPARED]


def with_ctes(*extra: str, select: str) -> str:
    return "WITH " + ",\n".join(BASE + list(extra)) + "\n" + select


def profiles_cte(columns: list[str], name_: str = "profiles") -> str:
    cols = ", ".join(columns)
    return f"{name_} AS (SELECT {cols}, min(unique_id) AS rep_id, count(*) AS n FROM prepared GROUP BY {cols})"


def rule_pairs_select(rule: str, columns: list[str], earlier: list[str] = (), match_key: int = 0,
                      profiles: str = "profiles") -> str:
    cond = f"({rule}) AND (l.rep_id < r.rep_id OR (l.rep_id = r.rep_id AND l.n > 1))"
    for e in earlier:
        cond += f" AND NOT coalesce(({e}), false)"
    cols = ", ".join(f"l.{c} AS {c}_l, r.{c} AS {c}_r" for c in columns)
    return (f"SELECT l.rep_id AS rep_id_l, r.rep_id AS rep_id_r, "
            f"CAST(CASE WHEN l.rep_id = r.rep_id THEN l.n * (l.n - 1) / 2 ELSE l.n * r.n END AS BIGINT) AS pair_count, "
            f"{match_key} AS match_key{', ' + cols if cols else ''} FROM {profiles} l JOIN {profiles} r ON {cond}")


def gamma_sql(c: Comparison, l: str, r: str) -> str:
    levels = c.similarity_levels()
    top = c.n_levels - 1
    null = f"{l} IS NULL OR {r} IS NULL"
    if c.blank_as_null:
        null += f" OR {l} = '' OR {r} = ''"
    parts = [f"WHEN {null} THEN -1", f"WHEN {l} = {r} THEN {top}"]
    for i, (measure, cut) in enumerate(levels):
        if measure == "levenshtein":
            cond = f"levenshtein({l}, {r}) <= {int(cut)}"
        elif measure == "jaro_winkler":
            cond = f"jaro_winkler_similarity({l}, {r}) >= {cut}"
        else:
            n = int(cut)
            cond = f"length({l}) >= {n} AND substr({l}, 1, {n}) = substr({r}, 1, {n})"
        parts.append(f"WHEN {cond} THEN {top - 1 - i}")
    return f"CAST(CASE {' '.join(parts)} ELSE 0 END AS INT)"


def rule_columns(rules: list[str]) -> list[str]:
    out = []
    for r in rules:
        for c in BlockingRule(r).columns():
            if c not in out:
                out.append(c)
    return out
