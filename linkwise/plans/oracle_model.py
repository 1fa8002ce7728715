"""DuckDB SQL of a trained model: u, EM sessions, scores, clusters.

Used only by the correctness check, beside ``oracle.py``. EM runs as a recursive CTE
over the pattern counts, one row of parameters per iteration.
"""

from __future__ import annotations

import math

from linkwise.operators.train import PROBABILITY_FLOOR, start_m
from linkwise.plans import oracle as O
from linkwise.plans.spec import BlockingRule, Comparison, MatchSpec

FLOOR = repr(PROBABILITY_FLOOR)


def _levels(c: Comparison) -> range:
    return range(c.n_levels)


def id_hash(seed: str) -> str:
    return f"CAST('0x' || substr(md5(CAST(unique_id AS VARCHAR) || '/{seed}'), 1, 8) AS BIGINT)"


def sample_ctes(columns: list[str], max_pairs: int) -> list[str]:
    """The training-pair sample as ``spairs``."""
    cols = ", ".join(["unique_id"] + list(columns))
    fits = f"n * (n - 1) / 2 <= {max_pairs}"
    kept = f"least(n, 2 * {max_pairs})"
    sel = ", ".join(["l.unique_id AS unique_id_l", "r.unique_id AS unique_id_r"]
                    + [f"l.{c} AS {c}_l, r.{c} AS {c}_r" for c in columns])
    return [
        f"plan AS (SELECT CASE WHEN {fits} THEN 1 ELSE greatest(1, CAST(ceil({kept} * {kept} / (2.0 * {max_pairs})) AS "
        f"BIGINT)) END AS buckets, CASE WHEN {fits} THEN 4294967296 ELSE CAST(floor({kept} * 1.0 / n * 4294967296) AS "
        "BIGINT) END AS cut FROM (SELECT count(*) AS n FROM prepared))",
        f"sample AS (SELECT {cols}, {id_hash('bucket')} % (SELECT buckets FROM plan) AS bucket FROM prepared "
        f"WHERE {id_hash('keep')} < (SELECT cut FROM plan))",
        f"spairs AS (SELECT {sel} FROM sample l JOIN sample r ON l.bucket = r.bucket AND l.unique_id < r.unique_id)",
    ]


def _floored(values: list[str], names: list[str]) -> str:
    floors = [f"greatest(coalesce({v}, 0), {FLOOR})" for v in values]
    total = " + ".join(floors)
    return ", ".join(f"{f} / ({total}) AS {n}" for f, n in zip(floors, names))


def u_ctes(spec: MatchSpec) -> list[str]:
    """``uu``: one row with u_<column>_<level>."""
    out, tables = [], []
    other = [c for c in spec.comparisons if c.kind != "exact"]
    if other:
        out += sample_ctes(list(dict.fromkeys(c.column for c in other)), spec.max_pairs_for_training)
    for c in spec.comparisons:
        names = [f"u_{c.column}_{k}" for k in _levels(c)]
        if c.kind == "exact":
            src = (f"(SELECT CAST(sum(nv * (nv - 1) / 2) AS DOUBLE) / (sum(nv) * (sum(nv) - 1) / 2) AS ue FROM (SELECT "
                   f"count(*) AS nv FROM prepared WHERE {c.column} IS NOT NULL GROUP BY {c.column}))")
            values = ["1 - ue", "ue"]
        else:
            g = O.gamma_sql(c, f"{c.column}_l", f"{c.column}_r")
            counts = ", ".join(f"count(*) FILTER (g = {k}) * 1.0 AS n{k}" for k in _levels(c))
            src = f"(SELECT {counts}, count(*) FILTER (g >= 0) AS n FROM (SELECT {g} AS g FROM spairs))"
            values = [f"n{k} / nullif(n, 0)" for k in _levels(c)]
        out.append(f"u_{c.column} AS (SELECT {_floored(values, names)} FROM {src})")
        tables.append(f"u_{c.column}")
    out.append("uu AS MATERIALIZED (SELECT * FROM " + ", ".join(tables) + ")")
    return out


def session_ctes(spec: MatchSpec, rule: str, tag: int, profiles: str) -> tuple[list[str], list[Comparison]]:
    """``end<tag>``: the last row (it, done, lam, m_<column>_<level>) of a session's EM."""
    keys = set(BlockingRule(rule).equi_keys())
    comps = [c for c in spec.comparisons if c.column not in keys]
    cols = list(dict.fromkeys(c.column for c in comps))
    gammas = ", ".join(f"{O.gamma_sql(c, c.column + '_l', c.column + '_r')} AS {c.gamma}" for c in comps)
    keyed = ", ".join(c.gamma for c in comps)
    names = [(c, k, f"m_{c.column}_{k}") for c in comps for k in _levels(c)]
    start = ", ".join(f"CAST({float(start_m(c)[k])!r} AS DOUBLE) AS {n}" for c, k, n in names)

    def product(prefix):
        parts = []
        for c in comps:
            cases = " ".join(f"WHEN {k} THEN {prefix}_{c.column}_{k}" for k in _levels(c))
            parts.append(f"(CASE {c.gamma} {cases} ELSE 1.0 END)")
        return " * ".join(parts)

    sums = ", ".join(f"sum(post) FILTER ({c.gamma} = {k}) AS s_{c.column}_{k}, "
                     f"coalesce(sum(pair_count) FILTER ({c.gamma} = {k}), 0) AS o_{c.column}_{k}" for c, k, _ in names)
    old = ", ".join(f"any_value({n}) AS {n}" for _, _, n in names)
    new = []
    for c, k, n in names:
        mass = " + ".join(f"coalesce(s_{c.column}_{j}, 0)" for j in _levels(c))
        kept = " + ".join(f"(CASE WHEN o_{c.column}_{j} > 0 THEN 0 ELSE m_{c.column}_{j} END)" for j in _levels(c))
        own = f"(CASE WHEN o_{c.column}_{k} > 0 THEN 0 ELSE {n} END)"
        new.append(f"CASE WHEN {mass} > 0 THEN {own} + (1 - ({kept})) * coalesce(s_{c.column}_{k}, 0) / ({mass}) "
                   f"ELSE {n} END AS {n}")
    agg = (f"SELECT any_value(it) AS it, any_value(lam) AS lam, {old}, sum(post) AS matched, sum(pair_count) AS total, {sums} "
           f"FROM (SELECT *, pair_count * pm / (pm + pu) AS post FROM (SELECT p.*, e.*, uu.*, e.lam * {product('m')} AS pm, "
           f"(1 - e.lam) * {product('u')} AS pu FROM pat{tag} p, em{tag} e, uu WHERE NOT e.done AND e.it < "
           f"{spec.max_iterations})) HAVING count(*) > 0")
    inner = "SELECT it + 1 AS it, matched / total AS lam, lam AS old_lam, " + ", ".join(new) + ", " + ", ".join(
        f"{n} AS old_{n}" for _, _, n in names) + f" FROM ({agg})"
    moved = ", ".join(f"abs({n} - old_{n})" for _, _, n in names)
    return [
        f"pat{tag} AS MATERIALIZED (SELECT {keyed}, CAST(sum(pair_count) AS DOUBLE) AS pair_count FROM (SELECT pair_count, "
        f"{gammas} FROM ({O.rule_pairs_select(rule, cols, profiles=profiles)})) GROUP BY {keyed})",
        f"em{tag} AS (SELECT 0 AS it, false AS done, CAST(0.5 AS DOUBLE) AS lam, {start} UNION ALL SELECT it, "
        f"greatest(abs(lam - old_lam), {moved}) < {spec.em_convergence}, lam, {', '.join(n for _, _, n in names)} "
        f"FROM ({inner}))",
        f"end{tag} AS MATERIALIZED (SELECT * FROM em{tag} ORDER BY it DESC LIMIT 1)",
    ], comps


def trained_ctes(spec: MatchSpec, profiles: str) -> list[str]:
    """``par``: one row with m_<column>_<level> and u_<column>_<level>; sessions are ``end0``, ``end1``, ..."""
    out, by_column = u_ctes(spec), {c.column: [] for c in spec.comparisons}
    for tag, rule in enumerate(spec.effective_training_rules()):
        ctes, comps = session_ctes(spec, rule, tag, profiles)
        out += ctes
        for c in comps:
            by_column[c.column].append(tag)
    selects, tables = [], []
    for c in spec.comparisons:
        tags, names = by_column[c.column], [f"m_{c.column}_{k}" for k in _levels(c)]
        values = [f"list_aggregate([{', '.join(f'end{t}.{n}' for t in tags)}], 'median')" if tags
                  else repr(float(start_m(c)[k])) for k, n in enumerate(names)]
        selects.append(_floored(values, names))
        tables += [f"end{t}" for t in tags if f"end{t}" not in tables]
    out.append("mm AS (SELECT " + ", ".join(selects) + " FROM " + ", ".join(tables) + ")")
    out.append("par AS MATERIALIZED (SELECT * FROM mm, uu)")
    return out


def parameters_select(spec: MatchSpec) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c.column}' AS column, '{c.kind}' AS kind, {k} AS gamma, round(m_{c.column}_{k}, 6) AS m, "
        f"round(u_{c.column}_{k}, 6) AS u FROM par" for c in spec.comparisons for k in _levels(c))


def sessions_select(spec: MatchSpec) -> str:
    return " UNION ALL ".join(
        f"SELECT {O._q(rule)} AS rule, it AS iterations, round(lam, 6) AS lambda, done AS converged FROM end{tag}"
        for tag, rule in enumerate(spec.effective_training_rules()))


def scored_ctes(spec: MatchSpec, profiles: str) -> list[str]:
    """``scored``: pairs of all rules with weight and probability under ``par``."""
    cols = list(dict.fromkeys(c.column for c in spec.comparisons))
    rules = [r.sql for r in spec.blocking_rules]
    parts = [O.rule_pairs_select(r, cols, rules[:k], k, profiles=profiles) for k, r in enumerate(rules)]
    gammas = ", ".join(f"{O.gamma_sql(c, c.column + '_l', c.column + '_r')} AS {c.gamma}" for c in spec.comparisons)
    prior = math.log2(spec.prior_match / (1 - spec.prior_match))
    weight, joins, out = [repr(prior)], "", []
    for c in spec.comparisons:
        cases = " ".join(f"WHEN {k} THEN log2(m_{c.column}_{k} / u_{c.column}_{k})" for k in _levels(c))
        weight.append(f"(CASE {c.gamma} {cases} ELSE 0 END)")
        if c.term_frequency:
            top = c.n_levels - 1
            out.append(f"tf_{c.column} AS (SELECT {c.column} AS v, count(*) * 1.0 / (SELECT count(*) FROM prepared WHERE "
                       f"{c.column} IS NOT NULL) AS tf FROM prepared WHERE {c.column} IS NOT NULL GROUP BY {c.column})")
            joins += (f" LEFT JOIN tf_{c.column} a_{c.column} ON {c.column}_l = a_{c.column}.v "
                      f"LEFT JOIN tf_{c.column} b_{c.column} ON {c.column}_r = b_{c.column}.v")
            tf = f"greatest(a_{c.column}.tf, b_{c.column}.tf)"
            weight.append(f"(CASE WHEN {c.gamma} = {top} AND {tf} IS NOT NULL THEN log2(u_{c.column}_{top} / {tf}) ELSE 0 END)")
    return out + [
        "mpairs AS (" + " UNION ALL ".join(parts) + ")",
        f"mgammas AS (SELECT *, {gammas} FROM mpairs)",
        f"weighted AS (SELECT rep_id_l, rep_id_r, pair_count, match_key, {' + '.join(weight)} AS match_weight "
        f"FROM mgammas{joins}, par)",
        "scored AS (SELECT *, 1 / (1 + pow(2, -match_weight)) AS match_probability FROM weighted)",
    ]


def result_ctes(spec: MatchSpec, profiles: str, threshold: float) -> list[str]:
    """``results``: unique_id, cluster_id, cluster_size."""
    on = " AND ".join(f"k.{c} IS NOT DISTINCT FROM x.{c}" for c in spec.profile_columns())
    return [
        f"linked AS (SELECT * FROM scored WHERE match_probability >= {threshold})",
        "edges AS (SELECT rep_id_l AS a, rep_id_r AS b FROM linked WHERE rep_id_l <> rep_id_r "
        "UNION SELECT rep_id_r, rep_id_l FROM linked WHERE rep_id_l <> rep_id_r)",
        "walk(node, c) AS (SELECT a, a FROM edges UNION SELECT e.b, w.c FROM walk w JOIN edges e ON w.node = e.a)",
        "comp AS (SELECT node AS rep_id, min(c) AS component FROM walk GROUP BY node)",
        "ends AS (SELECT rep_id_l AS rep_id FROM linked UNION SELECT rep_id_r FROM linked)",
        "clusters AS (SELECT ends.rep_id, coalesce(component, ends.rep_id) AS cluster_rep FROM ends "
        "LEFT JOIN comp ON ends.rep_id = comp.rep_id)",
        f"assigned AS (SELECT x.unique_id, coalesce(k.cluster_rep, x.unique_id) AS cluster_id FROM prepared x LEFT JOIN "
        f"(SELECT p.*, cluster_rep FROM {profiles} p JOIN clusters c ON p.rep_id = c.rep_id) k ON {on})",
        "results AS (SELECT unique_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM assigned)",
    ]


def trained_sql(spec: MatchSpec, select: str, upto: str = "train", threshold: float | None = None) -> str:
    """Whole query: ``upto`` is ``train``, ``score`` or ``results``."""
    ctes = [*O.BASE, O.profiles_cte(spec.profile_columns(), "tprof"), *trained_ctes(spec, "tprof")]
    if upto in ("score", "results"):
        ctes += scored_ctes(spec, "tprof")
    if upto == "results":
        ctes += result_ctes(spec, "tprof", spec.match_threshold if threshold is None else threshold)
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select
