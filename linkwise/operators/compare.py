"""Comparison levels on candidate pairs (``gamma_<column>`` columns).

Pairs carry ``<col>_l`` / ``<col>_r``; each comparison adds one small-int
column in a single projection. Levenshtein and prefix levels are built-ins;
Jaro-Winkler is computed once per distinct pair of unequal values of a batch and
read by all its levels; values that cannot reach the lowest level are left out.

A pair must cost little, since blocks give very many: ``compare_candidates`` works out once a
profile what levels need of one value alone (``with_aids``), and compares no values that a rule's keys make equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwise.functions.similarity import character_marks_udf, jaro_winkler_similarity, may_reach, similarity_where
from linkwise.operators.blocking import candidate_pairs
from linkwise.plans.spec import Comparison, MatchSpec
from linkwise.session import materialize


def is_null_side(c: Comparison, l: Column, r: Column) -> Column:
    null = l.isNull() | r.isNull()
    if c.blank_as_null:
        null = null | (l == F.lit("")) | (r == F.lit(""))
    return null


#: Most leading characters that fit a number, 21 bits each.
HEAD = 3


def head_number(value: Column, n: int) -> Column:
    """The first ``n`` characters as one number; null if the value has fewer."""
    parts = [F.shiftleft(F.ascii(F.substring(value, i + 1, 1)).cast("long"), 21 * i) for i in range(n)]
    return F.when(F.length(value) >= n, reduce(lambda a, b: a.bitwiseOR(b), parts))


def aids(c: Comparison) -> dict[str, Column]:
    """What the levels of ``c`` need of one value alone, by column name: numbers, null for a null value."""
    value = F.col(c.column)
    if c.kind == "levenshtein":
        return {f"_marks_{c.column}": character_marks_udf(value), f"_chars_{c.column}": F.length(value)}
    if c.uses_jaro_winkler():
        return {}
    out = {f"_hash_{c.column}": F.when(value.isNotNull(), F.xxhash64(value))}
    return out | {f"_head{int(n)}_{c.column}": head_number(value, int(n)) for _, n in c.similarity_levels() if n <= HEAD}


def with_aids(profiles: DataFrame, comparisons) -> DataFrame:
    """The profiles with the ``aids`` of all comparisons."""
    return profiles.withColumns({name: x for c in comparisons for name, x in aids(c).items()})


def aided_gamma(c: Comparison, l: Column, r: Column, lev: Column | None = None) -> Column:
    """``gamma_expr`` for pairs with aids: strings are read only where the numbers leave a level open.

    A pair's value stands once in the expression, as Spark reads those that stand twice beforehand for every pair.
    """
    def aid(name: str) -> tuple[Column, Column]:
        return F.col(f"_{name}_{c.column}_l"), F.col(f"_{name}_{c.column}_r")

    top, levels = c.n_levels - 1, c.similarity_levels()
    if lev is not None:
        chars = aid("chars")
        null = chars[0].isNull() | chars[1].isNull()
        if c.blank_as_null:
            null = null | (chars[0] == 0) | (chars[1] == 0)
        expr = F.when(null, F.lit(-1)).when(lev == 0, F.lit(top))
        conds = [(lev > 0) & (lev <= int(cut)) for _, cut in levels]
    else:
        hashes, blank = aid("hash"), F.xxhash64(F.lit(""))
        null = hashes[0].isNull() | hashes[1].isNull()
        if c.blank_as_null:
            null = null | ((hashes[0] == blank) & (l == F.lit(""))) | ((hashes[1] == blank) & (r == F.lit("")))
        expr = F.when(null, F.lit(-1)).when((hashes[0] == hashes[1]) & (l == r), F.lit(top))
        conds = [aid(f"head{int(n)}")[0] == aid(f"head{int(n)}")[1] for _, n in levels]
    for i, cond in enumerate(conds):
        expr = expr.when(cond, F.lit(top - 1 - i))
    return expr.otherwise(F.lit(0)).cast("int")


def gamma_expr(c: Comparison, l: Column, r: Column, jw: Column | None = None, lev: Column | None = None) -> Column:
    """Level of one comparison: -1 null, top = exact, ..., 0 = else.

    ``jw`` and ``lev`` are the similarity and the capped distance where they are columns already.
    """
    levels = c.similarity_levels()
    top = c.n_levels - 1
    expr = F.when(is_null_side(c, l, r), F.lit(-1)).when(l == r, F.lit(top))
    lev_cap = max([int(t) for m, t in levels if m == "levenshtein"], default=0)
    for i, (measure, cut) in enumerate(levels):
        if measure == "levenshtein":
            d = lev if lev is not None else F.levenshtein(l, r, lev_cap)
            cond = (d >= 0) & (d <= int(cut))
        elif measure == "jaro_winkler":
            cond = (jw if jw is not None else jaro_winkler_similarity(l, r)) >= F.lit(cut)
        else:
            n = int(cut)
            cond = (F.length(l) >= n) & (F.substring(l, 1, n) == F.substring(r, 1, n))
        expr = expr.when(cond, F.lit(top - 1 - i))
    return expr.otherwise(F.lit(0)).cast("int")


def capped_distance(c: Comparison, aided: bool) -> Column:
    """Edit distance of the pair's values, -1 above the highest threshold.

    Equal values need none; with aids, neither do those that marks or lengths put beyond it (an edit changes two bits of the
    marks at most and the length by one).
    """
    l, r = F.col(f"{c.column}_l"), F.col(f"{c.column}_r")
    cap = int(max(t for _, t in c.similarity_levels()))
    if not aided:
        return F.when(l == r, 0).otherwise(F.levenshtein(l, r, cap))
    marks, chars = ([F.col(f"_{aid}_{c.column}_{side}") for side in "lr"] for aid in ("marks", "chars"))
    near = (F.bit_count(marks[0].bitwiseXOR(marks[1])) <= 2 * cap) & (F.abs(chars[0] - chars[1]) <= cap)
    return F.when(near, F.levenshtein(l, r, cap)).otherwise(-1)


def compare(pairs: DataFrame, comparisons, keep_values: bool = False, equal=()) -> DataFrame:
    """Add ``gamma_<column>`` for every comparison; drop the compared strings
    unless ``keep_values``. ``equal`` names columns that hold the same value, not null, on both sides of every pair."""
    comparisons = list(comparisons)
    compared = [c for c in comparisons if c.column not in equal]
    cuts: dict[str, float] = {}
    for c in compared:
        if c.uses_jaro_winkler():
            lowest = min(cut for measure, cut in c.similarity_levels() if measure == "jaro_winkler")
            cuts[c.column] = min(lowest, cuts.get(c.column, lowest))
    jw_cols = {c: f"_jw_{c}" for c in cuts}
    aided = {c.gamma for c in compared if aids(c) and all(f"{x}_{s}" in pairs.columns for x in aids(c) for s in "lr")}
    if cuts:
        # the bound is a column of its own: both arguments read it
        pairs = pairs.withColumns({f"_near_{c}": may_reach(F.col(f"{c}_l"), F.col(f"{c}_r"), cut) for c, cut in cuts.items()})
        pairs = pairs.withColumns({jw_cols[c]: similarity_where(F.col(f"_near_{c}"), F.col(f"{c}_l"), F.col(f"{c}_r"))
                                   for c in cuts}).drop(*[f"_near_{c}" for c in cuts])
    lev_cols = {c.gamma: f"_lev_{c.column}" for c in compared if c.kind == "levenshtein"}
    if lev_cols:
        # one distance per pair for all levels
        pairs = pairs.withColumns({lev_cols[c.gamma]: capped_distance(c, c.gamma in aided) for c in compared if c.gamma in lev_cols})
    gammas = {}
    for c in comparisons:
        l, r = F.col(f"{c.column}_l"), F.col(f"{c.column}_r")
        lev = F.col(lev_cols[c.gamma]) if c.gamma in lev_cols else None
        if c.column in equal:
            top = F.lit(c.n_levels - 1)
            gammas[c.gamma] = F.when(l == F.lit(""), F.lit(-1)).otherwise(top) if c.blank_as_null else top
        elif c.gamma in aided:
            gammas[c.gamma] = aided_gamma(c, l, r, lev)
        else:
            gammas[c.gamma] = gamma_expr(c, l, r, F.col(jw_cols[c.column]) if c.column in jw_cols else None, lev)
    out = pairs.withColumns(gammas).drop(*jw_cols.values(), *lev_cols.values())
    out = out.drop(*[f"{aid}_{s}" for c in comparisons for aid in aids(c) for s in "lr"])
    if not keep_values:
        value_cols = {f"{c.column}_{s}" for c in comparisons for s in ("l", "r")}
        out = out.drop(*[v for v in value_cols if v in out.columns])
    return out


def compare_candidates(profiles: DataFrame, spec: MatchSpec, comparisons) -> DataFrame:
    """``compare`` of all pairs that the rules of ``spec`` find; ``profiles`` are written once, with their aids."""
    comparisons = list(comparisons)
    rows = materialize(with_aids(profiles, comparisons), "profiles")
    columns = list(dict.fromkeys([c.column for c in comparisons] + [aid for c in comparisons for aid in aids(c)]))
    parts = [compare(candidate_pairs(rows, spec, columns, [k]), comparisons, equal=rule.equi_keys())
             for k, rule in enumerate(spec.blocking_rules)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def available_comparisons(comparisons, columns: list[str]) -> tuple[list[Comparison], list[str]]:
    """Comparisons whose column exists, and warnings for the ones skipped."""
    kept, skipped = [], []
    for c in comparisons:
        if c.column in columns:
            kept.append(c)
        else:
            skipped.append(f"Column not found in data: {c.column}")
    return kept, skipped
