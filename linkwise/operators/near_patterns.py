"""Agreement patterns of a rule with one fuzzy comparison, from the pairs that are near in it.

Nearly all pairs of a block are at the lowest level of an edit distance or Jaro-Winkler comparison, and what they
show elsewhere is a matter of equal values. So all pairs are counted without forming them (``exact_patterns``), as if
the fuzzy comparison were exact. Only those whose unequal values may reach a level of it are formed and compared, and
taken off the count of the lowest level. A word of bits with the characters of each value tells in the join
which pairs cannot: each edit changes two of its bits at most. Both together are exact.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwise.functions.similarity import EPSILON, MAX_PREFIX, PREFIX_SCALE, character_marks_udf
from linkwise.operators.blocking import block_work, candidate_pairs, rule_pairs
from linkwise.operators.compare import compare
from linkwise.operators.exact_patterns import COUNTED_KINDS, exact_patterns, is_plain, possible
from linkwise.plans.spec import BlockingRule, Comparison, MatchSpec


def fuzzy_comparison(rule: BlockingRule, comparisons: list[Comparison]) -> Comparison | None:
    """The only comparison that needs pairs, if there is just one; values of key columns are always equal."""
    keys = rule.equi_keys()
    fuzzy = [c for c in comparisons if c.kind not in COUNTED_KINDS and c.column not in keys]
    return fuzzy[0] if len(fuzzy) == 1 else None


def counted_as(rule: BlockingRule, comparisons: list[Comparison]) -> list[Comparison]:
    """The comparisons for counting: exact ones stand for the fuzzy one and those of key columns."""
    fuzzy, keys = fuzzy_comparison(rule, comparisons), rule.equi_keys()
    return [Comparison(c.column, "exact", blank_as_null=c.blank_as_null) if c is fuzzy or c.column in keys else c for c in comparisons]


def spares_pairs(profiles: DataFrame, rule: BlockingRule, comparisons: list[Comparison], earlier: list[BlockingRule], size: int) -> bool:
    """The rule and those before it ask for equal values alone, and its pairs outnumber the rows to count."""
    if fuzzy_comparison(rule, comparisons) is None or not all(is_plain(e) for e in earlier):
        return False
    stand_ins = counted_as(rule, comparisons)
    if not possible(rule, stand_ins):
        return False
    sets = 1
    for c in stand_ins:
        sets *= c.n_levels
    return block_work(profiles, rule, rule.equi_keys(), size)[2] > sets * profiles.count()


def near(c: Comparison) -> str:
    """What pairs of unequal values must meet to reach a level of ``c`` above the lowest; null values never do."""
    apart = "bit_count(l._marks ^ r._marks)"
    unequal = f"l.{c.column} <> r.{c.column}"
    if c.kind == "levenshtein":
        most = max(int(t) for _, t in c.similarity_levels())
        return f"{apart} <= {2 * most} AND abs(l._chars - r._chars) <= {most} AND {unequal}"
    # a Jaro-Winkler similarity asks for a Jaro similarity, that for a number of characters in both values
    boost = MAX_PREFIX * PREFIX_SCALE
    jaro = (min(t for _, t in c.similarity_levels()) - EPSILON - boost) / (1 - boost)
    both = "(l._chars + r._chars)"
    # D: a plain literal would be a decimal, which is slow
    return f"{apart} * {both} <= {both} * {both} - {2 * (3 * jaro - 1):.12f}D * l._chars * r._chars + 0.001D AND {unequal}"


def counted(profiles: DataFrame, rule: BlockingRule, comparisons: list[Comparison], earlier: list[BlockingRule]) -> dict | None:
    """Patterns of the rule's pairs that no earlier rule finds, by inclusion and exclusion of the earlier rules."""
    out: dict[tuple, int] = {}
    for n in range(len(earlier) + 1):
        for some in combinations(earlier, n):
            keys = dict.fromkeys(k for r in (rule, *some) for k in r.equi_keys())
            found = exact_patterns(profiles, BlockingRule(" AND ".join(f"l.{k} = r.{k}" for k in keys)), comparisons)
            if found is None:
                return None
            for *levels, pairs in found.itertuples(index=False):
                out[tuple(levels)] = out.get(tuple(levels), 0) + (-1) ** n * pairs
    return out


def near_patterns(profiles: DataFrame, rule: BlockingRule, comparisons: list[Comparison], earlier: list[BlockingRule] = (),
                  salt_block_size: int = 50_000) -> pd.DataFrame | None:
    """``pattern_counts`` of the rule's pairs as a small table; None if too many level sets were needed."""
    fuzzy = fuzzy_comparison(rule, comparisons)
    at, top = comparisons.index(fuzzy), fuzzy.n_levels - 1
    totals = counted(profiles, rule, counted_as(rule, comparisons), list(earlier))
    if totals is None:
        return None
    tops = [c.n_levels - 1 if c is fuzzy or c.column in rule.equi_keys() else 1 for c in comparisons]
    out = {tuple(t if x == 1 and t > 1 else x for x, t in zip(levels, tops)): n for levels, n in totals.items()}
    rows = profiles.withColumns({"_marks": character_marks_udf(F.col(fuzzy.column)), "_chars": F.length(fuzzy.column)})
    pairs = rule_pairs(rows, f"{rule.sql} AND {near(fuzzy)}", list(dict.fromkeys(c.column for c in comparisons)), earlier,
                       salt_block_size=salt_block_size)
    names = [c.gamma for c in comparisons]
    # levels are looked at here: a filter on them would go into the join, before the marks
    for *levels, n in compare(pairs, comparisons).groupBy(*names).agg(F.sum("pair_count")).collect():
        if not 0 < levels[at] < top:
            continue
        out[tuple(levels)] = out.get(tuple(levels), 0) + n
        lowest = (*levels[:at], 0, *levels[at + 1:])
        out[lowest] = out.get(lowest, 0) - n
    return pd.DataFrame([[*levels, n] for levels, n in out.items() if n], columns=[*names, "pair_count"])


def candidate_patterns(profiles: DataFrame, spec: MatchSpec, comparisons: list[Comparison]) -> DataFrame:
    """Agreement patterns of all rules' pairs with their numbers of record pairs."""
    names, counts, left = [c.gamma for c in comparisons], [], []
    for k, rule in enumerate(spec.blocking_rules):
        earlier = list(spec.blocking_rules[:k])
        small = near_patterns(profiles, rule, comparisons, earlier, spec.salt_block_size) if spares_pairs(
            profiles, rule, comparisons, earlier, spec.salt_block_size) else None
        if small is None:
            left.append(k)
        else:
            counts += [tuple(int(x) for x in row) for row in small.itertuples(index=False)]
    schema = ", ".join([*[f"{n} int" for n in names], "pair_count bigint"])
    found = profiles.sparkSession.createDataFrame(counts, schema)
    if left:
        columns = list(dict.fromkeys(c.column for c in comparisons))
        found = found.unionByName(compare(candidate_pairs(profiles, spec, columns, left), comparisons).select(*names, "pair_count"))
    return found.groupBy(*names).agg(F.sum("pair_count").alias("pair_count"))
