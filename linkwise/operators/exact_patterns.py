"""Agreement patterns of a training rule without its pairs.

If a rule asks for equal keys alone and every level of the comparisons means equal values or equal first
characters, the number of record pairs that reach a set of levels is a sum of n(n-1)/2 over value counts. Every
profile is expanded to the sets it has values for, one grouped aggregate counts
them, and differences of the few set totals give the pairs of each pattern. Pairs of a block
are never formed, so a block that holds a third of all records costs as much as any other.
"""

from __future__ import annotations

import math
import re
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwise.plans.spec import BlockingRule, Comparison

#: Most level sets that a profile is expanded to.
MAX_SETS = 256
#: Kinds whose levels are equal values or equal first characters.
COUNTED_KINDS = ("exact", "postcode")


def is_plain(rule: BlockingRule) -> bool:
    """The rule is ``l.x = r.x AND ...`` and nothing else."""
    parts = re.split(r"\s+AND\s+", rule.sql, flags=re.IGNORECASE)
    return len(parts) == len(rule.equi_keys()) and all(
        re.fullmatch(r"\s*([lr])\.(\w+)\s*=\s*(?!\1)[lr]\.\2\s*", p) for p in parts)


def _valued(c: Comparison) -> Column:
    value = F.col(c.column)
    return value.isNotNull() & (value != "") if c.blank_as_null else value.isNotNull()


def tokens(c: Comparison) -> list[Column]:
    """What two values share at each level from 1 on: equal tokens mean this level or a higher one."""
    value = F.col(c.column).cast("string")
    return [*[F.substring(value, 1, int(n)) for _, n in reversed(c.similarity_levels())], value]


def column_sets(comparisons: list[Comparison], gaps: set[str]) -> list[tuple[int, ...]]:
    """Every choice of a level to reach per comparison; 0: both records have values, -1: open.

    Columns without ``gaps`` always have values.
    """
    return list(product(*[range(-1 if c.column in gaps else 0, c.n_levels) for c in comparisons]))


def possible(rule: BlockingRule, comparisons: list[Comparison]) -> bool:
    """Whether the patterns can be had this way at all (gaps, known later, decide about the number of sets)."""
    return is_plain(rule) and all(c.kind in COUNTED_KINDS for c in comparisons) and math.prod(
        c.n_levels for c in comparisons) <= MAX_SETS


def columns_with_gaps(profiles: DataFrame, comparisons: list[Comparison]) -> set[str]:
    if not comparisons:
        return set()
    row = profiles.agg(*[F.count_if(~_valued(c)).alias(f"g{i}") for i, c in enumerate(comparisons)]).collect()[0]
    return {c.column for i, c in enumerate(comparisons) if row[f"g{i}"]}


def set_totals(profiles: DataFrame, rule: BlockingRule, comparisons: list[Comparison], sets: list[tuple[int, ...]]) -> DataFrame:
    """(set, ordered_pairs): twice the record pairs of the rule that reach a set's levels.

    Keys and tokens are grouped by 128 bits (two seeded hashes), not by strings.
    """
    keys, set_index = rule.equi_keys(), F.lit(0)
    hashes = {"a": [F.xxhash64(F.lit(1), *keys)], "b": [F.xxhash64(F.lit(2), *keys)]}
    rows = profiles.dropna(subset=keys)
    for i, c in enumerate(comparisons):
        levels, step, items = sorted({s[i] for s in sets}), tokens(c), []
        for k, level in enumerate(levels):
            parts = [F.xxhash64(F.lit(seed), step[level - 1]) if level > 0 else F.lit(0).cast("bigint") for seed in (1, 2)]
            item = F.struct(F.lit(k).alias("k"), *[x.alias(name) for x, name in zip(parts, hashes)])
            items.append(F.when(_valued(c), item) if level >= 0 else item)
        rows = rows.withColumn(f"_t{i}", F.explode(F.array(*items))).where(F.col(f"_t{i}").isNotNull())
        set_index = set_index * len(levels) + F.col(f"_t{i}.k")
        for name, parts in hashes.items():
            parts.append(F.col(f"_t{i}.{name}"))
    rows = rows.select("n", set_index.alias("set"), *[F.xxhash64(*parts).alias(name) for name, parts in hashes.items()])
    # a record alone in its group has no pair
    groups = rows.groupBy("set", "a", "b").agg(F.sum("n").alias("n")).where("n > 1")
    n = F.col("n").cast("decimal(19,0)")
    return groups.groupBy("set").agg(F.sum(n * (n - 1)).cast("decimal(38,0)").alias("ordered_pairs"))


def exact_patterns(profiles: DataFrame, rule: BlockingRule, comparisons: list[Comparison]) -> pd.DataFrame | None:
    """``pattern_counts`` of the rule's pairs as a small table; None if too many level sets were needed."""
    profiles = profiles.dropna(subset=rule.equi_keys())
    gaps = columns_with_gaps(profiles, comparisons)
    sets = column_sets(comparisons, gaps)
    if len(sets) > MAX_SETS:
        return None
    found = {r["set"]: int(r["ordered_pairs"]) // 2 for r in set_totals(profiles, rule, comparisons, sets).collect()}
    counts = np.array([found.get(i, 0) for i in range(len(sets))], object).reshape(
        [c.n_levels + (c.column in gaps) for c in comparisons])
    for axis in range(counts.ndim):
        # pairs that reach a level, less those that reach the next one
        reach = np.moveaxis(counts, axis, 0)
        reach[:-1] -= reach[1:].copy()
    rows = [[*levels, n] for levels, n in zip(sets, counts.ravel()) if n]
    return pd.DataFrame(rows, columns=[c.gamma for c in comparisons] + ["pair_count"])
