"""Candidate pairs: profiles, blocking-rule self-joins, block-size report.

Records that agree on every column a spec reads (its *profile*) are
interchangeable for matching, so pairs are formed between profiles, each
carrying ``pair_count`` = the number of record pairs it stands for. A group of
exact copies costs one profile row instead of n(n-1)/2 pairs.

Each rule is an equi-join on its ``l.x = r.x`` keys with the rest of the rule
as join residual (Catalyst plans a hash / sort-merge join; an OR of rules would
become a nested-loop join, so rules are joined one by one and later rules
exclude pairs earlier ones found). Keys whose block holds more profiles than
``salt_block_size`` are split: the left side is spread over ``ceil(n / size)``
salt values and the right side is replicated to each, so one hot key is worked
on by many tasks. So are blocks of very many pairs, and the number of a join's tasks follows its pairs.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwise.plans.spec import BlockingRule, MatchSpec

# hot-key tables up to this many rows are broadcast (size checked by a count)
HOT_KEY_BROADCAST_ROWS = 1_000_000
#: Profile pairs of a block that one task forms at most, and pairs for which the join gets a task more.
PAIRS_PER_SALT = 16_000_000
PAIRS_PER_TASK = 4_000_000
#: Tasks of a join at most.
MOST_TASKS = 10_000


def profile_table(prepared: DataFrame, columns: list[str]) -> DataFrame:
    """One row per distinct profile: ``rep_id`` (smallest member id), ``n``.

    A plain ``groupBy``: partial aggregation collapses copies map-side before
    the shuffle, so a hot profile does not land whole on one reducer.
    """
    return prepared.groupBy(*columns).agg(
        F.min("unique_id").alias("rep_id"), F.count(F.lit(1)).alias("n")
    )


def _pair_count(l: Column, r: Column) -> Column:
    return F.when(F.col("l.rep_id") == F.col("r.rep_id"), F.col("l.n") * (F.col("l.n") - 1) / 2).otherwise(
        F.col("l.n") * F.col("r.n")
    ).cast("bigint")


def _rule_expr(rule: BlockingRule | str) -> Column:
    return F.expr(rule.sql if isinstance(rule, BlockingRule) else rule)


def block_sizes(profiles: DataFrame, rule: BlockingRule | str) -> DataFrame:
    """Per join key: profiles, records and the pair upper bound it produces."""
    rule = rule if isinstance(rule, BlockingRule) else BlockingRule(rule)
    keys = rule.equi_keys()
    return profiles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("profiles"),
        F.sum("n").alias("records"),
    ).withColumn("record_pairs", (F.col("records") * (F.col("records") - 1) / 2).cast("bigint"))


def hot_blocks(profiles: DataFrame, keys: list[str], size: int) -> tuple[DataFrame, int]:
    """Keys whose block holds more than ``size`` profiles with their number of salts, and how many there are."""
    hot = profiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("_bn")).where(F.col("_bn") > size).select(
        *keys, F.ceil(F.col("_bn") / size).cast("int").alias("_ns"))
    return hot, hot.count()


def one_sided(rule: BlockingRule, side: str) -> Column:
    """The rule's conditions on one record alone, of the left (``l``) or the right (``r``) one."""
    if re.search(r"\b(OR|BETWEEN|CASE)\b|['\"`]", re.sub(r"\([^()]*\)", "", rule.sql), re.IGNORECASE):
        return F.lit(True)
    parts = [p for p in rule.conjuncts() if set(re.findall(r"\b([lr])\.\w", p)) == {side} and not re.search(r"['\"`]", p)]
    return reduce(lambda a, b: a & b, [F.coalesce(F.expr(re.sub(rf"\b{side}\.(?=\w)", "", p)), F.lit(False)) for p in parts], F.lit(True))


def block_work(profiles: DataFrame, rule: BlockingRule, keys: list[str], size: int) -> tuple[DataFrame, int, float]:
    """(keys with their number of salts, how many there are, pairs of all blocks).

    A block is split if it holds more than ``size`` profiles or gives more than ``PAIRS_PER_SALT`` pairs; profiles that the rule's
    conditions on one record rule out count for none.
    """
    sides = [F.count_if(one_sided(rule, side)).cast("double") for side in "lr"]
    blocks = profiles.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_bn"), (sides[0] * sides[1] / 2).alias("_pairs"))
    salts = F.when(F.col("_pairs") > 0, F.greatest(F.ceil(F.col("_bn") / size), F.ceil(F.col("_pairs") / PAIRS_PER_SALT)).cast("int"))
    blocks = blocks.select(*keys, "_pairs", salts.alias("_ns"))
    row = blocks.agg(F.count_if(F.col("_ns") > 1).alias("hot"), F.sum("_pairs").alias("pairs")).collect()[0]
    return blocks.where(F.col("_ns") > 1).select(*keys, "_ns"), row["hot"], row["pairs"] or 0.0


def rule_pairs(profiles: DataFrame, rule: BlockingRule | str, columns: list[str],
               earlier: list[BlockingRule | str] = (), match_key: int = 0,
               salt_block_size: int | None = 50_000) -> DataFrame:
    """Profile pairs found by ``rule`` and by none of ``earlier``.

    Output: ``rep_id_l, rep_id_r, pair_count, match_key`` and ``<col>_l``,
    ``<col>_r`` for ``columns``. A self-pair (``rep_id_l = rep_id_r``) stands
    for the n(n-1)/2 pairs among a profile's copies. ``salt_block_size`` None says that
    no block is hot.
    """
    rule = rule if isinstance(rule, BlockingRule) else BlockingRule(rule)
    keys = rule.equi_keys()
    if not keys:
        raise ValueError(f"Blocking rule has no l.x = r.x key (would be a cross join): {rule.sql}")
    needed = list(dict.fromkeys(list(columns) + rule.columns()
                                + [c for e in earlier for c in BlockingRule(e if isinstance(e, str) else e.sql).columns()]))
    prof = profiles.select("rep_id", "n", *needed)

    hot, n_hot, work = block_work(prof, rule, keys, salt_block_size) if salt_block_size else (None, 0, 0.0)
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= HOT_KEY_BROADCAST_ROWS else hot
        prof = prof.join(hot, keys, "left")
        n_salts = F.coalesce(F.col("_ns"), F.lit(1))
        left = prof.withColumn("_salt", F.pmod(F.xxhash64("rep_id"), n_salts).cast("int")).drop("_ns")
        right = prof.withColumn("_salt", F.explode(F.sequence(F.lit(0), n_salts - 1))).drop("_ns")
        salt_cond = F.col("l._salt") == F.col("r._salt")
    else:
        left, right, salt_cond = prof, prof, F.lit(True)
    if work > PAIRS_PER_TASK:
        # tasks by the pairs they form; the rows of a block are too few for Spark to tell
        tasks = min(MOST_TASKS, math.ceil(work / PAIRS_PER_TASK))
        by = [*keys, "_salt"] if n_hot else keys
        left, right = left.repartition(tasks, *by), right.repartition(tasks, *by)

    cond = _rule_expr(rule) & salt_cond & (
        (F.col("l.rep_id") < F.col("r.rep_id"))
        | ((F.col("l.rep_id") == F.col("r.rep_id")) & (F.col("l.n") > 1))
    )
    for prev in earlier:
        cond = cond & ~F.coalesce(_rule_expr(prev), F.lit(False))

    joined = left.alias("l").join(right.alias("r"), cond, "inner")
    cols = [
        F.col("l.rep_id").alias("rep_id_l"),
        F.col("r.rep_id").alias("rep_id_r"),
        _pair_count(F.col("l.n"), F.col("r.n")).alias("pair_count"),
        F.lit(match_key).alias("match_key"),
    ]
    for c in columns:
        cols += [F.col(f"l.{c}").alias(f"{c}_l"), F.col(f"r.{c}").alias(f"{c}_r")]
    return joined.select(*cols)


def candidate_pairs(profiles: DataFrame, spec: MatchSpec, columns: list[str] | None = None,
                    positions: list[int] | None = None) -> DataFrame:
    """All rules of ``spec``; a pair is kept once, under the first rule that
    finds it (``match_key`` = rule position). With ``positions`` the pairs of these rules alone."""
    columns = columns if columns is not None else spec.compared_columns()
    parts = []
    for k, rule in enumerate(spec.blocking_rules):
        if positions is not None and k not in positions:
            continue
        parts.append(rule_pairs(profiles, rule, columns, spec.blocking_rules[:k], k, spec.salt_block_size))
    return reduce(lambda a, b: a.unionByName(b), parts)

