"""Threshold-aware blocking: pairs that cannot reach the threshold are never formed.

A blocking rule on names alone pairs everybody of a common name. Most of those pairs cannot
match whatever their other fields hold: with the trained weights, agreement on the names leaves
a gap to the threshold that some further agreement has to fill. From the weights
alone it follows which: every comparison is in one of a few states that a join key can
tell (values equal, first letters equal, neither), each with the highest weight a pair in that state can have.
The states whose sum reaches the threshold are enumerated, the weakest of them are the
requirements, and a cheap set of keys is chosen that has one in every requirement. The rule
is then joined once per chosen key, as ``rule AND l.key = r.key``. If no key is needed, the rule stands as
it is.

Term frequencies raise the weight of a rare value, so rows whose value of a rule's key is rare get the rule as
it is; their blocks are small for the same reason.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwise.operators.blocking import hot_blocks, rule_pairs
from linkwise.operators.train import Model
from linkwise.plans.spec import BlockingRule, Comparison, MatchSpec

#: Room for rounding in sums of weights.
EPSILON = 1e-6


@dataclass(frozen=True)
class State:
    """What a join can tell of a comparison: the condition that holds, the highest weight then possible, and
    how likely two random records meet the condition."""

    condition: str | None
    weight: float
    share: float


@dataclass(frozen=True)
class Facts:
    """What is known of the profiles: columns with nulls (or blanks taken as such) and the rarest value's share."""

    nullable: frozenset[str]
    rarest: dict[str, float]


def facts(profiles: DataFrame, comparisons: list[Comparison], tf_columns: list[str]) -> Facts:
    """One small aggregate over the profiles."""
    row = profiles.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col(c.column).isNull() | (F.lit(c.blank_as_null) & (F.col(c.column) == ""))).alias(f"null{i}")
        for i, c in enumerate(comparisons)], *[F.min(f"tf_{c}").alias(f"tf_{c}") for c in tf_columns]).collect()[0]
    return Facts(frozenset(c.column for i, c in enumerate(comparisons) if row[f"null{i}"]),
                 {c: row[f"tf_{c}"] for c in tf_columns if row[f"tf_{c}"]})


def level_weights(model: Model, c: Comparison) -> list[float]:
    return [math.log2(float(m) / float(u)) for m, u in zip(model.m[c.column], model.u[c.column])]


def bonus(model: Model, c: Comparison, share: float | None) -> float:
    """What a term frequency adds to the weight of equal values."""
    return math.log2(float(model.u[c.column][c.n_levels - 1]) / share) if c.term_frequency and share else 0.0


def states(model: Model, c: Comparison, known: Facts) -> list[State]:
    """The states of a comparison from weakest to strongest; weights never fall."""
    w, u, top = level_weights(model, c), [float(x) for x in model.u[c.column]], c.n_levels - 1
    null = [0.0] if c.column in known.nullable else []
    equal = max([w[top], w[top] + bonus(model, c, known.rarest.get(c.column)), *(null if c.blank_as_null else [])])
    below = [(top - 1 - i, int(cut)) for i, (measure, cut) in enumerate(c.similarity_levels()) if measure == "prefix"]
    hidden = [w[k] for k in range(top) if k not in {level for level, _ in below}]
    out = [State(None, max(hidden + null), 1.0)]
    for level, n in sorted(below):
        condition = f"substring(l.{c.column}, 1, {n}) = substring(r.{c.column}, 1, {n})"
        out.append(State(condition, max(w[level], out[-1].weight), sum(u[level:])))
    return [*out, State(f"l.{c.column} = r.{c.column}", max(equal, out[-1].weight), u[top])]


def requirements(choices: list[list[State]], base: float, needed: float) -> list[tuple[int, ...]]:
    """The weakest combinations of states that reach ``needed``; ``(0, 0, ...)`` if nothing is required."""
    def reaches(combination) -> bool:
        return base + sum(s[i].weight for s, i in zip(choices, combination)) >= needed - EPSILON

    out = []
    for combination in product(*[range(len(s)) for s in choices]):
        weaker = [combination[:j] + (i - 1,) + combination[j + 1:] for j, i in enumerate(combination) if i]
        if reaches(combination) and not any(reaches(x) for x in weaker):
            out.append(combination)
    return out


def chosen_keys(choices: list[list[State]], required: list[tuple[int, ...]]) -> list[str] | None:
    """Conditions of which every requirement holds one, the rarest first; None if a requirement has none."""
    left, out = list(required), []
    if any(not any(x) for x in left):
        return None
    while left:
        options = {(j, i) for x in left for j, top in enumerate(x) for i in range(1, top + 1)}

        def price(option):
            j, i = option
            return choices[j][i].share / sum(x[j] >= i for x in left), option

        j, i = min(options, key=price)
        out.append(choices[j][i].condition)
        left = [x for x in left if x[j] < i]
    return out


def weight_needed(threshold: float) -> float:
    """The match weight at which the probability is ``threshold``."""
    if threshold <= 0:
        return -math.inf
    return math.inf if threshold >= 1 else math.log2(threshold / (1.0 - threshold))


def split_rule(rule: BlockingRule, model: Model, threshold: float, known: Facts, tf_columns: list[str]
               ) -> tuple[list[str] | None, dict[str, float]]:
    """(keys to add, one join each; None: the rule as it is) and, by term-frequency column of the
    rule's keys, the share below which a value counts as rare."""
    base, choices, own = math.log2(model.prior / (1.0 - model.prior)), [], []
    for c in model.comparisons:
        if c.column in rule.equi_keys():
            w = level_weights(model, c)[c.n_levels - 1]
            base += max(w, 0.0) if c.blank_as_null else w
            own += [c] if c.term_frequency and c.column in tf_columns else []
        else:
            choices.append(states(model, c, known))
    needed = weight_needed(threshold)
    gap = needed - base - sum(s[0].weight for s in choices)
    if not math.isfinite(needed) or gap <= EPSILON:
        return None, {}
    # half the gap may be filled by the term frequencies of values that are not rare
    allowed = gap / 2 / len(own) if own else 0.0
    common = sum((min(allowed, max(0.0, bonus(model, c, known.rarest.get(c.column)))) for c in own), 0.0)
    keys = chosen_keys(choices, requirements(choices, base + common, needed))
    rare = {c.column: float(model.u[c.column][c.n_levels - 1]) * 2.0 ** -allowed for c in own}
    return keys, {c: share for c, share in rare.items() if known.rarest.get(c, 1.0) < share}


def with_key(sql: str, key: str) -> str:
    """The rule with one more condition; a rule of alternatives is put in brackets."""
    depth, flat = 0, []
    for ch in sql:
        depth += (ch == "(") - (ch == ")")
        flat.append(ch if depth == 0 else " ")
    return f"({sql}) AND {key}" if " OR " in "".join(flat).upper() else f"{sql} AND {key}"


def reachable_pairs(profiles: DataFrame, spec: MatchSpec, model: Model, threshold: float, columns: list[str],
                    tf_columns: list[str] = ()) -> DataFrame:
    """``candidate_pairs`` without the pairs whose weight stays below ``threshold`` in any case.

    ``profiles`` carry ``tf_<col>`` for ``tf_columns``. Every pair is still found once, under
    the first rule it meets.
    """
    known = facts(profiles, model.comparisons, list(tf_columns))
    parts = []
    for k, rule in enumerate(spec.blocking_rules):
        keys, rare = split_rule(rule, model, threshold, known, list(tf_columns))
        earlier = list(spec.blocking_rules[:k])

        # blocks of the rule with one more key are no larger, so the rule is looked at once
        salt = spec.salt_block_size if hot_blocks(profiles, rule.equi_keys(), spec.salt_block_size)[1] else None

        def joined(rows: DataFrame, sql: str, before: list):
            return rule_pairs(rows, sql, columns, before, k, salt)

        if keys is None:
            parts.append(joined(profiles, rule.sql, earlier))
            continue
        is_rare = reduce(lambda a, b: a | b, [F.col(f"tf_{c}") < F.lit(share) for c, share in rare.items()], F.lit(False))
        if rare:
            parts.append(joined(profiles.where(is_rare), rule.sql, earlier))
        rows = profiles.where(~F.coalesce(is_rare, F.lit(False))) if rare else profiles
        for key in keys:
            sql = with_key(rule.sql, key)
            parts.append(joined(rows, sql, earlier))
            earlier.append(BlockingRule(sql))
    return reduce(lambda a, b: a.unionByName(b), parts)
