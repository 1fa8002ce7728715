"""Match specification: blocking rules, comparisons and model settings.

A frozen, data-free description that is turned into Spark plans at plan time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

COMPARISON_KINDS = ("exact", "levenshtein", "jaro_winkler", "name", "postcode")


@dataclass(frozen=True)
class BlockingRule:
    """A SQL predicate over the aliases ``l`` and ``r`` of two records."""

    sql: str
    description: str | None = None

    def __post_init__(self):
        if not self.sql or not self.sql.strip():
            raise ValueError("Blocking rule cannot be empty")
        object.__setattr__(self, "sql", self.sql.strip())

    def conjuncts(self) -> list[str]:
        """The conditions that top-level ANDs join."""
        depth, start, parts = 0, 0, []
        text = self.sql
        i = 0
        while i < len(text):
            ch = text[i]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif depth == 0 and text[i:i + 5].upper() == " AND ":
                parts.append(text[start:i])
                start = i + 5
                i += 4
            i += 1
        return [*parts, text[start:]]

    def equi_keys(self) -> list[str]:
        """Columns compared as ``l.x = r.x`` in top-level AND conjuncts.

        These are the hash-join keys; a rule without any would be a cross join
        and is refused by the blocking step.
        """
        keys = []
        for part in self.conjuncts():
            m = re.fullmatch(r"\s*l\.(\w+)\s*=\s*r\.(\w+)\s*", part) or re.fullmatch(r"\s*r\.(\w+)\s*=\s*l\.(\w+)\s*", part)
            if m and m.group(1) == m.group(2) and m.group(1) not in keys:
                keys.append(m.group(1))
        return keys

    def columns(self) -> list[str]:
        """Every column the rule reads."""
        out = []
        for name in re.findall(r"\b[lr]\.(\w+)", self.sql):
            if name not in out:
                out.append(name)
        return out


@dataclass(frozen=True)
class Comparison:
    """One field comparison producing ``gamma_<column>``.

    Levels, highest first: exact, then the kind's similarity levels, then 0
    (else); -1 when either side is null (or blank with ``blank_as_null``).
    """

    column: str
    kind: str
    thresholds: tuple[float, ...] | None = None
    term_frequency: bool = False
    blank_as_null: bool = False

    def __post_init__(self):
        kind = self.kind.strip().lower()
        if kind not in COMPARISON_KINDS:
            raise ValueError(f"Unknown comparison type: {self.kind}")
        object.__setattr__(self, "kind", kind)
        if self.thresholds is not None:
            object.__setattr__(self, "thresholds", tuple(float(t) for t in self.thresholds))

    def similarity_levels(self) -> list[tuple[str, float]]:
        """(measure, cut-off) below exact, best first."""
        if self.kind == "exact":
            return []
        if self.kind == "levenshtein":
            ts = sorted(self.thresholds or (1, 2))
            return [("levenshtein", t) for t in ts]
        if self.kind == "jaro_winkler":
            ts = sorted(self.thresholds or (0.9, 0.7), reverse=True)
            return [("jaro_winkler", t) for t in ts]
        if self.kind == "name":
            ts = sorted(self.thresholds or (0.92, 0.88, 0.7), reverse=True)
            return [("jaro_winkler", t) for t in ts]
        # postcode: shared leading characters
        return [("prefix", 3), ("prefix", 1)]

    @property
    def n_levels(self) -> int:
        """Number of non-null levels (else .. exact)."""
        return 2 + len(self.similarity_levels())

    @property
    def gamma(self) -> str:
        return f"gamma_{self.column}"

    def uses_jaro_winkler(self) -> bool:
        return any(m == "jaro_winkler" for m, _ in self.similarity_levels())


def comparisons_from(settings: list[dict]) -> tuple[tuple[Comparison, ...], tuple[str, ...]]:
    """(comparisons, warnings) from rows of ``Comparison``'s fields; a row of an unknown kind is left out with a
    warning instead of failing the whole configuration."""
    out, warnings = [], []
    for row in settings:
        kind = str(row.get("kind", "")).strip().lower()
        if kind in COMPARISON_KINDS:
            out.append(Comparison(**row))
        else:
            warnings.append(f"Unknown comparison type: {row.get('kind')} ({row.get('column')})")
    return tuple(out), tuple(warnings)


@dataclass(frozen=True)
class MatchSpec:
    blocking_rules: tuple[BlockingRule, ...]
    comparisons: tuple[Comparison, ...]
    max_iterations: int = 20
    em_convergence: float = 0.001
    match_threshold: float = 0.95
    min_cluster_size: int = 2
    max_pairs_for_training: int = 1_000_000
    # prior probability that two random records match (never estimated)
    prior_match: float = 0.0001
    # profiles per blocking key above which a block is split into salted parts
    salt_block_size: int = 50_000
    training_rules: tuple[str, ...] = field(default_factory=tuple)
    # what was left out when the spec was built; passed on with the result
    warnings: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if not self.blocking_rules:
            raise ValueError("A match spec needs at least one blocking rule (all-pairs is not supported)")
        if not self.comparisons:
            raise ValueError("A match spec needs at least one comparison")
        if not 0.0 <= self.match_threshold <= 1.0:
            raise ValueError("match_threshold must be within [0, 1]")
        if self.min_cluster_size < 2:
            raise ValueError("min_cluster_size must be at least 2")

    def compared_columns(self) -> list[str]:
        out = []
        for c in self.comparisons:
            if c.column not in out:
                out.append(c.column)
        return out

    def effective_training_rules(self) -> tuple[str, ...]:
        """The training rules of the spec, or the three default ones."""
        from linkwise.functions.constants import TRAINING_RULES

        return tuple(self.training_rules) or tuple(TRAINING_RULES)

    def profile_columns(self) -> list[str]:
        """Columns that decide blocking, training and comparison: records equal
        on all of them are interchangeable for matching."""
        out = []
        rules = [r.sql for r in self.blocking_rules] + list(self.effective_training_rules())
        for sql in rules:
            for name in BlockingRule(sql).columns():
                if name not in out:
                    out.append(name)
        for name in self.compared_columns():
            if name not in out:
                out.append(name)
        return out


def preset_strict() -> MatchSpec:
    """The strict preset: one rule on NPI, names, ZIP and phone (or both
    phones short), six comparisons, threshold 0.98."""
    from linkwise.functions.constants import TRAINING_RULES

    # FIXED VALUES: strict preset settings
    return MatchSpec(
        blocking_rules=(
            BlockingRule(
                "l.npi = r.npi AND l.family_name = r.family_name AND l.given_name = r.given_name "
                "AND l.postal_code = r.postal_code AND (l.phone = r.phone OR (length(l.phone) < 10 AND length(r.phone) < 10))",
                "Same NPI, names and ZIP; same phone, or neither phone complete",
            ),
        ),
        comparisons=(
            Comparison("npi", "exact"),
            Comparison("given_name", "exact"),
            Comparison("family_name", "exact"),
            Comparison("street_address", "jaro_winkler", (0.95, 0.99)),
            Comparison("postal_code", "exact"),
            Comparison("phone", "exact"),
        ),
        max_iterations=10,
        em_convergence=0.001,
        match_threshold=0.98,
        min_cluster_size=2,
        max_pairs_for_training=50_000,
        training_rules=tuple(TRAINING_RULES),
    )


def spec_fuzzy() -> MatchSpec:
    """Three rules (NPI; names; phone of ten or more digits) and fuzzy
    comparisons: name, levenshtein, postcode, term-frequency on family name."""
    from linkwise.functions.constants import TRAINING_RULES

    return MatchSpec(
        blocking_rules=(
            BlockingRule("l.npi = r.npi"),
            BlockingRule("l.family_name = r.family_name AND l.given_name = r.given_name"),
            BlockingRule("l.phone = r.phone AND length(l.phone) >= 10"),
        ),
        comparisons=(
            Comparison("npi", "exact"),
            Comparison("given_name", "name"),
            Comparison("family_name", "exact", term_frequency=True),
            Comparison("street_address", "levenshtein", (1, 2, 3)),
            Comparison("postal_code", "postcode"),
            Comparison("phone", "exact"),
        ),
        max_iterations=20,
        em_convergence=0.001,
        match_threshold=0.95,
        max_pairs_for_training=1_000_000,
        training_rules=tuple(TRAINING_RULES),
    )
