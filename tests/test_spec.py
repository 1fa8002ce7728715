"""Specs from settings."""

import pytest

from linkwise.plans.spec import BlockingRule, Comparison, MatchSpec, comparisons_from


def test_unknown_comparison_types_are_left_out_with_a_warning():
    found, warnings = comparisons_from([
        {"column": "npi", "kind": "Exact"}, {"column": "city", "kind": "phonetic"}, {"column": "phone"},
        {"column": "given_name", "kind": "jaro_winkler", "thresholds": (0.9,)}])
    assert found == (Comparison("npi", "exact"), Comparison("given_name", "jaro_winkler", (0.9,)))
    assert warnings == ("Unknown comparison type: phonetic (city)", "Unknown comparison type: None (phone)")
    with pytest.raises(ValueError):
        Comparison("city", "phonetic")


def test_warnings_of_the_spec_reach_the_result(spark):
    from linkwise.plans.pipeline import run_deduplication
    from linkwise.sources.fixture import provider_records

    from .conftest import SF_SMALL

    comps, warnings = comparisons_from([{"column": "npi", "kind": "exact"}, {"column": "phone", "kind": "exact"},
                                        {"column": "nowhere", "kind": "exact"}, {"column": "city", "kind": "soundex"}])
    spec = MatchSpec((BlockingRule("l.family_name = r.family_name AND l.given_name = r.given_name"),), comps, warnings=warnings)
    result = run_deduplication(provider_records(spark, SF_SMALL), spec, id_column="rid")
    assert result.warnings[0] == "Unknown comparison type: soundex (city)"
    assert any("nowhere" in w for w in result.warnings) and result.results.count() == 180
