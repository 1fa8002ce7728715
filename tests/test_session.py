"""Written intermediates go when they have been used."""

import os

import pytest

from linkwise import session
from linkwise.session import materialize, temporary_tables


@pytest.fixture
def left(monkeypatch):
    """Names of the tables written in the test that are still there (the folder may serve other sessions too)."""
    paths, real = [], session.work_path

    def noted(spark, name):
        paths.append((name, real(spark, name)))
        return paths[-1][1]

    monkeypatch.setattr(session, "work_path", noted)
    return lambda: sorted(name for name, path in paths if os.path.exists(path.removeprefix("file:")))


def test_tables_of_a_scope_are_removed(spark, left):
    with temporary_tables(spark) as keep:
        materialize(spark.range(3), "gone")
        with temporary_tables(spark) as keep_inner:
            materialize(spark.range(3), "inner-gone")
            inner = keep_inner(materialize(spark.range(4), "inner-kept"))
        assert inner.count() == 4 and left() == ["gone", "inner-kept"]
        kept = keep(materialize(spark.range(5), "kept"))
    assert left() == ["kept"] and kept.count() == 5


def test_an_error_removes_all(spark, left):
    with pytest.raises(ZeroDivisionError):
        with temporary_tables(spark) as keep:
            keep(materialize(spark.range(3), "lost"))
            1 / 0
    assert left() == []


def test_the_pipeline_leaves_its_results_alone(spark, left):
    from linkwise.plans.pipeline import run_deduplication
    from linkwise.plans.spec import preset_strict
    from linkwise.sources.fixture import provider_records

    from .conftest import SF_SMALL

    result = run_deduplication(provider_records(spark, SF_SMALL), preset_strict(), id_column="rid")
    assert left() == ["profiles", "results", "scored"]
    assert result.results.count() == 180 and result.statistics.count() == 1 and result.profiles.count() > 0
