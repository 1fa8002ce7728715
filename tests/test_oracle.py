"""Registered queries against their DuckDB oracle on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

NAMES = ["p15_prepared", "p11_quarantine", "n1_name", "n2_address", "n5_state", "j3_multi_rule", "j2_residual",
         "j14_compare", "j11_jaro_winkler", "a16_patterns", "a17_u_exact", "c1_predict", "c2_clusters",
         "c4_deduplicate", "a11_statistics", "a3_missing", "a8_score", "a9_recommendations", "c6_preset",
         "s2_csv", "s2_csv_text", "k1_save", "p3_required", "p12_batch_check", "p14_surrogate_key", "a10_analyze",
         "j6_random_pairs", "a17_u_sampled", "a18_em", "c9_train", "c3_tf_adjust", "c5_pipeline"]


def _canon(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        row = []
        for v in rec:
            if v is None or (isinstance(v, float) and math.isnan(v)):
                row.append(None)
            elif isinstance(v, float):
                row.append(round(v, 6))
            else:
                row.append(str(v) if not isinstance(v, (int, bool)) else v)
        out.append(tuple(str(x) for x in row))
    return cols, sorted(out)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("customer", "documents"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_SMALL}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dd = con.execute(E.oracle_sql()[name]).fetchdf()
    assert _canon(sp) == _canon(dd)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 180
    assert set(df.columns) >= {"unique_id", "cluster_id", "cluster_size"}
