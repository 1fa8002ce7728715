import random

import numpy as np
import pytest

from linkwise.llm import toxicity as T

from ..conftest import SF_SMALL
from .conftest import EDGE_ROWS

SF = SF_SMALL.replace("sf0.001", "sf0.01")


def test_best_segment_and_maximal_segments_match_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.uniform(-3, 3) for _ in range(rng.randrange(1, 14))]
        sums = [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        assert T.best_segment(np.array(scores, float)) == pytest.approx(max(0, *sums))
        assert sorted((a, b) for a, b, _ in T.maximal_segments(scores)) == sorted(plain_maximal(scores))


def plain_maximal(scores, low=0, high=None):
    """Ruzzo and Tompa's definition: the best segment, then the same left and right of it."""
    high = len(scores) if high is None else high
    best = None
    for a in range(low, high):
        for b in range(a + 1, high + 1):
            s = sum(scores[a:b])
            # among equal sums the leftmost, shortest
            if s > 0 and (best is None or s > best[0] + 1e-12):
                best = (s, a, b)
    if best is None:
        return []
    _, a, b = best
    return plain_maximal(scores, low, a) + [(a, b)] + plain_maximal(scores, b, high)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = T.learn(docs, labels)
    assert model and model.slope > 0 and model.lam > 0
    found = T.passages(docs, model).join(labels.select(labels.doc_id.alias("id"), "toxic"), "id").where(
        T.crc_fold(T.F.col("id")) == 0).collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in found)
    assert right / len(found) >= 0.93
    assert all(r.passages for r in found if r.score > 0.99)


def test_column_function_gives_the_same_scores(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = T.learn(docs, labels)
    one = {r.id: r.score for r in T.passages(docs, model).collect()}
    two = {r.doc_id: r.s for r in docs.select("doc_id", T.probability(model)("text").alias("s")).collect()}
    assert one == two


def test_edge_rows_and_missing_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make(EDGE_ROWS, clashing=True)
    assert T.learn(docs, none) is None
    assert [r.score for r in T.passages(docs, None).collect()] == [0.0] * len(EDGE_ROWS)
    model = T.Model({"bad": (5.0, 9.0)}, -0.1, 1.0, 0.1, 1.0, -1.0)
    assert T.passages(docs, model).count() == len(EDGE_ROWS)
    assert T.passages(make([]), model).count() == 0
    odd = spark.createDataFrame([(None, 1, 1), (1, 0, None), (1, 0, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert [(r.id, r.toxic) for r in T.labelled_sample(odd).collect()] in ([(1, 1)], [])
