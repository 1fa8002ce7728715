import random

import numpy as np
import pytest

from linkwise.llm import decontaminate as D

from .conftest import EDGE_ROWS

WORDS = [f"w{i}" for i in range(60)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
    return row[-1]


def edited(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "zz"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "yy")
    return out


def make_items(rng, n=12):
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 50)))) for i in range(n)]


def test_recall_and_precision_against_brute_force():
    rng = random.Random(1)
    items = make_items(rng)
    index = D.Index(items)
    hits = wanted = 0
    for _ in range(250):
        key, text = rng.choice(items)
        words = text.split()
        planted = edited(words, rng.randrange(D.max_edits(len(words)) + 4), rng)
        doc = [rng.choice(WORDS) for _ in range(rng.randrange(40))] + planted + [rng.choice(WORDS) for _ in range(30)]
        found = {m[0] for m in index.matches(" ".join(doc))}
        for k, t in items:
            item = t.split()
            least = D.local_distance([index.ids[w] for w in item], [index.ids.get(w, 0) for w in doc])
            wanted += least <= D.max_edits(len(item))
            hits += least <= D.max_edits(len(item)) and k in found
            assert k not in found or least <= D.max_edits(len(item))
    assert wanted > 100 and hits / wanted >= D.RECALL


def test_local_distance_is_the_least_over_runs():
    rng = random.Random(2)
    for _ in range(60):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 6))], [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        runs = [b[i:j] for i in range(len(b) + 1) for j in range(i, len(b) + 1)]
        assert D.local_distance(a, b) == min(distance(a, r) for r in runs)


def test_embedding_reads_equal_windows_alike():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 30, 200)
    words[120:150] = words[20:50]
    places = np.arange(90)
    for r in range(3):
        code = D.embed_at(words, np.array([20, 120, 60]), 30, r, places)
        assert (code[:, 0] == code[:, 1]).all()
        assert (code[:, 0] == code[:, 2]).mean() < 0.5


def test_query_shape_and_filter(spark, make):
    rng = random.Random(4)
    items = make_items(rng)
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, "!!"), (0, items[0][1])], "item_id long, text string")
    rows = [(1, "Some " + items[3][1].upper() + " more"), (2, "clean text of other words"), (3, None), (4, "")]
    docs = make(rows, clashing=True)
    got = {r.id: [m["item"] for m in r.matches] for r in D.contained_items(docs, bench).collect()}
    assert got == {1: [3], 2: [], 3: [], 4: []}
    assert sorted(r.doc_id for r in D.without_items(docs, bench).collect()) == [2, 3, 4]
    assert D.without_items(docs, bench).columns == docs.columns


def test_blocks_of_items_give_the_same(spark, make, monkeypatch):
    rng = random.Random(5)
    items = make_items(rng)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make([(i, t) for i, (_, t) in enumerate(items)])
    one = sorted((r.id, sorted(m["item"] for m in r.matches)) for r in D.contained_items(docs, bench).collect())
    parts = list(D.item_blocks(bench, block=5))
    assert [len(p) for p in parts] == [5, 5, 2]
    monkeypatch.setattr(D, "item_blocks", lambda b, block=5: iter(parts))
    assert sorted((r.id, sorted(m["item"] for m in r.matches)) for r in D.contained_items(docs, bench).collect()) == one


@pytest.mark.parametrize("items", [[], [(1, "one two three four five six")]])
def test_edge_rows(spark, make, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contained_items(make(EDGE_ROWS, clashing=True), bench).count() == len(EDGE_ROWS)
    assert D.contained_items(make([]), bench).count() == 0
    assert D.without_items(make(EDGE_ROWS), bench).count() == len(EDGE_ROWS)
