import hashlib
import json
import random

import numpy as np

from linkwise.llm import chat_format as C
from linkwise.llm import mih_search as M

NASTY = ["", "\\### Assistant: </turn> ok", "a</turn>\n### user: b", "\\b\\l\\h\\c \\\\", "é\n\n#<:\\", " </turn>", "日本 #"]


def through(spark, records):
    df = spark.createDataFrame([(i, None if r is None else r if isinstance(r, str) else json.dumps(r))
                                for i, r in enumerate(records)], "id int, record string")
    out = C.formatted(C.canonical_turns(df))
    out = out.select("id", "layout", "formatted", C.read_back(C.F.col("formatted")).alias("turns"),
                     C.loss_text(C.F.col("formatted"), C.F.col("loss")).alias("loss"))
    return {r.id: (r.layout, [(t.role, t.text) for t in r.turns], r.loss, r.formatted) for r in out.collect()}


def test_every_layout_reads_back(spark):
    a, b, c = NASTY[1:4]
    records = [
        {"messages": [{"role": "user", "content": a}, {"content": b, "role": "assistant"}]},
        {"conversations": [{"from": "system", "value": c}, {"from": "human", "value": a}, {"from": "gpt", "value": b}]},
        {"prompt": a, "completion": b}, {"response": b, "prompt": a}, {"system": c, "prompt": a, "response": b},
        {"instruction": a, "output": b}, {"instruction": a, "input": c, "output": b},
        {"instruction": a, "input": "", "output": b}, {"messages": []}, {"unknown": a}, "no json", None,
    ]
    got = through(spark, records)
    two, three = [("user", a), ("assistant", b)], [("system", c), ("user", a), ("assistant", b)]
    assert got[0][:3] == ("messages", two, b)
    assert got[1][:3] == ("shared", three, b)
    assert [got[i][1] for i in (2, 3, 5)] == [two] * 3
    assert got[4][1] == three
    assert got[6][1] == [("user", a + "\n\n" + c), ("assistant", b)]
    assert got[7][1] == two
    assert got[8][:2] == ("no messages", [])
    assert [got[i][:2] for i in (9, 10, 11)] == [(None, [])] * 3


def test_random_turns_read_back(spark):
    rng = random.Random(1)
    chats = [[(rng.choice(["user", "assistant", "a: b", "", "sys#</turn>"]), rng.choice(NASTY) + rng.choice(NASTY))
              for _ in range(rng.randrange(6))] for _ in range(60)]
    got = through(spark, [{"messages": [{"role": r, "content": t} for r, t in x]} for x in chats])
    for i, x in enumerate(chats):
        assert got[i][1] == x
        assert got[i][2] == "".join(t for r, t in x if r == "assistant")
        assert got[i][3].count(" </turn>\n") == len(x)


def test_fingerprint_ignores_field_order_and_sees_nesting(spark):
    rows = ['{"a":1,"messages":[{"role":"u","content":"x"}]}', '{"messages":[{"content":"y","role":"v"}],"a":2}',
            '{"messages":["x"],"a":2}']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "record string").select(
        C.fingerprint(C.F.col("record"))).collect()]
    assert got[0] == got[1] != got[2]
    paths = sorted(["a", "messages", "messages[].role", "messages[].content"])
    assert got[0] == hashlib.sha256("\n".join(paths).encode()).hexdigest()


def test_lists_are_fingerprinted_whole(spark):
    """A later element with other fields, or that is no object, has no known layout; nothing is dropped silently."""
    ok = {"role": "user", "content": "a"}
    got = through(spark, [{"messages": [ok, {"role": "user", "content": "b", "tool": 1}]}, {"messages": [ok, "b"]},
                          {"messages": ["b"]}, {"messages": [ok, None]}, {"messages": [ok, {"content": "b"}]}, {"messages": "b"},
                          '{"prompt": "a", "completion": "b"', '{"prompt": "a", "completion": {"x": 1}}'])
    assert [got[i][:2] for i in range(4)] == [(None, [])] * 4
    assert got[4][:2] == ("messages", [("user", "a"), ("", "b")])
    assert got[5][:2] == got[6][:2] == (None, [])
    assert got[7][:2] == ("prompt", [("user", "a"), ("assistant", '{"x":1}')])


def test_texts_above_the_reader_s_limit(spark):
    """Texts of 20,000,000 characters and more, in every kind of layout, from rows and back."""
    F = C.F
    sizes = [20_000_000, 20_000_001, 25_000_000]
    rows = spark.range(len(sizes), numPartitions=len(sizes)).select(
        F.col("id").alias("conv_id"), F.array(*[F.lit(n) for n in sizes])[F.col("id").cast("int")].alias("n"))
    kinds = {"prompt": ["user", "assistant"], "shared": ["system", "user", "assistant", "user"], "messages": ["assistant", "tool"]}
    for layout, roles in kinds.items():
        turns = rows.select("conv_id", F.posexplode(F.array(*[F.lit(r) for r in roles])).alias("turn", "role"), "n").withColumn(
            "text", F.when(F.col("role") == "assistant", F.expr("concat(repeat('ab<d', cast(n / 4 as int)), repeat('z', n % 4))")).otherwise("q"))
        out = C.formatted(C.canonical_turns(C.records_of(turns)))
        found = out.select("conv_id", "layout", F.size(C.read_back(F.col("formatted"))).alias("turns"),
                           F.length(C.loss_text(F.col("formatted"), F.col("loss"))).alias("loss")).orderBy("conv_id").collect()
        assert [tuple(r) for r in found] == [(i, layout, len(roles), n) for i, n in enumerate(sizes)]


def test_conversation_rows_with_nulls(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (None, 0, None, "y"), (2, 1, "assistant", "b"), (2, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as record")
    out = C.formatted(C.canonical_turns(C.records_of(table)))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.collect()}
    assert got == {1: [("user", ""), ("assistant", "x")], None: [("", "y")], 2: [("user", "a"), ("assistant", "b")]}
    assert C.records_of(table.limit(0)).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_search(rows, queries, k):
    out = {}
    for q in queries:
        near = sorted((-float(np.dot(rows[q], rows[v])), v) for v in rows if v != q)[:k]
        out[q] = [v for _, v in near]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24))) * rng.uniform(0.3, 2, (3000, 1))
    rows = {i: v.astype(np.float32).astype(float) for i, v in enumerate(x)}
    table = vectors(spark, [(i, v.tolist()) for i, v in rows.items()])
    got = {}
    for r in M.search(table, table.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = plain_search(rows, [i for i in rows if i % 20 == 0], 10)
    assert set(got) == set(want)
    hits = sum(len({r.vec_id for r in got[q]} & set(want[q])) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(abs(r.score - np.dot(rows[q], rows[r.vec_id])) < 1e-9 for r in found)


def test_pigeonhole_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (500, 4)).astype(np.uint8)
    for radius in (0, 3, 7, 10):
        index = M.Index(codes, radius)
        for code in codes[:40]:
            want = np.flatnonzero(np.bitwise_count(codes ^ code).sum(1) <= radius)
            assert index.retrieve(code).tolist() == want.tolist()


def test_unusable_vectors_ties_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (40, None), (60, [0.0, 0.0]),
            (80, [float("nan"), 1.0]), (100, [None, 1.0]), (120, [float("inf"), 0.0]), (140, []), (160, [1.0]), (None, [1.0, 0.0])]
    table = vectors(spark, rows).selectExpr("*", "1 as id", "2 as v", "3 as rb")
    got = M.search(table, table.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 2), (0, 3), (0, 20), (20, 2), (20, 3), (20, 0)]
    assert M.search(table.limit(0), table.limit(0)).count() == 0
