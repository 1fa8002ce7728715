"""The pipeline against a brute-force version on the smallest tables."""

from tokenizers import Tokenizer

import corpus_pipeline as P
from linkwise.llm import catalog
from linkwise.llm import decontaminate as D

from ..conftest import SF_SMALL
from .conftest import EDGE_ROWS
from .test_pii import plain_base
from .test_simhash import plain_components, plain_fingerprint
from .test_tokens import check_packed


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    first = P.reject_toxic(spark, docs, SF_SMALL)
    assert first.columns == docs.columns and first.count() <= docs.count()
    kept = {r.doc_id: r.text for r in first.collect()}

    groups = plain_components({i: plain_fingerprint(t) for i, t in kept.items()}, 2)
    second = P.keep_one_of_group(spark, first, SF_SMALL)
    assert second.columns == docs.columns
    assert sorted(r.doc_id for r in second.collect()) == sorted(set(groups.values()))

    bench = [(r.item_id, D.WORD.findall(r.text.lower())) for r in
             spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    third = P.drop_contaminated(spark, second, SF_SMALL)
    left = {r.doc_id: r.text for r in third.collect()}
    index = D.Index([(i, " ".join(w)) for i, w in bench])
    for r in second.collect():
        words = [index.ids.get(w, 0) for w in D.WORD.findall(r.text.lower())]
        held = any(D.local_distance([index.ids[w] for w in item], words) <= D.max_edits(len(item))
                   for _, item in bench if len(item) <= len(words) + D.max_edits(len(item)))
        assert held == (r.doc_id not in left)

    fourth = P.redact_pii(spark, third, SF_SMALL)
    assert fourth.columns == docs.columns
    redacted = {r.doc_id: (r.text, r.n_chars) for r in fourth.collect()}
    assert set(redacted) == set(left)
    for i, (text, n) in redacted.items():
        assert n == len(text)
        if not plain_base(left[i]):
            assert text == left[i]
        else:
            assert plain_base(text) == []

    rows = P.pack(spark, fourth, SF_SMALL).collect()
    packed = [type("R", (), {"id": r.doc_id, "piece": r.piece, "start": r.start, "length": r.length, "crc": r.ids_crc32,
                             "sequence": r.sequence_id, "offset": r.offset}) for r in rows]
    check_packed(packed, [(i, t) for i, (t, _) in redacted.items()],
                 Tokenizer.from_file(catalog.tokenizer_file("word_bpe_49k.json")), 2048)


def test_run_gives_the_last_stage(spark):
    got = P.run(spark, SF_SMALL)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_edge_rows_pass(spark, make):
    docs = make([*EDGE_ROWS, (7, "write to me at a@b.co"), (7, "write to me at a@b.co")]).selectExpr(
        "*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", "1 as component", "2 as kind")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns
        docs = P.materialize(out, "edge")
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    # wordless texts are one group; repeated rows are one document; a null id stays
    assert {i for i, _ in rows} == {1, None, 2, 5, 6, 7}
    assert docs.count() == 6
    assert (7, "write to me at [EMAIL]") in rows
    assert P.pack(spark, docs, SF_SMALL).count() >= 6
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0
