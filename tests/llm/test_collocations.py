"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkwise.llm import catalog, collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, support, top=2000, explained=100, longest=5):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        covered = set()
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * a >= explained * f[p[i:j]]:
                        covered.add(p[i:j])
        found = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score)
                for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["The", "of", "New", "York", "city", "é", "ÉT", "a\x00b", "x\x1cy", "\xa0", "1", "zu", "Haus"]
    seps = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r", "!", " ? "]
    return [(rng.choice(["en", "de", None]), None if rng.random() < 0.05 else "".join(
        rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.fixture
def docs(spark):
    def build(rows, parts=3):
        return spark.createDataFrame(rows, "lang string, text string").selectExpr(
            "*", "1 as k", "'p' as phrase", "2 as n", "3 as bit", "'s' as score").repartition(parts)

    return build


@pytest.mark.parametrize("support, shards, chunk, bits, explained", [
    (5, 1, 10**6, 20, 100), (12, 4, 700, 20, 100), (5, 3, 300, 15, 60), (1, 200, 500, 16, 100)])
def test_against_a_plain_count(docs, support, shards, chunk, bits, explained):
    rows = corpus(120)
    found = C.collocations(docs(rows), support, top=40, explained=explained, shards=shards, chunk=chunk, bits=bits)
    assert rows_of(found) == plain(rows, support, 40, explained)


def test_collisions_change_no_result(docs):
    rows = corpus(60, seed=2)
    full = C.frequent_phrases(docs(rows), 6, chunk=500, bits=15).collect()
    roomy = C.frequent_phrases(docs(rows), 6, chunk=500, bits=24).collect()
    assert sorted(full) == sorted(roomy)


def test_a_phrase_spread_over_all_shards_is_found(docs):
    rows = [("en", f"w{i} left right v{i}") for i in range(40)]
    assert ("en", 1, "left right", 40, 40, 40, 160, 4000) in rows_of(C.collocations(docs(rows, 8), 40, shards=20, chunk=20))


def test_supports_follow_the_shares_of_bytes(docs):
    import zlib

    rows = [("en", f"text {i} " * (1 + i % 7)) for i in range(50)] + [("en", "copy " * 40)] * 30
    got = C.local_supports(C.shard_sizes(C._texts(docs(rows)), 4), 100)
    sizes = Counter()
    for _, text in rows:
        sizes[zlib.crc32(text.encode()) % 4] += len(text)
    assert got == {k: -(-100 * v // sum(sizes.values())) for k, v in sizes.items()} and sum(got.values()) >= 100


def test_shards_are_mined_completely(docs):
    """Every phrase with the lowered support in a shard has its bit set, whatever the chunks."""
    import zlib

    rows = [(lang, text) for lang, text in corpus(80, seed=4) if text]
    texts, by_shard = C._texts(docs(rows)), defaultdict(list)
    for lang, text in rows:
        by_shard[zlib.crc32(text.encode()) % 3].append((lang, text))
    least = C.local_supports(C.shard_sizes(texts, 3), 20)
    known = texts.sparkSession.sparkContext.broadcast(
        C.bitmap(C.locally_frequent(texts, least, range(1, 3), None, 3, 400, 24), 24))
    longer = C.bitmap(C.locally_frequent(texts, least, range(3, 6), known, 3, 400, 24), 24)
    for shard, part in by_shard.items():
        chunk = C.Chunk()
        for lang, text in part:
            chunk.add((lang if lang is not None else "und",), text.encode())
        words = C.word_hashes(chunk.number)
        for (lang,), ids in chunk.groups():
            for k, places, counts in C.grams(ids, 5, lambda k, p, c: c >= least[shard]):
                assert C.set_in(known.value if k < 3 else longer, C.hashes(ids, words, lang, k, places), 24).all()


def test_empty_and_blank(docs):
    assert C.collocations(docs([]), 2).count() == 0
    assert C.collocations(docs([("en", None), ("en", ""), (None, " .\n")]), 2).count() == 0


def test_products_beyond_64_bits(spark):
    a, n = 4_000_000_000, 9_000_000_000_000
    rows = [("en", "", 0, n), ("en", "x", 1, a), ("en", "y", 1, a + 7), ("en", "x y", 2, a - 3)]
    found = C.scored(spark.createDataFrame(rows, "lang string, phrase string, k int, n long")).collect()[0]
    assert found.score == 1000 * (a - 3) * n // (a * (a + 7))


def test_grams_of_one_text():
    ids = np.array([0, 1, 0, 1, -1, 0, 1, -1], np.int32)
    got = {k: dict(zip(p.tolist(), c.tolist())) for k, p, c in C.grams(ids, 3, lambda k, p, c: c >= 1)}
    assert got == {1: {0: 3, 1: 3}, 2: {0: 3, 1: 1}, 3: {0: 1, 1: 1}}


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(catalog.op13_collocations(spark, sf)) == plain(rows, 100)
