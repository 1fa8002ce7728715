"""First-fit decreasing by tournament trees: against a plain first fit and the tokenizer library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from linkwise.llm import catalog, tournament_packing as packing
from linkwise.llm.common import out_id

from .conftest import EDGE_ROWS
from .test_tokens import odd_texts

PATH = catalog.tokenizer_file("word_bpe_49k.json")


def plain_first_fit(sizes, capacity):
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b in bins:
            if sum(sizes[j] for j in b) + sizes[i] <= capacity:
                b.append(i)
                break
        else:
            bins.append([i])
    return bins


def test_tree_finds_the_first_sequence_with_room():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 7, 8, 9, 60):
        for _ in range(20):
            sizes = [rng.randint(1, 50) for _ in range(n)]
            assert packing.first_fit_decreasing(sizes, 50) == plain_first_fit(sizes, 50)


@pytest.mark.parametrize("low, high", [(1, 64), (33, 40), (64, 64), (1, 3)])
def test_padding_is_bounded_whatever_the_lengths(low, high):
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(500)]
    fill, seen = defaultdict(int), defaultdict(int)
    for item, start, length, sequence, offset in packing.arrange(sizes, 64, 2):
        assert start == seen[item] and offset == fill[sequence] and length > 0
        seen[item] += length
        fill[sequence] += length
    assert dict(seen) == dict(enumerate(sizes))
    assert all(64 - 2 <= f <= 64 or f & (f - 1) == 0 for f in fill.values())
    assert sorted(fill) == list(range(len(fill)))


def check_pack(df, rows, capacity, closing, **options):
    tok = Tokenizer.from_file(PATH)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, closing] for i, t in rows}
    found = packing.pack(df, PATH, capacity, closing, **options).withColumn("id", out_id("id")).collect()
    fill, by_doc, total = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in found:
        part = ids[r.id][r.start:r.start + r.length]
        assert len(part) == r.length and r.crc == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.id])
        fill[r.sequence].append((r.offset, r.length))
        by_doc[r.id].append((r.start, r.length))
        total[r.id] += r.length
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    times = defaultdict(int)
    for i, _ in rows:
        times[i] += 1
    assert total == {i: len(x) * times[i] for i, x in ids.items()}
    for i, parts in by_doc.items():
        if times[i] == 1:
            end = 0
            for start, length in sorted(parts):
                assert start == end
                end += length
    return found


def test_packs_every_id_once(make):
    rng = random.Random(3)
    words = "the of and one two Haus über naïve x1 <|startoftext|> 中文".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.choice((0, 1, 5, 40, 200))))) for i in range(300)]
    found = check_pack(make(rows), rows, 64, 1, group=50, slack=2)
    used = sum(r.length for r in found)
    sequences = defaultdict(int)
    for r in found:
        sequences[r.sequence] += r.length
    assert sum(64 - n for n in sequences.values() if n & (n - 1)) <= 2 * len(sequences) and used


def test_edge_rows(make):
    found = check_pack(make(EDGE_ROWS, clashing=True), EDGE_ROWS, 2048, 1)
    assert len([r for r in found if r.id in (2, 3, 4)]) >= 3
    assert packing.pack(make([]), PATH).count() == 0


def test_word_ids_are_the_library_s(monkeypatch):
    tok = Tokenizer.from_file(PATH)
    texts = odd_texts(3000, seed=9) + ["<|StartOfText|> a", "<|startoftext|>", "A.B, ÀÉ. don't", "µ ß ÿ", "Word. word, WORD"]
    for size in (300_000, 3):
        monkeypatch.setattr(packing, "CACHE_WORDS", size)
        packing._state.clear()
        for t in texts:
            got = np.frombuffer(packing.document_ids(t, PATH), "<u4").tolist()
            assert got == tok.encode(t, add_special_tokens=False).ids


def test_wide_ids_are_kept():
    raw = np.array([1, 70_000], "<u4").tobytes()
    assert packing._wide(packing._narrow(raw)).tolist() == [1, 70_000]
    assert packing._wide(packing._narrow(raw[:4])).tolist() == [1]


def test_registered_query_packs_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = catalog.op11_tournament_packing(spark, sf).collect()
    tok = Tokenizer.from_file(PATH)
    got, fill = defaultdict(dict), defaultdict(int)
    for r in found:
        got[r.doc_id][r.start] = (r.length, r.ids_crc32)
        fill[r.sequence_id] += r.length
    for i, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        while at < len(ids):
            length, crc = got[i].pop(at)
            assert crc == zlib.crc32(ids[at:at + length].tobytes())
            at += length
        assert not got[i]
    padding = sum(2048 - n for n in fill.values() if n & (n - 1))
    assert max(fill.values()) <= 2048 and padding <= 0.01 * sum(fill.values())
