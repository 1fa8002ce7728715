"""Token counts and packing against the tokenizer library."""

import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from tokenizers import Tokenizer

from linkwise.llm import catalog, packing, token_counts

from .conftest import EDGE_ROWS

COUNTED, PACKED = (catalog.tokenizer_file(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LETTERS = [*"ab'st 1.é日İΣﬁſß\t\n\x85\xa0 ​᠎ 　\x1c\x1f́,", "<|endoftext|>",
           "<|startoftext|>", "'ll", "  ", "Wort", "über."]


@pytest.fixture(scope="module")
def tokenizers():
    return Tokenizer.from_file(COUNTED), Tokenizer.from_file(PACKED)


def odd_texts(n, seed=1, size=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(size))) for _ in range(n)]


def test_stretches_and_words_give_the_library_s_tokens(tokenizers):
    for t in odd_texts(4000):
        assert token_counts.count_tokens(t, COUNTED) == len(tokenizers[0].encode(t, add_special_tokens=False).ids)
        got = np.frombuffer(packing.token_bytes(t, PACKED), "<u4").tolist()
        assert got == tokenizers[1].encode(t, add_special_tokens=False).ids


def test_latin_words_take_the_short_way_right(tokenizers):
    for c, tail in product(range(0xA1, 0x100), ("", ".", ",")):
        word = chr(c) * 2 + "aB" + tail
        got = np.frombuffer(packing.token_bytes(word, PACKED), "<u4").tolist()
        assert got == tokenizers[1].encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk, overlap", [(300, 8), (64, 2)])
def test_spliced_counts(make, tokenizers, chunk, overlap):
    rows = [(i, t * 30) for i, t in enumerate(odd_texts(25, seed=2, size=60))]
    rows += [(100, "a" * 3000), (101, "x y " * 700), (102, ("b" * 700 + " ") * 4 + "<|endoftext|> " * 90), (103, " " * 900 + "q")]
    got = {r.id: (r.n_bytes, r.n_tokens)
           for r in token_counts.token_counts(make(rows), COUNTED, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: (len(t.encode()), len(tokenizers[0].encode(t, add_special_tokens=False).ids)) for i, t in rows}


def test_token_count_edge_rows(make):
    found = token_counts.token_counts(make(EDGE_ROWS, clashing=True), COUNTED).collect()
    assert len(found) == len(EDGE_ROWS)
    assert {r.n_tokens for r in found if r.id in (2, 3)} == {0}
    assert token_counts.token_counts(make([]), COUNTED).count() == 0


def fewest(lengths, capacity):
    """Fewest bins by trying all ways (few items)."""
    best = [len(lengths)]
    items = sorted(lengths, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, rest + [room - items[i]])
        go(i + 1, rooms + [capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    """The fixed sets and an optimal packing of the rest are an optimal packing of all."""
    rng = random.Random(3)
    fixed_any = 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 33])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.reduce_instance(Counter(lengths), capacity)
        used = Counter()
        for contents, times in fixed:
            assert sum(contents) <= capacity
            for w in contents:
                used[w] += times
        assert used + Counter(rest) == Counter(lengths)
        left = [w for w, c in rest.items() for _ in range(c)]
        fixed_any += bool(fixed)
        assert sum(t for _, t in fixed) + fewest(left, capacity) == fewest(lengths, capacity)
    assert fixed_any > 50


def test_plan_is_a_partition_of_ranks_without_gaps():
    rng = random.Random(4)
    counts = Counter(min(2048, int(rng.expovariate(1 / 500)) + 1) for _ in range(5000))
    places, filled = packing.plan(counts), Counter()
    ends = {}
    for w, rows in places.items():
        assert rows[0, 0] == 0 and (np.diff(rows[:, 0]) > 0).all()
        bounds = np.append(rows[:, 0], counts[w])
        for (rank, sequence, offset), to in zip(rows.tolist(), bounds[1:].tolist()):
            for k in range(to - rank):
                ends.setdefault(sequence + k, []).append((offset, w))
                filled[w] += 1
    assert filled == counts
    for parts in ends.values():
        at = 0
        for offset, w in sorted(parts):
            assert offset == at
            at += w
        assert at <= 2048
    assert len(ends) <= sum(w * c for w, c in counts.items()) // 2048 + 2


def check_packed(rows, texts, tokenizer, capacity):
    want = Counter()
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want[(i, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.crc) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_packed_pieces(make, tokenizers):
    texts = [(i, t * (i % 7)) for i, t in enumerate(odd_texts(120, seed=5, size=50))]
    rows = packing.pack(make(texts), PACKED, capacity=64).collect()
    check_packed(rows, texts, tokenizers[1], 64)


def test_packing_edge_rows(make, tokenizers):
    rows = packing.pack(make(EDGE_ROWS, clashing=True), PACKED).collect()
    check_packed(rows, [(i if i is not None else 2**63 - 1, t) for i, t in EDGE_ROWS], tokenizers[1], 2048)
    assert packing.pack(make([]), PACKED).count() == 0
