import random
import re

import numpy as np
import pytest
import xxhash

from linkwise.llm import simhash as S

from .conftest import EDGE_ROWS


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(prints, bits):
    """{doc: smallest doc reachable} over known ids."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_is_the_majority_of_shingle_hashes():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " ".join(rng.choice(["Ab", "cd", "É", "x9"]) for _ in range(n))
        assert S.fingerprint(text) == plain_fingerprint(text)


def test_embedding_is_a_lower_bound_and_cells_keep_every_near_pair():
    rng = np.random.default_rng(2)
    masks = [m & (2**64 - 1) for m in S.cell_masks(2)]
    for _ in range(300):
        a = int(rng.integers(0, 2**63)) * 2 + 1
        b = a
        for bit in rng.choice(64, 2, replace=False):
            b ^= 1 << int(bit)
        ea, eb = (int(S._unary(np.array([x], np.uint64))[0]) for x in (a, b))
        assert (ea ^ eb).bit_count() <= (a ^ b).bit_count()
        assert any(ea & m == eb & m for m in masks)


@pytest.mark.parametrize("cell_rows", [20_000, 1])
def test_components_match_brute_force(spark, make, cell_rows):
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(120)] for _ in range(12)]
    rows = []
    for i in range(70):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words)))
    got = {r.id: (r.fp & (2**64 - 1), r.component)
           for r in S.near_duplicates(make(rows), max_bits=2, cell_rows=cell_rows).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(prints, 2)
    assert got == {i: (prints[i], want[i]) for i in prints}
    assert len(set(want.values())) < len(rows)


def test_edge_rows(make):
    found = S.near_duplicates(make(EDGE_ROWS, clashing=True)).collect()
    assert len(found) == len(EDGE_ROWS)
    by_id = {r.id: (r.fp, r.component) for r in found}
    assert by_id[2] == by_id[3] == by_id[4] == (0, 2)
    assert by_id[2**63 - 1][1] is None
    assert S.near_duplicates(make([])).count() == 0
