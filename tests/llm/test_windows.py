"""Word windows (recompression) and byte strings (induced sorting) against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from linkwise.llm import recompression as R
from linkwise.llm import suffix_dedup as S
from linkwise.llm import windows as X

from .conftest import EDGE_ROWS


def plain_words(rows, width=20):
    """{id: (words, removed, kept hash)}; rows have distinct ids."""
    texts = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - width + 1):
            first.setdefault(tuple(texts[i][s:s + width]), (i, s))
    out = {}
    for i, words in texts.items():
        gone = set()
        for s in range(len(words) - width + 1):
            if first[tuple(words[s:s + width])] != (i, s):
                gone.update(range(s, s + width))
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def plain_bytes(rows, width=50):
    """{id: (bytes, removed, spans, kept hash)}; rows have distinct ids."""
    texts = {i: (t or "").encode() for i, t in rows}
    least = {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - width + 1):
            least.setdefault(texts[i][s:s + width], i)
    out = {}
    for i, raw in texts.items():
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - width + 1):
            if least[raw[s:s + width]] < i:
                gone[s:s + width] = True
        spans = sum(1 for j in range(len(raw)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def corpus(seed, letters="abc", size=60):
    """Texts that share passages, repeat themselves, and hold runs of one word."""
    rng = random.Random(seed)
    words = [rng.choice(letters) * rng.randint(1, 4) for _ in range(12)] + ["é", "ß"]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 45))] for _ in range(5)]
    passages += [["a"] * rng.randint(18, 60), ["b", "a"] * 15]
    rows = []
    for i in range(size):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
        rows.append((rng.randrange(10**6) * 100 + i, rng.choice([" ", "  ", "\n"]).join(text)))
    return rows


def test_words_match_brute_force(make):
    for seed in (1, 2):
        rows = corpus(seed)
        got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in R.deduplicated(make(rows)).collect()}
        assert got == plain_words(rows)


def test_bytes_match_brute_force(make):
    for seed in (3, 4):
        rows = corpus(seed)
        got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.deduplicated(make(rows)).collect()}
        assert got == plain_bytes(rows)


def test_equal_windows_have_equal_anchors():
    """Whatever stands around a window, its anchor place, side and key depend on the window alone."""
    rng = random.Random(5)
    for finder, unit in ((R.Recompression(), " "), (S.Anchors(), "")):
        for _ in range(200):
            letters = rng.choice(["ab", "abcdefgh"])
            window = [rng.choice(letters) for _ in range(finder.width)]
            seen = set()
            for _ in range(4):
                before = [rng.choice(letters) for _ in range(rng.randrange(40))]
                after = [rng.choice(letters) for _ in range(rng.randrange(40))]
                units = finder.units(unit.join(before + window + after))
                codes = X.codes_of(finder, units)
                code = codes[len(before)]
                seen.add((code - 2 * len(before), finder.keys(units, np.array([code]))[0]))
            assert len(seen) == 1


def test_long_texts_go_through_in_stretches(monkeypatch):
    rng = np.random.default_rng(6)
    text = bytes(rng.integers(97, 100, 5_000).astype(np.uint8)).decode()
    finder = S.Anchors()
    whole = X.codes_of(finder, finder.units(text))
    monkeypatch.setattr(X, "STRETCH", 333)
    assert (X.codes_of(finder, finder.units(text)) == whole).all()


def test_symbols_pair_by_name_alone():
    names = R.word_hashes("a b a b a a a c a b")
    starts, symbols = R.Recompression.symbols(names, rounds=1)
    by_span = {}
    ends = [*starts[1:].tolist(), len(names)]
    for a, b, s in zip(starts.tolist(), ends, symbols.tolist()):
        assert b - a <= 2
        assert by_span.setdefault(tuple(names[a:b].tolist()), s) == s
    assert len(set(by_span.values())) == len(by_span)


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(7)
    for letters, n in ((1, 60), (2, 80), (3, 400), (200, 800)):
        for _ in range(10):
            t = rng.integers(1, letters + 1, n).astype(np.uint16)
            assert S.suffix_array(t, 10**9).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_edge_rows(make):
    for operator in (R.deduplicated, S.deduplicated):
        found = operator(make(EDGE_ROWS, clashing=True)).collect()
        assert len(found) == len(EDGE_ROWS)
        by_id = {r.id: r for r in found}
        empty = hashlib.sha256(b"").hexdigest()
        assert by_id[2].kept_sha256 == by_id[3].kept_sha256 == empty
        assert by_id[1].n_removed == 0
        assert operator(make([])).count() == 0
    words = {r.id: r for r in R.deduplicated(make(EDGE_ROWS)).collect()}
    assert (words[5].n_words, words[5].n_removed) == (30_000, 29_999)


def test_kept_texts(make):
    rows = [(1, " ".join(f"w{i}" for i in range(30))), (2, "start " + " ".join(f"w{i}" for i in range(25)) + " end")]
    kept = {r.id: r.kept for r in R.deduplicated(make(rows), keep_text=True).collect()}
    assert kept[2] == "start end"
    raw = {r.id: r.kept for r in S.deduplicated(make(rows), keep_bytes=True).collect()}
    assert bytes(raw[2]) == b"start end"


def test_frequent_grams_are_dealt_by_context(make, monkeypatch):
    """No shard takes all stretches of a common gram, and what is found stays the same."""
    rng = random.Random(8)
    for name, value in (("SLICES", 4), ("SLICE", 60), ("GRAM_BYTES", 300), ("SORT_BYTES", 500)):
        monkeypatch.setattr(S, name, value)
    rows = [r for seed in (9, 10) for r in corpus(seed, size=40)]
    lines = [f"{rng.choice('pq') * 30} common words {rng.choice('xyz') * 35}" for _ in range(60)]
    rows += [(10**9 + i, f"{line} tail {line}") for i, line in enumerate(lines)]
    docs = make(rows)
    finder, texts, size = S.Anchors(), X.versioned(docs), sum(len(t) for _, t in rows)
    frequent = S.frequent_grams(texts, finder, size)
    assert len(frequent) and (np.diff(frequent.astype(object)) > 0).all()
    found = X.with_places(texts, X.revealed(texts, finder, 4, across=True), "inner")
    runs = [sorted(map(tuple, S.verified(found, finder, 4, hot).collect())) for hot in (np.zeros(0, np.uint64), frequent)]
    assert runs[0] == runs[1] and runs[0]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.deduplicated(docs).collect()}
    assert got == plain_bytes(rows)


def test_shards_are_sorted_in_chunks(monkeypatch):
    """A shard of many grams is never sorted whole; the chunks find what the whole finds."""
    rng = random.Random(11)
    heads = [f"gram{i:04d}" for i in range(40)]
    parts = [("<" + rng.choice(heads) + "-" * 40 + rng.choice("ab") + "=" * 5).encode() for _ in range(2000)]
    parts += [p + b"!" for p in parts[::7]]
    anchors, ids = np.ones(len(parts), np.uint16), np.arange(len(parts))[::-1].copy()
    sizes, sort = [], S.suffix_array
    monkeypatch.setattr(S, "suffix_array", lambda t, depth: sizes.append(len(t)) or sort(t, depth))
    found = []
    for most in (10**9, 600):
        monkeypatch.setattr(S, "SORT_BYTES", most, raising=False)
        sizes.clear()
        found.append(sorted(zip(*[x.tolist() for x in S.shard_repeats(parts, anchors, ids)])))
    assert found[0] == found[1] and found[0]
    assert len(sizes) > 1 and max(sizes) < 1_000


def test_batches_are_worked_on_in_portions(monkeypatch):
    monkeypatch.setattr(X, "PORTION", 10, raising=False)
    texts = ["", "abcd", "é" * 9, "", "a", "b" * 25, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    sizes = [[len(t.encode()) for t in p.column("text").to_pylist()] for p in X.portions(batch)]
    assert sum(sizes, []) == [len(t.encode()) for t in texts]
    assert len(sizes) > 2 and all(sum(s) - s[0] <= 10 for s in sizes)
