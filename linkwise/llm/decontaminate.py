"""Benchmark passages inside documents, under word edit distance.

A document holds benchmark item t (n words) if some window of its words is within
``max_edits(n)`` = floor((1 - similarity) n) word edits of the item. Words are
lower-cased runs of letters and digits.

1. Seeds. An alignment with e edits of n words leaves a run of at least
   ceil((n - e) / (e + 1)) unedited words, so a window without any such run of the
   item (runs of q = 3 words are used, shorter ones for very short items) cannot
   match, and by the q-gram lemma it shares at least n - q + 1 - q e runs with the
   item, on diagonals at most 2 e apart: skipping other windows loses nothing. Dense
   diagonals name the item-sized windows that go on.
2. CGK embedding (Chakraborty, Goldenberg and Koucky 2016). A random walk reads a
   sequence of n words into 3n places; at each place a random bit, drawn from
   (repetition, place, word), decides whether the walk moves on. Sequences within few edits get
   embeddings within small Hamming distance.
3. Bit-sampling LSH: each repetition draws its own walk and compares ``BITS``
   sampled places of the window with the item's. ``repetitions(recall)`` walks
   are run; a window that agrees on one of them is a candidate.
4. Exact verification: banded word edit distance of the best local alignment of
   the item around the window.

Items are read in blocks of ``ITEM_BLOCK`` rows, so what a task holds is bounded
for any benchmark size; documents are scanned once per block, as whole texts.
Null, empty and wordless items match nothing; null and empty texts hold nothing.
Repeated items are all reported. Repeated rows get repeated result rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwise.llm.common import id_text

SIMILARITY = 0.8
RECALL = 0.99
ITEM_BLOCK = 20_000
BITS = 2
SEED_WORDS = 3
#: Share of embedding places on which sequences at the edit limit agree at least, measured on edited items.
AGREEMENT = 0.5
WORD = re.compile(r"[^\W_]+")


def max_edits(n: int, similarity: float = SIMILARITY) -> int:
    return int(math.floor((1 - similarity) * n + 1e-9))


def repetitions(recall: float = RECALL) -> int:
    """Walks needed so that a pair at the edit limit agrees on one of them."""
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREEMENT**BITS))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (public-domain constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def embed_at(words: np.ndarray, starts: np.ndarray, n: int, repetition: int, places: np.ndarray) -> np.ndarray:
    """CGK embedding of the n-word windows at ``starts``, at the sampled (sorted) places.

    ``words`` are positive ids (0: a word of no item). The walk stops at the window's end, where
    the embedding is padded with -1.
    """
    out = np.full((len(places), len(starts)), -1, np.int64)
    at = np.zeros(len(starts), np.int64)
    row = 0
    for place in range(int(places[-1]) + 1):
        inside = at < n
        word = np.where(inside, words[np.minimum(starts + at, len(words) - 1)], -1)
        while row < len(places) and places[row] == place:
            out[row] = word
            row += 1
        salt = np.uint64((repetition * 1_000_003 + place) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        at += (mix(word.astype(np.uint64) ^ salt) & np.uint64(1)).astype(np.int64) & inside
    return out


def local_distance(item: list[int], window: list[int]) -> int:
    """Least edits that turn the item into some run of the window (ends of the window are free)."""
    previous = [0] * (len(window) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(window, 1):
            row.append(min(previous[j - 1] + (a != b), previous[j] + 1, row[j - 1] + 1))
        previous = row
    return min(previous)


class Index:
    """What a task needs of one block of items: word ids, seeds and embeddings."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, recall: float = RECALL):
        self.similarity, self.repeats = similarity, repetitions(recall)
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.need: list[int] = []
        seeds: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for key, text in items:
            words = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in WORD.findall((text or "").lower())],
                             np.int64)
            n = len(words)
            if not n:
                continue
            e = max_edits(n, similarity)
            size = min(SEED_WORDS, math.ceil((n - e) / (e + 1)))
            at = len(self.items)
            self.items.append((key, words))
            self.need.append(max(1, n - size + 1 - size * e))
            for j in range(n - size + 1):
                seeds[size][tuple(words[j:j + size].tolist())].append((at, j))
        self.seeds = {size: dict(by) for size, by in seeds.items()}
        self.base = len(self.ids) + 1
        #: by seed length, the sorted codes of the seeds
        self.codes = {size: np.unique(np.array([self._code(g) for g in by], np.uint64)) for size, by in
                      self.seeds.items()}
        self.walks: dict[int, list] = {}
        self._embedded: dict[tuple[int, int], np.ndarray] = {}

    def _code(self, gram) -> np.uint64:
        """Number of a word run, modulo 2^64; equal codes are checked word by word."""
        c = 0
        for w in gram:
            c = c * self.base + int(w)
        return np.uint64(c & (2**64 - 1))

    def _places(self, n: int, repetition: int) -> np.ndarray:
        rng = np.random.default_rng([n, repetition])
        return np.sort(rng.choice(3 * n, size=min(BITS, 3 * n), replace=False))

    def item_code(self, at: int, repetition: int) -> np.ndarray:
        got = self._embedded.get((at, repetition))
        if got is None:
            words = self.items[at][1]
            got = embed_at(words, np.zeros(1, np.int64), len(words), repetition,
                           self._places(len(words), repetition))[:, 0]
            self._embedded[(at, repetition)] = got
        return got

    def seeded(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """Item -> starts of its item-sized windows that share enough runs with it."""
        diagonals = defaultdict(list)
        for size, by in self.seeds.items():
            if len(words) < size:
                continue
            known = words > 0
            for k in range(1, size):
                known = known[:-1] & (words[k:] > 0)
            where = np.flatnonzero(known)
            if not len(where):
                continue
            code = np.zeros(len(where), np.uint64)
            for k in range(size):
                code = code * np.uint64(self.base) + words[where + k].astype(np.uint64)
            codes = self.codes[size]
            slot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            for p in where[codes[slot] == code].tolist():
                for at, j in by.get(tuple(words[p:p + size].tolist()), ()):
                    diagonals[at].append(p - j)
        out = {}
        for at, found in diagonals.items():
            n = len(self.items[at][1])
            e, need = max_edits(n, self.similarity), self.need[at]
            if len(found) < need:
                continue
            d = np.sort(np.array(found, np.int64))
            low, high = d[:len(d) - need + 1], d[need - 1:]
            dense = high - low <= 2 * e
            near = {s for a, b in zip(high[dense].tolist(), low[dense].tolist()) for s in range(a - e, b + e + 1)}
            out[at] = np.array(sorted(s for s in near if 0 <= s < len(words)), np.int64)
        return out

    def retrieved(self, words: np.ndarray, at: int, starts: np.ndarray) -> bool:
        """Whether a window at one of the starts agrees with the item in one of the repetitions."""
        n = len(self.items[at][1])
        for r in range(self.repeats):
            code = embed_at(words, starts, n, r, self._places(n, r))
            if (code == self.item_code(at, r)[:, None]).all(0).any():
                return True
        return False

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, start word, end word, edits) of every item that the text holds."""
        if not text or not self.items:
            return []
        get = self.ids.get
        words = np.array([get(w, 0) for w in WORD.findall(text.lower())], np.int64)
        if not words.any():
            return []
        found = []
        for at, starts in self.seeded(words).items():
            if not len(starts):
                continue
            key, item = self.items[at]
            e, wanted, best = max_edits(len(item), self.similarity), item.tolist(), None
            # starts close to each other are one place of the text: one hit there leads to one verification
            for place in np.split(starts, np.flatnonzero(np.diff(starts) > e + 1) + 1):
                if not self.retrieved(words, at, place):
                    continue
                for a in range(int(place[0]), int(place[-1]) + 1, len(item)):
                    lo, hi = max(0, a - e), min(len(words), min(a + len(item) - 1, int(place[-1])) + len(item) + e)
                    d = local_distance(wanted, words[lo:hi].tolist())
                    if d <= e and (best is None or d < best[3]):
                        best = (key, lo, hi, d)
            if best:
                found.append(best)
        return found


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = ITEM_BLOCK):
    """The items in blocks of at most ``block`` rows, in id order."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    part: list[tuple[int, str]] = []
    for r in rows.where("text is not null").orderBy("item", "text").toLocalIterator():
        part.append((r["item"], r["text"]))
        if len(part) == block:
            yield part
            part = []
    if part:
        yield part


MATCH = "array<struct<item:long,start_word:int,end_word:int,edits:int>>"


def matched(items: list[tuple[int, str]], similarity: float = SIMILARITY, recall: float = RECALL):
    """Column function: the items of one block that a text holds."""

    @F.pandas_udf(MATCH)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(items, similarity, recall)
        names = ("item", "start_word", "end_word", "edits")
        for texts in batches:
            yield pd.Series([[dict(zip(names, m)) for m in sorted(index.matches(t))] for t in texts], dtype=object)

    return find


def contained_items(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                    recall: float = RECALL) -> DataFrame:
    """(id, matches): one row per input row; matches lists the items held."""
    found = [matched(items, similarity, recall)(F.col("text")) for items in item_blocks(benchmark)]
    if not found:
        return id_text(docs).select("id", F.array().cast(MATCH).alias("matches"))
    return id_text(docs).select("id", F.flatten(F.array(*found)).alias("matches"))


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", similarity: float = SIMILARITY,
                  recall: float = RECALL) -> DataFrame:
    """The rows whose text holds no item, with all their columns."""
    for items in item_blocks(benchmark):
        docs = docs.where(F.size(matched(items, similarity, recall)(docs[text_col])) == 0)
    return docs
