"""Repeated word windows by recompression.

Recompression (Jez 2015) names what it meets in rounds: the alphabet is split into left and
right symbols, every pair of a left and a right one becomes a new symbol, and so on over the shorter sequence.
Here a symbol's name is a 64-bit hash of what it stands for, so all tasks give equal
pairs equal names without exchanging an alphabet, and the split of each round is a bit of that name.
A run of one symbol never pairs with itself and stays a run of that name, since naming
a run by its length would depend on words beyond a window's edge.

* Consistency: whether two neighbours are joined depends on them alone. After two rounds a
  symbol spans at most 4 words, and all symbols that begin at least 3 words after a
  window's start and at least 7 before its end are the same wherever the window's words occur.
* Reveal: the symbol with the least name there is the window's anchor. The 10 words left of
  it or the 11 from it on, whichever lie in the window, are its context; contexts that occur again are
  revealed (first shuffle).
* Verify: the windows of revealed anchors are compared by a 128-bit hash of all their words
  (second shuffle); a word is removed if a window over it has the same words as one that starts
  earlier: in a smaller document id, or in the same document further left. Inside one
  batch the earliest of equal windows stands for all, so a passage that a third of
  all documents share is not gathered in one task.

Words are the stretches between ASCII blanks, unchanged. Null and empty texts have no words. Rows of one
id are told apart by their text; repeated rows are one document and get equal
results. Null ids stay null and sort after all others (rows with a null id are one document).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from linkwise.llm import windows as X
from linkwise.llm.common import map_rows, text_bytes
from linkwise.session import materialize

WIDTH = 20
#: Characters of text per bucket; a bucket holds a few of its anchors for every 100 of them.
BUCKET_CHARS = 24_000_000
LEAST_BUCKETS = 16
ODD = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 300_000

_hashes: dict[bytes, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit name for each word of a text."""
    words = text.encode().split()
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    out, digest = [], xxhash.xxh64_intdigest
    for w in words:
        h = _hashes.get(w)
        if h is None:
            h = _hashes[w] = digest(w)
        out.append(h)
    return np.array(out, np.uint64) if out else np.zeros(0, np.uint64)


def combined(h: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    """Hash of each ``size`` consecutive names, by doubling."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out, done, part, length, power = None, 0, h, 1, odd
    left = size
    while left:
        if left & 1:
            if out is None:
                out = part
            else:
                n = min(len(out), len(part) - done)
                factor = np.uint64(pow(int(odd), done, 2**64))
                out = out[:n] + part[done:done + n] * factor
            done += length
        left >>= 1
        if left:
            factor = np.uint64(pow(int(odd), length, 2**64))
            part = part[:-length] + part[length:] * factor
            length *= 2
    return X.mix(out[:len(h) - size + 1])


class Recompression:
    """Anchors of ``WIDTH``-word windows from symbols of two pair rounds."""

    width, left = WIDTH, 10
    #: places of a window in which its anchor may start
    first, last = 3, 13

    units = staticmethod(word_hashes)

    @staticmethod
    def symbols(names: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """(start, name) of the symbols after the rounds."""
        starts = np.arange(len(names))
        for r in range(rounds):
            is_left = ((X.mix(names ^ np.uint64(r + 1)) >> np.uint64(17)) & np.uint64(1)).astype(bool)
            joined = is_left[:-1] & ~is_left[1:]
            pair = X.mix(names[:-1] * ODD + X.mix(names[1:] + np.uint64(r + 1)))
            names = names.copy()
            names[:-1][joined] = pair[joined]
            keep = np.concatenate(([True], ~joined)) if len(names) else np.zeros(0, bool)
            names, starts = names[keep], starts[keep]
        return starts, names

    def places(self, units: np.ndarray) -> np.ndarray:
        starts, names = self.symbols(units)
        priority = np.full(len(units), np.uint64(2**64 - 1))
        priority[starts] = X.mix(names) >> np.uint64(1)
        n = len(units) - self.width + 1
        low = X.least_places(priority[self.first:], self.last - self.first + 1)[:n]
        return low + self.first

    def keys(self, units: np.ndarray, codes: np.ndarray) -> np.ndarray:
        place, right = codes >> 1, (codes & 1).astype(bool)
        before, after = combined(units, 10, ODD), combined(units, 11, ODD)
        out = np.empty(len(codes), np.uint64)
        out[~right] = before[place[~right] - 10]
        out[right] = X.mix(after[place[right]] + np.uint64(1))
        return out


def earliest(first: np.ndarray, second: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows have no equal one that starts earlier."""
    order = np.lexsort((starts, ids, second, first))
    a, b = first[order], second[order]
    opens = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else order
    head = np.repeat(order[opens], np.diff(np.append(opens, len(order))))
    out = np.empty(len(order), bool)
    out[order] = (ids[order] == ids[head]) & (starts[order] == starts[head])
    return out


def verified(texts: DataFrame, finder: Recompression, buckets: int) -> DataFrame:
    """(id, version, places): runs of window starts whose words also start earlier."""

    def candidates(batch: pa.RecordBatch):
        ids, versions = batch.column("id").to_numpy(), batch.column("version").to_numpy()
        docs, starts, first, second = [], [], [], []
        for i, (text, places) in enumerate(zip(batch.column("text").to_pylist(), batch.column("places").to_pylist())):
            units = finder.units(text)
            at, _ = X.selected(finder, units, places)
            if len(at):
                docs.append(np.full(len(at), i))
                starts.append(at)
                first.append(combined(units, finder.width, ODD)[at])
                second.append(combined(X.mix(units ^ ODD), finder.width, ODD + np.uint64(2))[at])
        if not docs:
            return
        docs, starts, first, second = map(np.concatenate, (docs, starts, first, second))
        lead = earliest(first, second, ids[docs], starts)
        packer, bucket = X.Packer(ids, versions), (first % np.uint64(buckets)).astype(np.int32)
        rows = list(packer.rows(bucket[lead], docs[lead], starts[lead], first[lead], second[lead]))
        # what the batch itself shows to start earlier needs only the way back to its document
        rows += packer.rows((docs[~lead] % buckets).astype(np.int32), docs[~lead], starts[~lead], gone=True)
        yield X.packed_batch(rows)

    def later(table: pa.Table) -> pa.Table:
        ids, versions, starts, first, second = X.unpacked(table.filter(pc.invert(table["gone"])), np.uint64)
        repeated, known = ~earliest(first, second, ids, starts), X.unpacked(table.filter(table["gone"]))
        return X.runs_home(*[np.concatenate([a[repeated], b]) for a, b in zip((ids, versions, starts), known)], buckets)

    return X.gathered(map_rows(texts, candidates, X.PACKED).groupBy("bucket").applyInArrow(later, X.PACKED))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, places): per document the runs of windows that start earlier elsewhere."""
    finder, texts = Recompression(), X.versioned(docs, id_col, text_col)
    buckets = max(LEAST_BUCKETS, -(-text_bytes(docs, text_col) // BUCKET_CHARS))
    found = materialize(X.revealed(texts, finder, buckets, across=False), "recompression-revealed")
    runs = materialize(verified(X.with_places(texts, found, "inner"), finder, buckets), "recompression-runs")
    return runs


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256 [, kept]): one row per input row."""
    runs = repeated_windows(docs, id_col, text_col)

    def finish(batch: pa.RecordBatch):
        sizes, removed, kept = [], [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
            words = text.encode().split()
            sizes.append(len(words))
            if places:
                gone = X.covered(len(words), places, WIDTH)
                removed.append(int(gone.sum()))
                words = [words[j] for j in np.flatnonzero(~gone).tolist()]
            else:
                removed.append(0)
            kept.append(b" ".join(words))
        columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                   pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        names = ["id", "n_words", "n_removed", "kept_sha256"]
        if keep_text:
            columns.append(pa.array([k.decode() for k in kept], pa.string()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(columns, names)

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return map_rows(X.with_places(X.versioned(docs, id_col, text_col), runs, "left"), finish, schema)
