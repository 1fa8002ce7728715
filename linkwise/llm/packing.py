"""Best-fit packing of tokenized documents with Martello-Toth reduction.

1. Each whole text becomes ids (tokenizer file given by path; no special tokens are
   added) and a closing id; only what exceeds ``capacity`` is cut, into
   full pieces and a rest. Texts are split at white space first: the tokenizer drops
   white space and no token spans it, so ids of a text are those of its words, and
   words that were seen before come from a bounded cache.
2. Packing depends on lengths alone, and there are at most ``capacity`` of them.
   The histogram (at most ``capacity`` rows, whatever the corpus) goes to the driver,
   where whole groups of equal lengths are packed at once:
   the reduction of Martello and Toth (1990) fixes a set holding the largest
   length whenever it provably dominates every other set that holds it (alone; with
   the largest partner if at most one more fits or it fills the sequence; with the best pair), and the
   remainder is packed best-fit decreasing.
3. The plan (ranges of ranks per length, independent of the number of
   documents but for its counts) is sent to the tasks. A piece's rank among those of its length
   is a row number inside a salt plus the salt's offset, so a length that a
   third of all pieces share is ranked by many tasks.

Null or empty text is one piece of the closing id. Repeated rows are packed each
for itself; null ids stay null. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkwise.llm.common import id_text, map_rows
from linkwise.session import materialize

CAPACITY = 2048
CLOSING_ID = 0
CACHE_WORDS = 500_000
#: str.split() takes these for white space, the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")

_state: dict = {}


def byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for the letters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(others)}


class Words(dict):
    """Ids of each word, little-endian unsigned 32 bits each, worked out once.

    Words of Latin-1 letters go straight to the tokenizer's BPE model: its normalizer
    only lower-cases them and its pre-tokenizer leaves them whole; a full stop or comma
    after them is a token sequence of its own. Other words take the whole tokenizer.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = self.encoded(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def encoded(self, word: str) -> bytes:
        if max(word) > "\xff":
            return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if word[-1] in ".," and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1]]
        if word.isalpha():
            lower = word.lower()
            if lower != word:
                return self[lower]
            if not word.isascii():
                lower = lower.encode().decode("latin-1").translate(self.letters)
            return _packed([t.id for t in self.model.tokenize(lower)])
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)


def _words(path: str) -> Words:
    """The word cache of this worker process."""
    if _state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _state.update(path=path, words=Words(Tokenizer.from_file(path)))
    return _state["words"]


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def token_bytes(text: str, path: str) -> bytes:
    """The ids of a text, little-endian unsigned 32 bits each."""
    words = _words(path)
    if SEPARATORS.search(text):
        return _packed(words.tokenizer.encode(text, add_special_tokens=False).ids)
    return b"".join([words[w] for w in text.split()])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """(id, piece, start, length, crc): the pieces of every document."""
    closing = _packed([closing_id])

    def run(batch: pa.RecordBatch):
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = token_bytes(text, tokenizer_path) + closing
            for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at:at + 4 * capacity]
                rows.append((key, i, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*rows))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         ["id", "piece", "start", "length", "crc"])

    return map_rows(id_text(docs), run, "id long, piece int, start long, length long, crc long")


class _Lengths:
    """Counts by length, with the queries the reduction needs."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {w: c for w, c in counts.items() if c}
        self.sorted = sorted(self.counts)

    def take(self, chosen: tuple[int, ...], times: int) -> None:
        for w in chosen:
            self.counts[w] -= times
        for w in set(chosen):
            if not self.counts[w]:
                del self.counts[w]
                self.sorted.pop(bisect_left(self.sorted, w))

    def times(self, chosen: tuple[int, ...]) -> int:
        return min(self.counts.get(w, 0) // chosen.count(w) for w in set(chosen))

    def free(self, w: int, without: int) -> int:
        return self.counts.get(w, 0) - (w == without)

    def largest(self, limit: int, without: int) -> int | None:
        i = bisect_left(self.sorted, limit + 1) - 1
        while i >= 0 and self.free(self.sorted[i], without) <= 0:
            i -= 1
        return self.sorted[i] if i >= 0 else None

    def smallest(self, n: int, without: int, above: int = 0) -> list[int]:
        out = []
        for w in self.sorted[bisect_left(self.sorted, above + 1):]:
            out += [w] * min(n - len(out), self.free(w, without))
            if len(out) == n:
                break
        return out

    def best_pair(self, room: int, without: int) -> tuple[int, int] | None:
        """Two items of the largest sum within the room, larger first."""
        free = [w for w in self.sorted[:bisect_left(self.sorted, room)] if self.free(w, without) > 0]
        low, high, best = 0, len(free) - 1, None
        while low < high or low == high and self.free(free[low], without) > 1:
            a, b = free[high], free[low]
            if a + b > room:
                high -= 1
                continue
            if best is None or a + b > sum(best):
                best = (a, b)
            low += 1
        return best


def dominating(items: _Lengths, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``j`` that dominates all sets with ``j``, if the reduction finds one."""
    room = capacity - j
    small = items.smallest(3, j)
    fits = sum(s <= room for s in np.cumsum(small).tolist()) if small else 0
    if fits == 0:
        return (j,)
    partner = items.largest(room, j)
    if fits == 1 or partner == room:
        return (j, partner)
    if fits > 2:
        return None
    pair = items.best_pair(room, j)
    if pair is None or partner >= sum(pair):
        return (j, partner)
    over = items.smallest(2, j, above=pair[1])
    if partner == pair[0] and (len(over) < 2 or sum(over) > room):
        return (j, *pair)
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed sets with how often, remaining counts)."""
    items, fixed, changed = _Lengths(counts), [], True
    while changed:
        changed = False
        for j in sorted(items.counts, reverse=True):
            while items.counts.get(j):
                chosen = dominating(items, j, capacity)
                if chosen is None:
                    break
                times = items.times(chosen)
                items.take(chosen, times)
                fixed.append((chosen, times))
                changed = True
    return fixed, items.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (contents, how many sequences)."""
    open_by: dict[int, list] = defaultdict(list)
    rooms: list[int] = []

    def put(contents, times, room):
        if not open_by[room]:
            insort(rooms, room)
        open_by[room].append((contents, times))

    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                contents, times, room = (), left, capacity
            else:
                room = rooms[at]
                contents, times = open_by[room].pop()
                if not open_by[room]:
                    rooms.pop(at)
            each = room // w
            full = min(times, left // each)
            if full:
                put(contents + (w,) * each, full, room - each * w)
            else:
                full, each = 1, left
                put(contents + (w,) * each, 1, room - each * w)
            left -= full * each
            if contents and times > full:
                put(contents, times - full, room)
    return [x for groups in open_by.values() for x in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, offset), by first rank."""
    fixed, rest = reduce_instance(counts, capacity)
    ranks: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    sequence = 0
    for contents, times in fixed + best_fit(rest, capacity):
        offset = 0
        for w in contents:
            out[w].append((ranks[w], sequence, offset))
            ranks[w] += times
            offset += w
        sequence += times
    return {w: np.array(rows, np.int64) for w, rows in out.items()}


def ranked(cut: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(pieces with their rank among equal lengths, counts by length)."""
    salts = max(64, rows // 20_000)
    salt = F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(salts))
    salted = cut.withColumn("salt", salt)
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    number = F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "piece", "crc"))
    out = salted.withColumn("number", number).join(offsets, ["length", "salt"]).withColumn(
        "rank", F.col("before") + F.col("number") - 1)
    return out, sizes.groupBy("length").agg(F.sum("n").alias("n"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """(id, piece, start, length, crc, sequence, offset): every piece with its place."""
    cut = materialize(pieces(docs, tokenizer_path, capacity, closing_id), "packing-pieces")
    numbered, sizes = ranked(cut, cut.count())
    places = plan({r["length"]: r["n"] for r in sizes.collect()}, capacity)

    def run(batch: pa.RecordBatch):
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for w in np.unique(length):
            rows, mine = places[int(w)], np.flatnonzero(length == w)
            at = np.searchsorted(rows[:, 0], rank[mine], "right") - 1
            sequence[mine] = rows[at, 1] + rank[mine] - rows[at, 0]
            offset[mine] = rows[at, 2]
        names = ["id", "piece", "start", "length", "crc"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)],
                                         names + ["sequence", "offset"])

    return map_rows(numbered, run, "id long, piece int, start long, length long, crc long, sequence long, offset long")
