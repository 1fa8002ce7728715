"""First-fit decreasing packing by tournament trees in randomised groups.

1. Each whole text becomes ids (tokenizer file given by path, no special tokens) and a
   closing id. A document longer than ``capacity`` is cut into full pieces, sequences of their own, and
   a rest; only the rest travels further, with its ids.
2. Rests are dealt out at random: Spark's rebalancing sorts the rows of each task by a
   hash and deals them in turn, so groups of copies, long documents and hot ids spread evenly whatever
   their keys, and a repeated task deals as before. Every run of ``group`` rests is one group and is packed on its own.
3. In a group the rests go by falling length, each into the first sequence with
   room. The winners of a tournament over the sequences' free room are kept in a binary tree; the walk from
   the root to the leftmost leaf with enough room and the replay on the way back take log2(n) steps.
4. Sequences with more than ``slack`` unused ids are opened again: their documents are laid end to
   end and cut at ``capacity``. What is left at the end of the group is cut at powers of two, which need
   no padding. So no sequence is padded by more than ``slack``, whatever the lengths.

Null or empty text is the closing id alone. Repeated rows are packed each for itself;
null ids stay null. An empty table gives an empty result. A task holds one group (at most ``group`` times
``capacity`` ids). Sequence numbers are the task's number times 2^32 plus a counter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from linkwise.llm.common import id_text, map_rows
from linkwise.llm.packing import SEPARATORS, Words, token_bytes

CAPACITY = 2048
CLOSING_ID = 1
GROUP = 8192
SLACK = CAPACITY // 32

CACHE_WORDS = 300_000

_state: dict = {}

PIECES = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()),
                    ("doc_tokens", pa.int64())])
RESTS = PIECES.append(pa.field("ids", pa.binary()))
PLACED = PIECES.append(pa.field("sequence", pa.int64())).append(pa.field("offset", pa.int64()))
RESTS_DDL = "id long, start long, length long, crc long, doc_tokens long, ids binary"
PLACED_DDL = "id long, start long, length long, crc long, doc_tokens long, sequence long, offset long"


class LowerWords(Words):
    """Ids of lower-case Latin-1 words. Two generations of at most ``CACHE_WORDS``: when the younger one is
    full it takes the older one's place, so frequent words stay."""

    def __init__(self, tokenizer):
        super().__init__(tokenizer)
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encoded(word)
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


def document_ids(text: str, path: str) -> bytes:
    """The ids of a text, little-endian unsigned 32 bits each.

    The tokenizer lower-cases every text; where all characters are Latin-1 that can come
    first and halves the different words. Its special strings are told by case, so texts with
    ``<|`` go as they are.
    """
    if _state.get("path") != path:
        from tokenizers import Tokenizer

        _state.update(path=path, words=LowerWords(Tokenizer.from_file(path)))
    if "<|" in text or SEPARATORS.search(text) or not _latin(text):
        return token_bytes(text, path)
    words = _state["words"]
    return b"".join([words[w] for w in text.lower().split()])


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Tournament:
    """Free room of up to ``n`` sequences; each inner node holds the larger room of its two children."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """Place an item into the first sequence with room for it; returns the sequence."""
        room, leaves, at = self.room, self.leaves, 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        sequence = at - leaves
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return sequence


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Per sequence the positions of its items, in the order they were placed."""
    tree, out = Tournament(len(sizes), capacity), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        sequence = tree.put(sizes[item])
        if sequence == len(out):
            out.append([])
        out[sequence].append(item)
    return out


def powers(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def arrange(sizes: list[int], capacity: int, slack: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, start in the item, length, sequence, offset) of every piece of a group."""
    sequence, loose = 0, []
    for items in first_fit_decreasing(sizes, capacity):
        if capacity - sum(sizes[i] for i in items) > slack:
            loose += items
            continue
        offset = 0
        for i in items:
            yield i, 0, sizes[i], sequence, offset
            offset += sizes[i]
        sequence += 1
    total = sum(sizes[i] for i in loose)
    rooms = iter([capacity] * (total // capacity) + powers(total % capacity))
    room = offset = 0
    sequence -= 1
    for i in loose:
        start = 0
        while start < sizes[i]:
            if offset == room:
                room, offset, sequence = next(rooms), 0, sequence + 1
            length = min(sizes[i] - start, room - offset)
            yield i, start, length, sequence, offset
            start, offset = start + length, offset + length


def rests(docs: DataFrame, tokenizer_path: str, capacity: int, closing_id: int) -> DataFrame:
    """Full pieces (without ids) and each document's rest with its ids."""
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch):
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = document_ids(text, tokenizer_path) + closing
            total = len(raw) // 4
            cut = total - total % capacity
            for at in range(0, cut, capacity):
                rows.append((key, at, capacity, zlib.crc32(raw[4 * at:4 * (at + capacity)]), total, None))
            if cut < total:
                rows.append((key, cut, total - cut, None, total, _narrow(raw[4 * cut:])))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), RESTS.types)], schema=RESTS)

    return map_rows(id_text(docs), run, RESTS_DDL)


def _narrow(raw: bytes) -> bytes:
    """Two bytes an id where every id allows it, after a byte that tells the width."""
    ids = np.frombuffer(raw, "<u4")
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\4" + raw


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1).astype("<u4")


def packed(batches: Iterator[pa.RecordBatch], capacity: int, slack: int, group: int) -> Iterator[pa.RecordBatch]:
    """Full pieces as they are, rests group by group."""
    sequence = TaskContext.get().partitionId() << 32
    held: list[tuple] = []

    def close():
        nonlocal sequence
        rows, used = [], 0
        ids = [_wide(r[5]) for r in held]
        for item, start, length, at, offset in arrange([len(x) for x in ids], capacity, slack):
            key, first, _, _, total, _ = held[item]
            crc = zlib.crc32(ids[item][start:start + length].tobytes())
            rows.append((key, first + start, length, crc, total, sequence + at, offset))
            used = max(used, at + 1)
        held.clear()
        sequence += used
        return _placed(rows)

    for batch in batches:
        rows = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[5] is None:
                rows.append((*row[:5], sequence, 0))
                sequence += 1
                continue
            held.append(row)
            if len(held) == group:
                yield close()
        if rows:
            yield _placed(rows)
    if held:
        yield close()


def _placed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), PLACED.types)], schema=PLACED)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
         group: int = GROUP, slack: int = SLACK) -> DataFrame:
    """(id, start, length, crc, doc_tokens, sequence, offset): every piece with its place."""
    dealt = rests(docs, tokenizer_path, capacity, closing_id).hint("rebalance")
    return dealt.mapInArrow(lambda batches: packed(batches, capacity, slack, group), PLACED_DDL)
