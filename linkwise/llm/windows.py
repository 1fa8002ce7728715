"""Repeated fixed-length windows of whole texts, found in three bounded shuffles.

Shared by the substring operators. A *finder* turns a text into units (words or
bytes), gives every window of ``width`` units one *anchor* inside it that depends on the
window's content alone, and two context keys per anchor: one for windows that reach at least
``left`` units to the anchor's left, one for the others. Equal windows therefore have the
same anchor place, the same side and equal context keys.

1. ``revealed``: every anchor's keys are shuffled (hash-partitioned, packed) and those that
   occur again come back per document. Windows whose key is unique cannot repeat. What
   buckets find for a document goes packed to the document's home bucket and leaves it as one row.
2. A second shuffle by the caller brings the windows of revealed anchors together and verifies them.
3. ``with_runs`` brings the removed window starts back to the texts.

What a task holds is bounded by the number of buckets, which grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwise.llm.common import id_text, map_rows

#: Units that are worked on at once; longer texts go through in overlapping stretches.
STRETCH = 1 << 20
#: Bytes of text whose keys or windows a task holds at once; a longer text goes alone.
PORTION = 8_000_000
PACKED = ("bucket int, ids binary, versions binary, counts binary, codes binary, k1 binary, k2 binary, body binary, "
          "gone boolean")
NAMES = [c.split()[0] for c in PACKED.split(", ")]
PACKED_SCHEMA = pa.schema(list(zip(NAMES, [pa.int32()] + [pa.binary()] * 7 + [pa.bool_()])))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (public-domain constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n, size, m = len(v), 1, v
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == width else np.minimum(m[:n - width + 1], m[width - size:])


def least_places(priority: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least priority of each ``width`` consecutive ones (priorities to 43 bits)."""
    low = np.uint64((1 << 21) - 1)
    packed = (priority & ~low) | np.arange(len(priority), dtype=np.uint64)
    return (sliding_min(packed, width) & low).astype(np.int64)


def stretches(n: int, width: int):
    """(first window, units from, units to) of overlapping stretches."""
    for at in range(0, max(0, n - width + 1), STRETCH):
        yield at, min(n, at + STRETCH + width - 1)


def codes_of(finder, units: np.ndarray) -> np.ndarray:
    """Per window, 2 * anchor place, plus 1 for windows that reach less than ``left`` units to its left."""
    parts = []
    for at, to in stretches(len(units), finder.width):
        place = finder.places(units[at:to])
        side = (place - np.arange(len(place)) < finder.left).astype(np.int64)
        parts.append(2 * (place + at) + side)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def first_of_runs(values: np.ndarray) -> np.ndarray:
    """Positions at which a run of equal values starts."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def versioned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, text); ``version`` tells texts of one id apart."""
    return id_text(docs, id_col, text_col).select("id", F.xxhash64("text").alias("version"), "text")


def portions(batch: pa.RecordBatch):
    """The batch in slices of about ``PORTION`` bytes of text."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = first_of_runs((ends - 1) // PORTION)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ends)]):
        yield batch.slice(a, b - a)


def in_portions(fn):
    """``fn`` on the portions of a batch."""
    return lambda batch: chain.from_iterable(map(fn, portions(batch)))


class Packer:
    """Rows of many documents of one batch, packed by bucket."""

    def __init__(self, ids: np.ndarray, versions: np.ndarray):
        self.ids, self.versions = ids, versions

    def rows(self, bucket: np.ndarray, doc: np.ndarray, code: np.ndarray, k1: np.ndarray | None = None,
             k2: np.ndarray | None = None,
             body: Callable[[np.ndarray], bytes] | None = None, gone: bool = False):
        """One row per bucket; ``doc`` ascending. Yields dictionaries by column."""
        if not len(bucket):
            return
        order = np.argsort(bucket, kind="stable")
        starts = first_of_runs(bucket[order])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
            mine = order[a:b]
            docs, counts = np.unique(doc[mine], return_counts=True)
            codes = code[mine].astype(np.uint32)
            yield {"bucket": int(bucket[mine[0]]), "ids": self.ids[docs].tobytes(), "versions": self.versions[docs].tobytes(),
                   "counts": counts.astype(np.uint32).tobytes(),
                   "codes": np.diff(codes, prepend=np.uint32(0)).tobytes(), "k1": k1[mine].tobytes() if k1 is not None else None,
                   "k2": k2[mine].tobytes() if k2 is not None else None, "body": body(mine) if body else None,
                   "gone": gone}


def packed_batch(rows) -> pa.RecordBatch | None:
    rows = list(rows)
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in PACKED_SCHEMA],
                                      schema=PACKED_SCHEMA)


def unpacked(table: pa.Table, dtype2=None):
    """(id, version, code, k1, k2) arrays over all rows of a bucket, filled row by row from the table's own memory."""
    def held(name, dtype):
        return int(pc.sum(pc.binary_length(table[name])).as_py() or 0) // np.dtype(dtype).itemsize

    dtypes = (np.int64, np.int64, np.uint32, np.uint64, dtype2 or np.uint64)
    names = ("codes", "codes", "codes", "k1", "k2")
    out = [np.empty(held(name, np.uint32 if name == "codes" else t), t) for name, t in zip(names, dtypes)]
    at = [0] * len(out)

    def put(k, values):
        out[k][at[k]:at[k] + len(values)] = values
        at[k] += len(values)

    for row in zip(*[table[c] for c in ("ids", "versions", "counts", "codes", "k1", "k2")]):
        ids, versions, counts, codes, k1, k2 = [x.as_buffer() or b"" for x in row]
        counts = np.frombuffer(counts, np.uint32)
        put(0, np.repeat(np.frombuffer(ids, np.int64), counts))
        put(1, np.repeat(np.frombuffer(versions, np.int64), counts))
        put(2, np.cumsum(np.frombuffer(codes, np.uint32), dtype=np.uint32))
        put(3, np.frombuffer(k1, dtypes[3]))
        put(4, np.frombuffer(k2, dtypes[4]))
    return out


def sent_home(ids: np.ndarray, versions: np.ndarray, values: np.ndarray, homes: int) -> pa.Table:
    """Values for documents, packed by the home bucket of their document."""
    order = np.lexsort((values, versions, ids))
    ids, versions, values = ids[order], versions[order], values[order].astype(np.uint64)
    other = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1])))) if len(
        ids) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(other)), np.diff(np.append(other, len(ids))))
    home = (mix(ids.view(np.uint64) ^ mix(versions.view(np.uint64))) % np.uint64(homes)).astype(np.int32)
    batch = packed_batch(Packer(ids[other], versions[other]).rows(home, doc, np.zeros(len(ids), np.uint32), values))
    return pa.Table.from_batches([batch] if batch is not None else [], schema=PACKED_SCHEMA)


def at_home(table: pa.Table) -> pa.Table:
    """One row (id, version, places) per document; values as packed uint64, ascending."""
    ids, versions, _, values, _ = unpacked(table)
    order = np.lexsort((values, versions, ids))
    ids, versions, values = ids[order], versions[order], values[order]
    other = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1])))) if len(
        ids) else np.zeros(0, np.int64)
    ends = [*other[1:].tolist(), len(ids)]
    return pa.table([pa.array(ids[other]), pa.array(versions[other]), pa.array(
        [values[a:b].tobytes() for a, b in zip(other.tolist(), ends)], pa.binary())], names=["id", "version", "places"])


PLACES = "id long, version long, places binary"


def gathered(found: DataFrame) -> DataFrame:
    """(id, version, places): what all buckets say about a document, one row each."""
    return found.groupBy("bucket").applyInArrow(at_home, PLACES)


def revealed(texts: DataFrame, finder, buckets: int, across: bool) -> DataFrame:
    """(id, version, places), one row per document: codes of anchors whose context key occurs again.

    ``across``: again in another document, else anywhere.
    """

    def keyed(batch: pa.RecordBatch):
        docs, codes, keys = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            units = finder.units(text)
            if len(units) < finder.width:
                continue
            own = codes_of(finder, units)
            own = own[first_of_runs(own)]
            docs.append(np.full(len(own), i))
            codes.append(own)
            keys.append(finder.keys(units, own))
        if not docs:
            return
        docs, codes, keys = map(np.concatenate, (docs, codes, keys))
        packer = Packer(batch.column("id").to_numpy(), batch.column("version").to_numpy())
        out = packed_batch(packer.rows((keys % np.uint64(buckets)).astype(np.int32), docs, codes, keys))
        if out is not None:
            yield out

    def again(table: pa.Table) -> pa.Table:
        ids, versions, codes, keys, _ = unpacked(table)
        order = np.argsort(keys, kind="stable")
        starts = first_of_runs(keys[order])
        sizes = np.diff(np.append(starts, len(order)))
        if across and len(order):
            hit = np.minimum.reduceat(ids[order], starts) != np.maximum.reduceat(ids[order], starts)
        else:
            hit = sizes > 1
        mine = order[np.repeat(hit, sizes)]
        return sent_home(ids[mine], versions[mine], codes[mine], buckets)

    return gathered(map_rows(texts, in_portions(keyed), PACKED).groupBy("bucket").applyInArrow(again, PACKED))


def with_places(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """(id, version, text, places): the texts with the places found in them."""
    return texts.join(places, ["id", "version"], how).select("id", "version", "text", "places")


def selected(finder, units: np.ndarray, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows, codes) of the windows whose anchor key was revealed."""
    codes, found = codes_of(finder, units), np.unique(np.frombuffer(places, np.uint64)).astype(np.int64)
    if not len(found) or not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = np.flatnonzero(found[np.minimum(np.searchsorted(found, codes), len(found) - 1)] == codes)
    return windows, codes[windows]


def runs_home(ids: np.ndarray, versions: np.ndarray, starts: np.ndarray, homes: int) -> pa.Table:
    """Runs of consecutive window starts, sent home as first * 2^32 + last + 1."""
    order = np.lexsort((starts, versions, ids))
    ids, versions, starts = ids[order], versions[order], starts[order].astype(np.int64)
    if not len(ids):
        return sent_home(ids, versions, starts, homes)
    opens = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1])
                                           | (starts[1:] > starts[:-1] + 1))))
    last = starts[np.append(opens[1:], len(starts)) - 1] + 1
    return sent_home(ids[opens], versions[opens], (starts[opens] << 32) | last, homes)


def covered(n: int, places: bytes, width: int) -> np.ndarray:
    """Which of n units lie in a window that starts in one of the runs."""
    runs = np.frombuffer(places, np.uint64).astype(np.int64)
    edge = np.bincount(runs >> 32, minlength=n + 1)
    edge = edge - np.bincount(np.minimum((runs & (2**32 - 1)) - 1 + width, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
