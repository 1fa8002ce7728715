"""SimHash near-duplicates through a segment-popcount embedding.

1. A 64-bit fingerprint per text: A-Z lower-cased, words between ASCII blanks,
   shingles of ``shingle`` words, XXH64 (seed 42) of each; a bit is set if more
   than half the shingles set it.
2. Exact copies of a fingerprint become one node, so a hot group of copies is
   reduced by partial aggregation before anything is paired.
3. Embedding: the fingerprint is cut into 32 segments of 2 bits; each segment is
   mapped to its bit count in unary (0, 01, 11). The Manhattan distance of two
   embeddings is then the popcount of their xor, and never exceeds the Hamming
   distance of the fingerprints.
4. Grid range-join: the 32 coordinates form ``d + 4`` groups. Two points within
   Manhattan distance ``d`` differ in at most ``d`` groups, hence meet in the
   grid cell of some 4 groups. Every point enters the cell of each choice of 4.
5. In a cell the Manhattan bound, then the exact Hamming distance is checked,
   and a spanning forest of the cell's links is emitted (at most n - 1 edges for
   n points, never all pairs). A cell above ``cell_rows`` points is not gathered:
   its points join by masked fingerprints instead (two fingerprints are within d
   bits exactly if they agree after clearing some d bits), one star per mask.
6. Connected components over the edges; the id is the smallest document id.

Null text counts as empty; texts without words have fingerprint zero and link
like any other. Repeated rows give repeated result rows; rows that share an id are
one document. A row with a null id is fingerprinted but takes no part in linking;
its component is null. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwise.llm.common import NULL_ID, id_text, map_rows
from linkwise.operators.cluster import connected_components
from linkwise.session import materialize

SEED = 42
EVEN = 0x5555555555555555
SPARE_GROUPS = 4


def _majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the uint64 hashes set."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65025):
        bits = np.unpackbits(hashes[at:at + 65025].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255
        if full:
            # sums of 255 rows fit a byte, which keeps the adding narrow
            counts += np.add.reduce(bits[:full * 255].reshape(full, 255, 64), axis=1, dtype=np.uint8).sum(
                axis=0, dtype=np.int64)
        counts += np.add.reduce(bits[full * 255:], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())])
    return _majority(np.frombuffer(raw, ">u8").astype("<u8"))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch):
        fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return map_rows(id_text(docs, id_col, text_col), run, "id long, fp long")


def embed(fp):
    """The unary bit counts of the 32 segments, packed in a long."""
    even = F.lit(EVEN)
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(even)
    both = fp.bitwiseAND(high).bitwiseAND(even)
    return some.bitwiseOR(F.shiftleft(both, 1))


def cell_masks(max_bits: int) -> list[int]:
    """For each choice of 4 of ``max_bits + 4`` groups of segments, the bits it keeps (signed)."""
    groups = max_bits + SPARE_GROUPS
    of_group = [0] * groups
    for segment in range(32):
        of_group[segment % groups] |= 3 << (2 * segment)
    masks = [sum(of_group[g] for g in chosen) for chosen in combinations(range(groups), SPARE_GROUPS)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _unary(x: np.ndarray) -> np.ndarray:
    even, one = np.uint64(EVEN), np.uint64(1)
    return ((x | (x >> one)) & even) | ((x & (x >> one) & even) << one)


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (index, index) of a spanning forest of the links among distinct fingerprints."""
    point = _unary(fps)
    rest, edges = np.arange(len(fps)), []
    while len(rest):
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(point[rest] ^ point[at]) <= max_bits
            near[near] = np.bitwise_count(fps[rest[near]] ^ fps[at]) <= max_bits
            if near.any():
                found = rest[near].tolist()
                edges += [(at, j) for j in found]
                frontier += found
                rest = rest[~near]
    return edges


def _cell_edges(cells: DataFrame, max_bits: int) -> DataFrame:
    """(src, dst) from gathered cells of bounded size."""

    def run(batch: pa.RecordBatch):
        src, dst = [], []
        for fps, nodes in zip(batch.column(0), batch.column(1)):
            a, ids = fps.values.to_numpy().view(np.uint64), nodes.values.to_numpy()
            for i, j in forest(a, max_bits):
                src.append(ids[i])
                dst.append(ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return map_rows(cells, run, "src long, dst long")


def _mask_edges(points: DataFrame, max_bits: int) -> DataFrame:
    """(src, dst) stars for points of very large cells: one star per cleared choice of bits."""
    masks = [sum(1 << b for b in bits) for bits in combinations(range(64), max_bits)]
    keep = F.array(*[F.lit(~m if m < 2**63 else ~(m - 2**64)) for m in masks])
    keyed = points.select("node", "fp", F.posexplode(keep).alias("mask", "bits")).select(
        "node", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key"))
    heads = keyed.groupBy("mask", "key").agg(F.min("node").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(heads, ["mask", "key"]).where("node != dst").select(F.col("node").alias("src"), "dst")


def links(nodes: DataFrame, max_bits: int = 2, cell_rows: int = 20_000) -> DataFrame:
    """(src, dst): edges that connect exactly what links of up to ``max_bits`` bits connect.

    ``nodes``: (node, fp) with distinct fp. ``cell_rows`` decides only how a cell is
    worked on, never whether its links are found.
    """
    if max_bits == 0:
        return nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")).where(F.lit(False))
    cell = F.posexplode(F.array(*[embed(F.col("fp")).bitwiseAND(F.lit(m)) for m in cell_masks(max_bits)]))
    celled = nodes.select("node", "fp", cell.alias("choice", "cell"))
    sizes = celled.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes, "simhash-cells")
    shared = celled.join(sizes, ["choice", "cell"])
    gathered = shared.where(F.col("n") <= cell_rows).groupBy("choice", "cell").agg(
        F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes")).select("fps", "nodes")
    edges = _cell_edges(gathered, max_bits)
    if sizes.where(F.col("n") > cell_rows).limit(1).count():
        points = shared.where(F.col("n") > cell_rows).select("node", "fp").distinct()
        edges = edges.unionByName(_mask_edges(points, max_bits))
    return edges.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", cell_rows: int = 20_000) -> DataFrame:
    """One row per input row: id, fp (long) and component (smallest id reachable)."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    known = prints.where(F.col("id") != F.lit(NULL_ID))
    nodes = materialize(known.groupBy("fp").agg(F.min("id").alias("node")), "simhash-nodes")
    components = connected_components(materialize(links(nodes, max_bits, cell_rows), "simhash-edges"))
    named = nodes.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    component = F.when(F.col("id") != F.lit(NULL_ID), F.col("component")).alias("component")
    return prints.join(named, "fp", "left").select("id", "fp", component)
