"""Nearest neighbours by inner product with multi-index hashing.

Learning, on a bounded sample of ``SAMPLE_ROWS`` rows in hash order: vectors are centred and
lengthened by one coordinate that makes all norms equal (so the largest inner product
becomes the smallest angle), and ``bits`` code bits come from learned rotations (iterative
quantization, Gong et al. 2013; as many rotations as the bits need). The Hamming radius is
the one that covers ``COVER`` of the sample's own true neighbours.

Searching: every row is indexed. Rows and queries are dealt to a grid of row blocks and query
blocks (the stated query set against all rows, in blocks); a cell indexes its rows by
each 8-bit substring of their codes. By the pigeonhole principle a code within radius r of the
query is within r // m or less of it in one of the m substrings (Norouzi, Punjani and
Fleet 2012), so probing these buckets retrieves every code within the radius;
the full distance is checked and the survivors are ranked by the inner product of the original vectors in
double precision. A query with fewer than ``k`` codes inside the radius in a cell takes all
of the cell's rows, so no radius loses a query.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components, and rows with a null id, take no part. Ties go to the smaller id. Repeated rows of one id
count once. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkwise.session import materialize

SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 400
COVER = 0.97
BITS = 128
SUBSTRING = 8
ROW_BLOCK = 16_384
QUERY_BLOCK = 4_096
ROUNDS = 15


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): one row per id with a usable vector."""
    v = vectors[vector_col].cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v")).where(
        "id is not null and size(v) > 0").where(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


class Codes:
    """Learned rotations; codes of rows and queries as uint64 words."""

    def __init__(self, sample: np.ndarray, longest: float, bits: int = BITS):
        self.mean = sample.mean(0)
        self.reach = max(longest + float(np.linalg.norm(self.mean)), 1e-300)
        self.bits = bits
        points = self._points(sample)
        size, self.rotations, rng = points.shape[1], [], np.random.default_rng(7)
        while sum(r.shape[1] for r in self.rotations) < bits:
            rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
            for _ in range(ROUNDS):
                signs = np.where(points @ rotation >= 0, 1.0, -1.0)
                u, _, w = np.linalg.svd(points.T @ signs)
                rotation = u @ w
            self.rotations.append(rotation[:, :bits - sum(r.shape[1] for r in self.rotations)])
        self.matrix = np.concatenate(self.rotations, 1)

    def _points(self, rows: np.ndarray) -> np.ndarray:
        centred = (rows - self.mean) / self.reach
        rest = np.sqrt(np.maximum(0.0, 1.0 - (centred**2).sum(1)))
        return np.concatenate([centred, rest[:, None]], 1)

    def _packed(self, projected: np.ndarray) -> np.ndarray:
        return np.packbits(projected >= 0, axis=1, bitorder="little")

    def rows(self, rows: np.ndarray) -> np.ndarray:
        return self._packed(self._points(rows) @ self.matrix)

    def queries(self, rows: np.ndarray) -> np.ndarray:
        return self._packed(rows @ self.matrix[:-1])


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def learned_radius(codes: Codes, sample: np.ndarray, k: int) -> int:
    """Hamming radius that holds ``COVER`` of the true neighbours of sample rows in the sample."""
    queries = sample[:SAMPLE_QUERIES]
    near = []
    row_codes, query_codes = codes.rows(sample), codes.queries(queries)
    for i, q in enumerate(queries):
        scores = sample @ q
        scores[i] = -np.inf
        top = np.argsort(-scores, kind="stable")[:min(k, len(sample) - 1)]
        near.append(np.bitwise_count(row_codes[top] ^ query_codes[i]).sum(1, dtype=np.int64))
    distances = np.sort(np.concatenate(near)) if near else np.zeros(0, np.int64)
    return int(distances[min(len(distances) - 1, int(COVER * len(distances)))]) if len(distances) else codes.bits


class Index:
    """Substring tables of one block of codes."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = codes, radius
        m = codes.shape[1]
        whole, rest = divmod(radius, m)
        #: of the m substrings, rest + 1 may differ by up to whole bits, the others by one less
        self.within = [whole if t <= rest else whole - 1 for t in range(m)]
        self.order = [np.argsort(codes[:, t], kind="stable") for t in range(m)]
        self.starts = [np.concatenate(([0], np.cumsum(np.bincount(codes[:, t], minlength=256)))) for t in range(m)]
        distance = np.bitwise_count(np.arange(256, dtype=np.uint8))
        self.balls = {r: np.flatnonzero(distance <= r).astype(np.uint8) for r in set(self.within) if r >= 0}

    def retrieve(self, code: np.ndarray) -> np.ndarray:
        """Positions of every code within the radius."""
        mark = np.zeros(len(self.codes), bool)
        for t, r in enumerate(self.within):
            if r < 0:
                continue
            order, starts = self.order[t], self.starts[t]
            for v in (self.balls[r] ^ code[t]).tolist():
                mark[order[starts[v]:starts[v + 1]]] = True
        found = np.flatnonzero(mark)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(1, dtype=np.int64) <= self.radius]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable query its k nearest rows but itself."""
    rows = materialize(usable(vectors, id_col, vector_col), "mih-rows")
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out = "query_id long, vec_id long, score double"
    if not width:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == width[0]["d"])
    asked = usable(queries, id_col, vector_col).where(F.size("v") == width[0]["d"])
    longest, n = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.count("*")).collect()[0]
    asked_n = asked.count()
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").collect()])
    codes = Codes(sample, longest, bits)
    radius = learned_radius(codes, sample, k)
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-asked_n // QUERY_BLOCK))

    def dealt(df, own, blocks, other, others):
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(rows, "rb", row_blocks, "qb", query_blocks).groupBy("rb", "qb")
    right = dealt(asked, "qb", query_blocks, "rb", row_blocks).groupBy("rb", "qb")

    def cell(block: pa.Table, wanted: pa.Table) -> pa.Table:
        found = ([], [], [])
        if len(block) and len(wanted):
            ids, x = block["id"].to_numpy(), _matrix(block["v"])
            query_ids, q = wanted["id"].to_numpy(), _matrix(wanted["v"])
            index, query_codes = Index(codes.rows(x), radius), codes.queries(q)
            for i, query in enumerate(query_ids.tolist()):
                near = index.retrieve(query_codes[i])
                if len(near) <= k:
                    near = np.arange(len(ids))
                near = near[ids[near] != query]
                scores = x[near] @ q[i]
                top = _top(scores, ids[near], k)
                found[0].append(np.full(len(top), query))
                found[1].append(ids[near][top])
                found[2].append(scores[top])
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(found, kinds)],
                        names=["query_id", "vec_id", "score"])

    hits = left.cogroup(right).applyInArrow(cell, out)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
