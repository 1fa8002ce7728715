"""Token counts of whole texts, huge ones by overlapping chunks.

A text longer than ``chunk`` characters is cut into slices of ``chunk`` characters
that run on into the next slice by an overlap, and the slices are encoded by
separate tasks with offsets. Neighbours are spliced at a proven common boundary: a
position in their overlap where

* both encodings start a token, and
* the character before is no white space while the one at it is. No pattern
  of the byte-level pre-tokenizer joins non-blank characters with a following blank one,
  and none of its alternatives looks past such a place, so tokens on either side do
  not depend on the other side.

Tokens left of it come from the left slice, the others from the right one. Where an
overlap holds no such position (a long run without white space), it is widened fourfold for
that text and encoded again; at the latest the first slice holds the whole text.

Special strings inside a text are matched as the tokenizer's default does; they hold
no white space, so no splice cuts one. White space here is what both the
tokenizer's pattern and Python agree on. Null and empty texts have 0 tokens. Repeated
rows are counted each for itself (long texts are worked on once per distinct text, known
by its SHA-256); null ids stay null.

The same proof lets a text up to ``chunk`` characters be counted as the sum of its
stretches between such places; stretches seen before come from a bounded cache.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwise.llm.common import id_text, map_rows
from linkwise.session import materialize

CHUNK = 65_536
OVERLAP = 2_048
#: White space of the tokenizer's pattern; Python's own also has \\x1c-\\x1f.
BLANKS = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
CACHE_STRETCHES = 500_000
_BLANK = "[" + "".join(sorted(BLANKS)) + "]"
#: Blanks and the run of other characters after them; blanks alone at the text's end.
STRETCH = re.compile(f"{_BLANK}*[^{_BLANK[1:-1]}]+|{_BLANK}+")

_state: dict = {}


def _tokenizer(path: str):
    """The tokenizer of this worker process and its cache of counts."""
    if _state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _state.update(path=path, tokenizer=Tokenizer.from_file(path), counts={})
    return _state["tokenizer"], _state["counts"]


def count_tokens(text: str, path: str) -> int:
    """Tokens of a text as the sum over its stretches."""
    tokenizer, known = _tokenizer(path)
    stretches = STRETCH.findall(text)
    try:
        return sum([known[s] for s in stretches])
    except KeyError:
        new = [s for s in dict.fromkeys(stretches) if s not in known]
    if len(known) + len(new) > CACHE_STRETCHES:
        known.clear()
        new = list(dict.fromkeys(stretches))
    own = known if len(new) <= CACHE_STRETCHES else {}
    for s, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
        own[s] = len(e)
    return sum([own[s] for s in stretches])


def whole_counts(texts: DataFrame, path: str) -> DataFrame:
    """(id, n_bytes, n_tokens) of texts that need no slices."""

    def run(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        counts, sizes = [count_tokens(t, path) for t in texts], [len(t.encode()) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                                         ["id", "n_bytes", "n_tokens"])

    return map_rows(texts, run, "id long, n_bytes long, n_tokens long")


def stable_starts(text: str, starts: np.ndarray, low: int, high: int) -> list[int]:
    """Token starts in [low, high) that are proven boundaries."""
    return [p for p in starts[(starts >= low) & (starts < high)].tolist()
            if p and text[p] in BLANKS and text[p - 1] not in BLANKS]


def slice_counts(slices: DataFrame, path: str) -> DataFrame:
    """Per slice (row, slice, from, overlap, text, last): token starts at proven
    boundaries of its head and tail overlap, each with the tokens before it, and its total."""
    places = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))

    def run(batch: pa.RecordBatch):
        tokenizer, heads, tails, totals = _tokenizer(path)[0], [], [], []
        for text, at, width, last, chunk in zip(*[batch.column(c).to_pylist() for c in
                                                  ("part", "from", "overlap", "last", "chunk")]):
            offsets = tokenizer.encode(text, add_special_tokens=False).offsets
            starts = np.fromiter((a for a, _ in offsets), np.int64, len(offsets))

            def found(low, high):
                return [{"at": at + p, "before": int(np.searchsorted(starts, p, "left"))}
                        for p in stable_starts(text, starts, low, high)]

            heads.append(found(0, width) if at else [])
            tails.append([] if last else found(chunk, len(text)))
            totals.append(len(offsets))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("slice"), pa.array(heads, places), pa.array(tails, places),
             pa.array(totals, pa.int64())], ["row", "slice", "head", "tail", "total"])

    kind = "array<struct<at:long,before:long>>"
    return map_rows(slices, run, f"row string, slice int, head {kind}, tail {kind}, total long")


def spliced_counts(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens, failed) of long texts (row, text) cut into overlapping slices.

    ``failed`` says that some overlap held no common boundary.
    """
    # the first slice that reaches the text's end is the last one
    ends = F.greatest(F.lit(0), F.ceil((F.length("text") - overlap) / chunk).cast("int") - 1)
    slices = texts.select("row", "text", ends.alias("end"), F.explode(F.sequence(F.lit(0), ends)).alias("slice")).select(
        "row", "slice", (F.col("slice") * F.lit(chunk).cast("long")).alias("from"), F.lit(overlap).alias("overlap"),
        F.expr(f"substring(text, slice * {chunk} + 1, {chunk + overlap})").alias("part"),
        (F.col("slice") == F.col("end")).alias("last"), F.lit(chunk).alias("chunk"))
    dealt = slices.repartition(F.col("row"), F.col("slice"))
    counted = materialize(slice_counts(dealt, path), "token-slices")
    left = counted.where(F.size("tail") > 0).select("row", (F.col("slice") + 1).alias("slice"), "tail")
    right = counted.where("slice > 0").select("row", "slice", "head")
    at_left = F.transform("tail", lambda x: x["at"])
    at_right = F.transform("head", lambda x: x["at"])
    splice = F.array_min(F.array_intersect(at_left, at_right))
    pairs = right.join(left, ["row", "slice"], "left").withColumn("splice", splice)

    def before(places: str):
        return F.filter(places, lambda x: x["at"] == F.col("splice"))[0]["before"]

    # the left slice gives its tokens up to the splice, the right one those after it
    moved = pairs.select("row", F.col("splice").isNull().alias("failed"),
                         (F.when(F.col("splice").isNotNull(), before("tail") - before("head"))).alias("n"))
    joins = moved.groupBy("row").agg(F.max("failed").alias("failed"), F.sum("n").alias("n"))
    last = counted.groupBy("row").agg(F.max_by("total", "slice").alias("total"))
    return last.join(joins, "row", "left").select(
        "row", (F.coalesce("n", F.lit(0)) + F.col("total")).alias("n_tokens"),
        F.coalesce("failed", F.lit(False)).alias("failed"))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens): one row per input row."""
    source = id_text(docs, id_col, text_col)
    short = whole_counts(source.where(F.length("text") <= chunk), path)
    long = source.where(F.length("text") > chunk).withColumn("row", F.sha2("text", 256))
    left, width, done = materialize(long.select("row", "text").dropDuplicates(["row"]), "token-long"), overlap, []
    while left.limit(1).count():
        counted = materialize(spliced_counts(left, path, chunk, width), "token-spliced")
        done.append(counted.where("not failed").select("row", "n_tokens"))
        left = materialize(left.join(counted.where("failed").select("row"), "row", "left_semi"), "token-failed")
        width *= 4
    if not done:
        return short
    counts = done[0]
    for d in done[1:]:
        counts = counts.unionByName(d)
    found = long.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "row").join(counts, "row")
    return short.unionByName(found.select("id", "n_bytes", "n_tokens"))
