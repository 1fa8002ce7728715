"""Phrase collocations by SON partitioning.

1. Shards. A document belongs to one of ``SHARDS`` shards by the checksum of its text. Their number does not
   grow with the corpus, since the support asked of a shard is the global one lowered in proportion to
   the shard's share of all text bytes, rounded up: with ever more shards it would sink to one.
   Shares add up to 1, so a phrase with the global support reaches the lowered one in some shard at least.
2. Mine. Each shard is mined completely, level by level, by all tasks: tasks count the words and pairs of words of
   their part of each shard, Spark sums them by shard and hash, and those with the lowered support set
   their bits in a bitmap of 2^``BITS`` bits. Then longer phrases, all of whose pairs have their bits
   set, are counted by shard and kept in the same way. Equal hashes add up, which can only keep more.
3. Union. The bitmap holds the locally frequent phrases of all shards. Its size is fixed whatever the corpus; it is put
   together by Spark from 4 KB pieces and sent to all tasks.
4. Count. Tasks walk their texts again; phrases whose bits are set are counted exactly and travel, many to a
   row, to the bucket of their hash, where they are added up by their words. A phrase that shares a bit with another one is
   counted, exactly too, and then dropped by the support: collisions cost rows, never results.
5. Score. A candidate's parts are frequent themselves, so their counts are in the same table. Scores are exact
   decimals. Candidates that a longer candidate explains are dropped; one more word is enough to look
   at, since counts never grow with length. The best of each language are found per salt first, so that
   a language holding most rows is not one task.

Null text holds no words, a null language is ``und``. Repeated rows count each. An empty
table gives an empty result. Text is whole and its pieces never cross documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkwise.session import materialize

SUPPORT = 100
LONGEST = 5
TOP = 2000
#: At most 256: a key keeps its shard in a byte.
SHARDS = 4
#: Bytes of text that a task works on at once.
CHUNK = 8_000_000
#: Bytes of text for each bucket in which counts are added up.
BUCKET = 16_000_000
BITS = 27
SALTS = 64
#: Bits of one piece of Spark's bitmap functions.
PIECE_BITS = 32_768

#: A to Z in lower case, tabs as spaces, ends of pieces as a byte that no UTF-8 text holds.
LETTERS = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\xff" * 10)
ODD = np.uint64(0x9E3779B97F4A7C15)


class Chunk:
    """Word numbers of some texts, by group (language, or shard and language)."""

    def __init__(self):
        self.number: dict[bytes, int] = {b"\xff": -1}
        self.texts: dict[tuple, list[np.ndarray]] = {}
        self.size = 0

    def add(self, group: tuple, raw: bytes) -> None:
        number = self.number
        words = raw.translate(LETTERS).replace(b"\xff", b" \xff ").split()
        try:
            ids = [number[w] for w in words]
        except KeyError:
            for w in words:
                if w not in number:
                    number[w] = len(number) - 1
            ids = [number[w] for w in words]
        ids.append(-1)
        self.texts.setdefault(group, []).append(np.array(ids, np.int32))
        self.size += len(raw)

    def groups(self) -> Iterator[tuple[tuple, np.ndarray]]:
        for group, texts in self.texts.items():
            yield group, np.concatenate(texts)


def grams(ids: np.ndarray, longest: int, keep: Callable[[int, np.ndarray, np.ndarray], np.ndarray]
          ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first places, counts) of the phrases kept at each length.

    ``keep`` tells which distinct phrases (words, places, counts) stay; a longer phrase is
    looked at only where both of its parts stayed.
    """
    places = np.flatnonzero(ids >= 0)
    keys = ids[places].astype(np.int64)
    for k in range(1, longest + 1):
        _, first, back, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        first = places[first]
        kept = keep(k, first, counts)
        yield k, first[kept], counts[kept]
        if k == longest or not kept.any():
            return
        number = np.where(kept, np.cumsum(kept) - 1, -1)
        at = np.full(len(ids), -1, np.int64)
        at[places] = number[back]
        places = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
        keys = at[places] * int(kept.sum()) + at[places + 1]


def hashes(ids: np.ndarray, words: np.ndarray, lang: str, k: int, places: np.ndarray) -> np.ndarray:
    """Hash of each phrase of ``k`` words at ``places``; ``words`` holds the words' hashes."""
    h = np.full(len(places), zlib.crc32(lang.encode()), np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * ODD + words[ids[places + j]]
    return (h ^ (h >> np.uint64(32))) * ODD


def set_in(known: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have their bit set; a hash's first ``bits`` bits are its place."""
    bit = (h >> np.uint64(64 - bits)).astype(np.int64)
    return (known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def word_hashes(number: dict[bytes, int]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in number if w != b"\xff"), np.uint64, len(number) - 1)


def chunks(batches: Iterator[pa.RecordBatch], size: int, shards: int) -> Iterator[Chunk]:
    """The texts of a task by language and, with more than one shard, by shard."""
    chunk = Chunk()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_buffer().to_pybytes()
            chunk.add((lang, zlib.crc32(raw) % shards), raw)
            if chunk.size >= size:
                yield chunk
                chunk = Chunk()
    if chunk.size:
        yield chunk


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).where("text <> ''")


def shard_sizes(texts: DataFrame, shards: int) -> dict[int, int]:
    """Bytes of each shard that holds text."""
    sizes = texts.groupBy((F.crc32(F.col("text").cast("binary")) % shards).alias("shard")).agg(
        F.sum(F.octet_length("text").cast("long")).alias("size")).collect()
    return {r["shard"]: r["size"] for r in sizes}


def local_supports(sizes: dict[int, int], support: int) -> dict[int, int]:
    """The lowered support of each shard: its share of all bytes, rounded up."""
    return {shard: -(-support * size // sum(sizes.values())) for shard, size in sizes.items()}


def locally_frequent(texts: DataFrame, least: dict[int, int], lengths: range, known, shards: int, size: int,
                     bits: int) -> DataFrame:
    """(bit): places of the phrases of some lengths with the lowered support in some shard.

    ``known`` holds the bits of shorter phrases (None: all are looked at). The key of a phrase is its hash
    with the shard in the last byte.
    """
    def run(batches):
        bitmap = known.value if known else None
        for chunk in chunks(batches, size, shards):
            words = word_hashes(chunk.number)
            for (lang, shard), ids in chunk.groups():
                def keep(k, places, counts):
                    if bitmap is None or k >= lengths.start:
                        return np.ones(len(places), bool)
                    return set_in(bitmap, hashes(ids, words, lang, k, places), bits)

                for k, places, counts in grams(ids, lengths.stop - 1, keep):
                    if k in lengths:
                        h = hashes(ids, words, lang, k, places)
                        key = (h & np.uint64(0xFFFFFFFFFFFFFF00) | np.uint64(shard)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(counts.astype(np.int64))], ["key", "n"])

    counts = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    shard, support = F.col("key").bitwiseAND(F.lit(255)), F.lit(None)
    for number, lowered in least.items():
        support = F.when(shard == number, lowered).otherwise(support)
    return counts.where(F.col("n") >= support).select(F.shiftrightunsigned("key", 64 - bits).alias("bit"))


def bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """The union of all bits, 2^bits in size: the one thing that goes through the driver."""
    pieces = found.select((F.col("bit") + 1).alias("b")).select(
        F.bitmap_bucket_number("b").alias("piece"), F.bitmap_bit_position("b").alias("place"))
    rows = pieces.repartition("piece").groupBy("piece").agg(F.bitmap_construct_agg("place").alias("map"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.collect():
        at = (row["piece"] - 1) * PIECE_BITS // 8
        part = np.frombuffer(row["map"], np.uint8)[:len(out) - at]
        out[at:at + len(part)] = part
    return out


def chunk_counts(texts: DataFrame, known, longest: int, size: int, bits: int, buckets: int) -> DataFrame:
    """(bucket, lang, k, phrases, n): exact counts in a chunk of phrases whose bits are set, a row
    for each bucket of hashes; k = 0: all words."""

    def run(batches):
        bitmap = known.value
        for chunk in chunks(batches, size, 1):
            words, said = word_hashes(chunk.number), [w for w in chunk.number if w != b"\xff"]
            for (lang, _), ids in chunk.groups():
                def keep(k, places, counts):
                    return set_in(bitmap, hashes(ids, words, lang, k, places), bits)

                yield _packed(lang, 0, np.zeros(1, np.int64), [b""], np.array([(ids >= 0).sum()]))
                for k, places, counts in grams(ids, longest, keep):
                    bucket = (hashes(ids, words, lang, k, places) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    places, counts, bucket = places[order], counts[order], bucket[order]
                    columns = [map(said.__getitem__, ids[places + j].tolist()) for j in range(k)]
                    yield _packed(lang, k, bucket, [b" ".join(p) for p in zip(*columns)], counts)

    return texts.mapInArrow(run, "bucket long, lang string, k int, phrases array<string>, n array<long>")


def _packed(lang: str, k: int, bucket: np.ndarray, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket; ``bucket`` is sorted."""
    own, first = np.unique(bucket, return_index=True)
    ends = pa.array(np.append(first, len(bucket)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(own), pa.array([lang] * len(own), pa.string()), pa.array([k] * len(own), pa.int32()),
         pa.ListArray.from_arrays(ends, pa.array(phrases, pa.binary()).cast(pa.string())),
         pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64)))], ["bucket", "lang", "k", "phrases", "n"])


def global_counts(packed: DataFrame, support: int) -> DataFrame:
    """(lang, phrase, k, n) of the phrases that have the support over all chunks, and each language's words (k = 0).

    A task adds up one bucket after the other.
    """

    def run(batches):
        at, sums = None, Counter()
        for batch in batches:
            for bucket, lang, k, phrases, n in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket != at:
                    yield _summed(sums, support)
                    at, sums = bucket, Counter()
                for phrase, count in zip(phrases, n):
                    sums[lang, k, phrase] += count
        yield _summed(sums, support)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "lang string, phrase string, k int, n long")


def _summed(sums: Counter, support: int) -> pa.RecordBatch:
    rows = [(lang, phrase, k, n) for (lang, k, phrase), n in sums.items() if n >= support or not k]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                                      ["lang", "phrase", "k", "n"])


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS,
                     chunk: int = CHUNK, bits: int = BITS) -> DataFrame:
    """(lang, phrase, k, n): every phrase of 1 to ``longest`` words with its exact count, if that
    is at least ``support``; k = 0 holds each language's words."""
    texts, context = _texts(docs), docs.sparkSession.sparkContext
    sizes = shard_sizes(texts, shards)
    least = local_supports(sizes, support)
    union = bitmap(locally_frequent(texts, least, range(1, 3), None, shards, chunk, bits), bits)
    if longest > 2:
        shorter = context.broadcast(union)
        union = union | bitmap(locally_frequent(texts, least, range(3, longest + 1), shorter, shards, chunk, bits), bits)
        shorter.unpersist()
    known = context.broadcast(union)
    packed = chunk_counts(texts, known, longest, chunk, bits, max(64, sum(sizes.values()) // BUCKET))
    out = materialize(global_counts(packed, support), "frequent-phrases")
    known.unpersist()
    return out


def scored(frequent: DataFrame, explained: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of candidates that no longer candidate explains.

    A longer candidate explains those in it if it has ``explained`` percent of their count.
    """
    words = F.split("phrase", " ")
    phrases = frequent.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("words"))
    parts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(
        i.alias("cut"), F.array_join(F.slice("words", F.lit(1), i), " ").alias("first"),
        F.array_join(F.slice("words", i + 1, F.col("k") - i), " ").alias("rest")))
    cuts = phrases.select("lang", "phrase", "a", F.explode(parts).alias("p")).select("lang", "phrase", "a", "p.*")
    one = frequent.where("k >= 1")
    left = one.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = one.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    totals = frequent.where("k = 0").select("lang", F.col("n").alias("all"),
                                            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    ready = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("salt", salt).join(totals, ["lang", "salt"])
    wide = {c: F.col(c).cast("decimal(20,0)") for c in ("a", "l", "r", "all")}
    exact = ready.withColumns({f"d_{c}": v for c, v in wide.items()}).withColumn(
        "score", F.expr("cast(1000 as decimal(4,0)) * (d_a * d_all) div (d_l * d_r)"))
    lowest = exact.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "a", "l", "r", F.col("all").alias("n"))).alias("best"))
    # one word less at either end
    shorter = phrases.where("k >= 3").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("words", F.lit(2), F.col("k") - 1), " "),
        F.array_join(F.slice("words", F.lit(1), F.col("k") - 1), " "))).alias("phrase"))
    longer = shorter.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left_over = lowest.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < explained * F.col("best.a")))
    return left_over.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def best_collocations(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(
        F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, explained: int = 100,
                 shards: int = SHARDS, chunk: int = CHUNK, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of whole documents."""
    return best_collocations(scored(frequent_phrases(docs, support, longest, shards, chunk, bits), explained), top)
