"""String similarity for pair comparison.

Levenshtein is Spark's built-in ``levenshtein``. Jaro-Winkler has no built-in. A
batch of pairs is turned into a dictionary of values and the distinct pairs of its
codes; those are scored together as arrays, one step per character position for all of them. The places of a
character in a value are the bits of one word, so a step takes a few operations on words. Equal
values and values that a bound over lengths and prefix keeps below the lowest
cut-off are answered in the JVM and reach the UDF as nulls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, LongType

# FIXED VALUES: Winkler prefix scale, longest prefix counted, boost threshold
PREFIX_SCALE = 0.1
MAX_PREFIX = 4
BOOST_THRESHOLD = 0.7


#: Cells of one character matrix: few enough to stay in a core's cache.
CELLS = 40_000
#: Most characters of a value whose places fit a word of 64 bits.
WORD = 63
ONE = np.uint64(1)
#: Pairs scored together by words, and most words of a batch: characters at hand times right values.
WORD_ROWS = 4_096
WORD_CELLS = 2**21
#: Room for rounding: a bound this little below a cut-off does not rule a pair out.
EPSILON = 1e-9


def code_points(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the values one after the other, and where each value starts (one more at the end)."""
    lengths = np.fromiter((len(v) for v in values), np.int64, len(values))
    flat = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.int32)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def matrix(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray, width: int, filler: int) -> np.ndarray:
    """One row of characters per value of ``rows``, filled up to ``width``."""
    at = np.arange(width)
    lengths = (starts[1:] - starts[:-1])[rows]
    inside = at < lengths[:, None]
    out = np.full((len(rows), width), filler, np.int32)
    out[inside] = flat[(starts[rows][:, None] + at)[inside]]
    return out


def matches_first(chars: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The matched characters of each row moved to its front, in their order."""
    return np.take_along_axis(chars, np.argsort(~hit, axis=1, kind="stable"), axis=1)


def jaro_winkler_matrix(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Similarity of each row of ``a`` with the same row of ``b``.

    A character takes the first free equal one inside its window of the other side; the loop
    runs over positions, each step over all rows.
    """
    n, width = a.shape
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    at = np.arange(b.shape[1])
    hit, free, rows = np.zeros(a.shape, bool), np.ones(b.shape, bool), np.arange(n)
    for i in range(width):
        fits = b == a[:, i:i + 1]
        fits &= free
        fits &= np.abs(at - i) <= window
        first = fits.argmax(axis=1)
        hit[:, i] = fits[rows, first]
        free[rows, first] &= ~hit[:, i]
    m = hit.sum(axis=1)
    together = min(a.shape[1], b.shape[1])
    moved = (matches_first(a, hit)[:, :together] != matches_first(b, ~free)[:, :together]) & (np.arange(together) < m[:, None])
    head = min(MAX_PREFIX, together)
    prefix = np.cumprod(a[:, :head] == b[:, :head], axis=1).sum(axis=1) if head else np.zeros(n, np.int64)
    return boosted(m, moved.sum(axis=1), prefix, la, lb)


def boosted(m: np.ndarray, moved: np.ndarray, prefix: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Similarity from matched characters, those out of order among them, and the common prefix."""
    # transpositions: half the out-of-order matches, rounded down
    straight = m - moved // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + straight / m) / 3.0, 0.0)
    return np.where(jaro > BOOST_THRESHOLD, jaro + prefix * PREFIX_SCALE * (1.0 - jaro), jaro)


def lowest_bit(words: np.ndarray) -> np.ndarray:
    return words & (~words + ONE)


def jaro_winkler_words(at: np.ndarray, places: np.ndarray, l: np.ndarray, r: np.ndarray, la: np.ndarray, lb: np.ndarray,
                       window: int) -> np.ndarray:
    """The same as ``jaro_winkler_matrix`` for values of at most ``WORD`` characters, whose pairs share a window.

    ``at[i]`` has character ``i`` of every left value, row ``v`` of ``places`` the positions of each character in
    the right value ``v`` as bits; the last column, for characters past an end, is empty.
    """
    start, flat = r * places.shape[1], places.ravel()
    whole = (ONE << lb.astype(np.uint64)) - ONE
    free, found, hits = whole.copy(), [], []
    prefix, same = np.zeros(len(l), np.int64), np.ones(len(l), bool)
    for i in range(int(la.max())):
        here = flat.take(start + at[i].take(l))
        inside = sum(1 << j for j in range(max(0, i - window), min(WORD, i + window + 1)))
        bit = lowest_bit(here & free & np.uint64(inside))
        free ^= bit
        found.append(here)
        hits.append(bit != 0)
        if i < MAX_PREFIX:
            same &= (here >> np.uint64(i)) & ONE != 0
            prefix += same
    left = whole ^ free
    m, moved = np.bitwise_count(left).astype(np.int64), np.zeros(len(l), np.int64)
    for here, hit in zip(found, hits):
        bit = lowest_bit(left) * hit
        moved += hit & (here & bit == 0)
        left ^= bit
    return boosted(m, moved, prefix, la, lb)


def jaro_winkler_short(flat_l: np.ndarray, start_l: np.ndarray, flat_r: np.ndarray, start_r: np.ndarray, l: np.ndarray,
                       r: np.ndarray) -> np.ndarray:
    """Similarity of pairs of values of at most ``WORD`` characters, a word of bits for each character of a value."""
    letters, codes = np.unique(np.concatenate([flat_l, flat_r]), return_inverse=True)
    codes_l, codes_r, empty = codes[:len(flat_l)], codes[len(flat_l):], len(letters)
    len_l, len_r = np.diff(start_l), np.diff(start_r)
    some_l, some_r = np.flatnonzero(len_l <= WORD), np.flatnonzero(len_r <= WORD)
    at = np.full((int(len_l[some_l].max(initial=1)), len(len_l)), empty, np.int64)
    for i in range(len(at)):
        rows = some_l[len_l[some_l] > i]
        at[i, rows] = codes_l[start_l[rows] + i]
    places = np.zeros((len(len_r), empty + 1), np.uint64)
    for i in range(int(len_r[some_r].max(initial=0))):
        rows = some_r[len_r[some_r] > i]
        places[rows, codes_r[start_r[rows] + i]] |= ONE << np.uint64(i)
    la, lb = len_l[l], len_r[r]
    windows = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    out = np.zeros(len(l))
    for window in np.flatnonzero(np.bincount(windows)):
        rows = np.flatnonzero(windows == window)
        for k in range(0, len(rows), WORD_ROWS):
            some = rows[k:k + WORD_ROWS]
            out[some] = jaro_winkler_words(at, places, l[some], r[some], la[some], lb[some], int(window))
    return out


def jaro_winkler_pairs(left: list[str], right: list[str], l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Similarity of ``left[l[i]]`` and ``right[r[i]]``; pairs of like width share a matrix, short ones go by words."""
    flat_l, start_l = code_points(left)
    flat_r, start_r = code_points(right)
    la, lb, out = np.diff(start_l)[l], np.diff(start_r)[r], np.zeros(len(l))
    longest = np.maximum(la, lb)
    letters = len(np.unique(np.concatenate([flat_l, flat_r])))
    short = (longest <= WORD) if (letters + 1) * len(right) <= WORD_CELLS else np.zeros(len(l), bool)
    if short.any():
        out[short] = jaro_winkler_short(flat_l, start_l, flat_r, start_r, l[short], r[short])
    order = np.flatnonzero(~short)
    order = order[np.argsort(longest[order], kind="stable")]
    at = 0
    while at < len(order):
        # as many rows as fit at the width of the last of them
        step = max(1, CELLS // max(1, int(max(la[order[at]], lb[order[at]]))))
        some = order[at:at + step]
        width = max(1, int(np.maximum(la[some], lb[some]).max()))
        some = some[:max(1, CELLS // width)]
        width_a, width_b = max(1, int(la[some].max())), max(1, int(lb[some].max()))
        out[some] = jaro_winkler_matrix(matrix(flat_l, start_l, l[some], width_a, -1),
                                        matrix(flat_r, start_r, r[some], width_b, -2), la[some], lb[some])
        at += len(some)
    return out


def jaro_winkler(a: str, b: str) -> float:
    zero = np.zeros(1, np.int64)
    return float(jaro_winkler_pairs([a], [b], zero, zero)[0])


def jaro_winkler_batch(left: pa.Array, right: pa.Array) -> pa.Array:
    """Similarity of two string arrays; null where a side is null."""
    valid = np.logical_and(left.is_valid().to_numpy(False), right.is_valid().to_numpy(False))
    out = np.zeros(len(left))
    if valid.any():
        l, r = left.dictionary_encode(), right.dictionary_encode()
        code_l = l.indices.fill_null(0).to_numpy(False).astype(np.int64)[valid]
        code_r = r.indices.fill_null(0).to_numpy(False).astype(np.int64)[valid]
        key, back = np.unique(code_l * len(r.dictionary) + code_r, return_inverse=True)
        scores = jaro_winkler_pairs(l.dictionary.to_pylist(), r.dictionary.to_pylist(), key // len(r.dictionary),
                                    key % len(r.dictionary))
        out[valid] = scores[back]
    return pa.array(out, pa.float64(), mask=~valid)


@arrow_udf(DoubleType())
def jaro_winkler_udf(left: pa.Array, right: pa.Array) -> pa.Array:
    return jaro_winkler_batch(left, right)


def jaro_winkler_bound(l: Column, r: Column) -> Column:
    """An upper bound of the similarity from lengths and the common prefix."""
    short, long = F.least(F.length(l), F.length(r)), F.greatest(F.length(l), F.length(r))
    jaro = F.when(short > 0, (2.0 + short / long) / 3.0).otherwise(0.0)
    prefix = F.lit(0)
    for i in range(1, MAX_PREFIX + 1):
        prefix = F.when((short >= i) & (F.substring(l, 1, i) == F.substring(r, 1, i)), i).otherwise(prefix)
    return F.when(jaro > BOOST_THRESHOLD, jaro + prefix * PREFIX_SCALE * (1.0 - jaro)).otherwise(jaro)


def may_reach(left: Column, right: Column, cut: float) -> Column:
    """The values differ and their similarity may reach ``cut``."""
    return (left != right) & (jaro_winkler_bound(left, right) >= F.lit(cut - EPSILON))


def similarity_where(scored: Column, left: Column, right: Column) -> Column:
    """The similarity of the values where ``scored``, else null."""
    return jaro_winkler_udf(F.when(scored, left), F.when(scored, right))


def jaro_winkler_similarity(left: Column, right: Column) -> Column:
    """Jaro-Winkler similarity in [0, 1]; null if either side is null."""
    return jaro_winkler_udf(left, right)


#: Bits of a value's marks for characters in it, and for those in it twice.
ONCE, TWICE = 39, 25


def character_marks(values: list[str]) -> np.ndarray:
    """A word per value: a bit for each character in it, another for each one in it twice (characters may share a bit).

    A replaced character changes two bits at most, one put in or left out a single one.
    """
    flat, starts = code_points(values)
    rows = np.repeat(np.arange(len(values)), np.diff(starts))
    order = np.lexsort((flat, rows))
    rows, chars = rows[order], flat[order].astype(np.int64)
    again = np.zeros(len(rows), bool)
    again[1:] = (rows[1:] == rows[:-1]) & (chars[1:] == chars[:-1])
    out = np.zeros(len(values), np.int64)
    np.bitwise_or.at(out, rows, np.left_shift(1, np.where(again, ONCE + chars % TWICE, chars % ONCE)))
    return out


@arrow_udf(LongType())
def character_marks_udf(values: pa.Array) -> pa.Array:
    return pa.array(character_marks(values.fill_null("").to_pylist()), pa.int64())


def levenshtein_distance(left: Column, right: Column, max_distance: int | None = None) -> Column:
    """Edit distance; with ``max_distance`` values above it come back as -1."""
    if max_distance is None:
        return F.levenshtein(left, right)
    return F.levenshtein(left, right, max_distance)
