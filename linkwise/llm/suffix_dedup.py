"""Repeated byte strings by induced sorting of suffixes.

* Reveal (first shuffle): every 50-byte window has an anchor, the least hashed 8-byte gram
  at a local minimum of its bytes (a leftmost-smaller place as far as 3 bytes tell; any place if it has
  none). 29 bytes around the anchor, whichever side lies in the window, are its
  context; contexts that occur in another document too are revealed.
* Shards (second shuffle): the stretches of text around revealed anchors go to the shard of their
  anchor's gram, so equal windows meet in one shard. Grams that slices spread evenly over the corpus show to
  fill much of a shard are dealt by the anchor's context key instead, their stretches cut where the side
  changes. Equal stretches of one portion of texts are sent for the smallest document id alone, their bytes once a document.
* Induced sorting (Nong, Zhang and Chan 2009) of each shard's distinct stretches: suffixes are classified
  as larger or smaller than their successor, leftmost-smaller substrings are sorted by inducing and
  named, the string of names is sorted (by rank doubling, as deep as 50 bytes reach), and the sorted
  leftmost-smaller suffixes induce all others in two linear sweeps. The sweeps move whole
  character buckets at a time, as arrays.
* Permuted common prefixes: in text order, each suffix is compared with its
  predecessor in the suffix array; runs of 50 common bytes give the groups of equal windows.
  A window is repeated if its group holds a smaller document id.

Texts are UTF-8 bytes; matches never cross documents. Null and empty texts have no bytes. Rows
of one id are told apart by their text; they are one document, so copies among them are not
removed. Null ids stay null and sort after all others. Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwise.llm import windows as X
from linkwise.llm.common import map_rows, text_bytes
from linkwise.session import materialize

WIDTH = 50
GRAM = 8
#: Characters of text per bucket of the two shuffles.
REVEAL_CHARS = 16_000_000
SHARD_CHARS = 2_000_000
LEAST_BUCKETS = 16
#: Bytes of stretches from which a gram is dealt by context.
GRAM_BYTES = 4_000_000
#: Bytes of stretches that are sorted at once; a gram's stretches stay together.
SORT_BYTES = 2_000_000
#: Slices of the corpus, and their characters, whose grams tell how to deal the shards.
SLICES, SLICE = 8192, 4096
SENTINEL, SEPARATOR, SHIFT = 0, 1, 2
ALPHABET = 256 + SHIFT


def grams(units: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number."""
    n = max(0, len(units) - GRAM + 1)
    return np.ndarray((n,), "<u8", np.ascontiguousarray(units), 0, (1,)).astype(np.uint64) if n else np.zeros(0, np.uint64)


class Anchors:
    """Anchors of ``WIDTH``-byte windows."""

    width, left = WIDTH, 21

    @staticmethod
    def units(text: str) -> np.ndarray:
        return np.frombuffer(text.encode(), np.uint8)

    def places(self, units: np.ndarray) -> np.ndarray:
        priority = X.mix(grams(units)) >> np.uint64(1)
        low = (units[:-2] > units[1:-1]) & (units[1:-1] < units[2:])
        priority[1:][~low[:len(priority) - 1]] |= np.uint64(1 << 63)
        n = len(units) - self.width + 1
        return X.least_places(priority[1:], self.width - GRAM)[:n] + 1

    def keys(self, units: np.ndarray, codes: np.ndarray) -> np.ndarray:
        place, right, g = codes >> 1, (codes & 1).astype(bool), grams(units)
        step = np.where(right, 1, -1)
        out = g[place]
        for i, reach in enumerate((8, 16, 21)):
            out = X.mix(out ^ np.uint64(i + 1)) + g[place + step * reach]
        return X.mix(out ^ right.astype(np.uint64))


def classify(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor; ``t`` ends with the sentinel."""
    step = np.diff(t.astype(np.int32))
    at = np.where(step != 0, np.arange(len(step), dtype=np.int32), np.int32(len(step)))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step[following] > 0, True)


def _deal(buckets: list[list], places: np.ndarray, letters: np.ndarray) -> None:
    """Append the places to the buckets of their letters, in order."""
    if not len(places):
        return
    order = np.argsort(letters, kind="stable")
    places, letters = places[order], letters[order]
    starts = X.first_of_runs(letters)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(letters)]):
        buckets[letters[a]].append(places[a:b])


def _joined(parts: list) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def induce(t: np.ndarray, smaller: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Order of all suffixes from the order of the leftmost-smaller ones (``heads``)."""
    seeds: list[list] = [[] for _ in range(ALPHABET)]
    larger: list[list] = [[] for _ in range(ALPHABET)]
    lesser: list[list] = [[] for _ in range(ALPHABET)]
    _deal(seeds, heads, t[heads])

    def before(places, kind):
        places = places[places > 0] - 1
        places = places[smaller[places] == kind]
        return places, t[places]

    for c in range(ALPHABET):
        done = 0
        while done < len(larger[c]):
            batch, done = _joined(larger[c][done:]), len(larger[c])
            _deal(larger, *before(batch, False))
        _deal(larger, *before(_joined(seeds[c]), False))
    for c in range(ALPHABET - 1, -1, -1):
        done = 0
        while done < len(lesser[c]):
            batch, done = _joined(lesser[c][done:]), len(lesser[c])
            _deal(lesser, *before(batch, True))
        _deal(lesser, *before(_joined(larger[c])[::-1], True))
    return np.concatenate([x for c in range(ALPHABET) for x in (_joined(larger[c]), _joined(lesser[c])[::-1])])


_LETTERS = X.mix(np.arange(1, ALPHABET + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = 0xD6E8FEB86659FD93


def substring_names(t: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of substrings [place, ends) given in sorted order: equal neighbours share one."""
    n = len(t)
    powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(_ODD)))))
    inverse = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(_ODD, -1, 2**64))))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_LETTERS[t] * powers[:n], dtype=np.uint64)))
    hashed, size = (sums[ends] - sums[order]) * inverse[order], ends - order
    return np.cumsum(np.concatenate(([True], (hashed[1:] != hashed[:-1]) | (size[1:] != size[:-1]))))


def suffix_array(units: np.ndarray, depth: int) -> np.ndarray:
    """Places of the letters (>= 1) in suffix order; suffixes that agree on ``depth`` letters are neighbours."""
    if not len(units):
        return np.zeros(0, np.int32)
    t = np.append(units, SENTINEL).astype(np.uint16)
    smaller = classify(t)
    heads = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    is_head = np.zeros(len(t), bool)
    is_head[heads] = True
    rough = induce(t, smaller, heads)
    # the sentinel, itself leftmost-smaller, is no product of inducing
    order = np.concatenate((heads[-1:], rough[is_head[rough] & (rough < len(t) - 1)]))
    number = np.empty(len(t), np.int32)
    number[heads] = np.arange(len(heads))
    ends = np.append(heads[1:] + 1, len(t))[number[order]]
    rank = np.empty(len(heads), np.int64)
    rank[number[order]] = substring_names(t, order, ends)
    reach = 1
    while 2 * reach < depth and rank.max() < len(rank):
        beyond = np.concatenate((rank[reach:], np.zeros(min(reach, len(rank)), np.int64)))[:len(rank)]
        rank = np.unique(rank * (len(rank) + 1) + beyond, return_inverse=True)[1].astype(np.int64) + 1
        reach *= 2
    out = induce(t, smaller, heads[np.argsort(rank, kind="stable")])
    return out[out < len(units)]


def repeated_places(body: np.ndarray, array: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Permuted common prefixes: which places share ``width`` bytes with their predecessor in ``array``."""
    previous = np.full(len(body), -1, np.int64)
    previous[array[1:]] = array[:-1]
    here = np.flatnonzero(previous >= 0)
    there, g = previous[here], grams(np.append(body, np.zeros(width + GRAM, np.uint8)))
    for reach in [*range(0, width - GRAM, GRAM), width - GRAM]:
        same = g[here + reach] == g[there + reach]
        here, there = here[same], there[same]
    out = np.zeros(len(body), bool)
    out[here] = True
    return out


def sorted_repeats(bodies: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window) of the windows that a stretch of a smaller id holds too."""
    n, lengths = len(bodies), np.fromiter(map(len, bodies), np.int64, len(bodies))
    own = np.repeat(np.arange(n), lengths)
    at = np.arange(len(own)) + own
    t = np.full(len(own) + n, SEPARATOR, np.uint16)
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    t[at] = raw.astype(np.uint16) + SHIFT
    body = np.zeros(len(t), np.uint8)
    body[at] = raw
    local = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    window = local <= np.repeat(lengths, lengths) - WIDTH
    of = np.full(len(t), -1, np.int64)
    of[at[window]] = np.flatnonzero(window)
    array = suffix_array(t, WIDTH + 1)
    array = array[of[array] >= 0].astype(np.int64)
    same = repeated_places(body, array)
    place = of[array]
    opens = np.flatnonzero(~same[array])
    group_ids = ids[own[place]]
    least = np.repeat(np.minimum.reduceat(group_ids, opens), np.diff(np.append(opens, len(array))))
    hit = place[group_ids > least]
    return own[hit], local[hit]


def sorting_chunks(chosen: np.ndarray, gram: list[bytes], distinct: list[bytes]):
    """The chosen stretches in chunks of about ``SORT_BYTES``, those of a gram in one."""
    number: dict[bytes, int] = {}
    names = np.fromiter((number.setdefault(gram[j], len(number)) for j in chosen.tolist()), np.int64, len(chosen))
    order = np.argsort(names, kind="stable")
    chosen, names = chosen[order], names[order]
    ends = np.cumsum(np.fromiter((len(distinct[j]) + 1 for j in chosen.tolist()), np.int64, len(chosen)))
    opens = X.first_of_runs(names)
    last = np.append(opens[1:], len(names)) - 1
    cuts = opens[X.first_of_runs((ends[last] - 1) // SORT_BYTES)]
    yield from np.split(chosen, cuts[1:])


def shard_repeats(parts: list[bytes], anchors: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window) of the windows that a smaller id holds too; ``anchors``: their place in the stretch.

    Equal stretches are sorted once, for their smallest id. Equal windows have the same gram at
    their anchor, so a stretch whose gram no other distinct stretch has needs no sorting, and grams are sorted
    in chunks.
    """
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(p, len(number)) for p in parts), np.int64, len(parts))
    distinct, least = list(number), np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    anchor = np.zeros(len(distinct), np.int64)
    anchor[which] = anchors
    gram = [p[a:a + GRAM] for p, a in zip(distinct, anchor.tolist())]
    often: dict[bytes, int] = {}
    for g in gram:
        often[g] = often.get(g, 0) + 1
    chosen = np.flatnonzero(np.fromiter((often[g] > 1 for g in gram), bool, len(gram)))
    lead = ids == least[which]
    away = np.flatnonzero(~lead)
    count = np.fromiter((len(parts[j]) - WIDTH + 1 for j in away.tolist()), np.int64, len(away))
    found = [(np.repeat(away, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))]
    if len(chosen):
        owners = np.flatnonzero(lead)
        owners = owners[np.argsort(which[owners], kind="stable")]
        for some in sorting_chunks(chosen, gram, distinct):
            at, window = sorted_repeats([distinct[j] for j in some.tolist()], least[some])
            low = np.searchsorted(which[owners], some[at], "left")
            many = np.searchsorted(which[owners], some[at], "right") - low
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append((owners[np.repeat(low, many) + inside], np.repeat(window, many)))
    return tuple(np.concatenate(x) for x in zip(*found))


def frequent_grams(texts: DataFrame, finder: Anchors, size: int) -> np.ndarray:
    """Anchor grams whose stretches would hold more than about ``GRAM_BYTES`` bytes, ascending.

    Counted on slices that lie evenly over all texts. They decide to which shards stretches go, not what is found.
    """
    step = size // SLICES
    if step <= SLICE:
        return np.zeros(0, np.uint64)
    first, chars = F.pmod(F.xxhash64("id", "version"), F.lit(step)) + 1, F.length("text").cast("long")
    places = F.when(first <= chars, F.sequence(first, chars, F.lit(step).cast("long")))
    slices = texts.select("text", F.explode(places).alias("at")).select(
        F.substr("text", F.col("at").cast("int"), F.lit(SLICE)).alias("text"))

    def counted(batch: pa.RecordBatch):
        found = []
        for text in batch.column("text").to_pylist():
            units = finder.units(text)
            place = X.codes_of(finder, units) >> 1
            opens = X.first_of_runs(place)
            sizes = np.diff(np.append(opens, len(place))) + WIDTH - 1
            found.append((grams(units)[place[opens]], sizes))
        gram, sizes = map(np.concatenate, zip(*found))
        gram, which = np.unique(gram, return_inverse=True)
        held = np.bincount(which, sizes, len(gram)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(held)], ["gram", "held"])

    held = map_rows(slices, X.in_portions(counted), "gram long, held long").groupBy("gram").agg(F.sum("held").alias("held"))
    often = held.where(F.col("held") * F.lit(step / SLICE) > F.lit(float(GRAM_BYTES))).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in often], np.int64).view(np.uint64))


def verified(texts: DataFrame, finder: Anchors, shards: int, frequent: np.ndarray) -> DataFrame:
    """(id, version, places): runs of starts of windows that a smaller document id holds too.

    Stretches at ``frequent`` grams are dealt to the shards by their anchors' context keys.
    """

    def stretches(batch: pa.RecordBatch):
        ids, versions = batch.column("id").to_numpy(), batch.column("version").to_numpy()
        docs, starts, grams_at, anchors, parts = [], [], [], [], []
        for i, (text, places) in enumerate(zip(batch.column("text").to_pylist(), batch.column("places").to_pylist())):
            units = finder.units(text)
            at, codes = X.selected(finder, units, places)
            if not len(at):
                continue
            place = codes >> 1
            gram = grams(units)[place]
            hot = np.isin(gram, frequent)
            other = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1) | hot[1:] & (codes[1:] != codes[:-1])
            opens = np.flatnonzero(np.concatenate(([True], other)))
            last = at[np.append(opens[1:], len(at)) - 1] + WIDTH
            raw = units.tobytes()
            docs.append(np.full(len(opens), i))
            starts.append(at[opens])
            dealt = X.mix(gram[opens])
            hot = np.flatnonzero(hot[opens])
            if len(hot):
                dealt[hot] = finder.keys(units, codes[opens[hot]])
            grams_at.append(dealt)
            anchors.append(place[opens] - at[opens])
            parts += [raw[a:b] for a, b in zip(at[opens].tolist(), last.tolist())]
        if not docs:
            return
        docs, starts, grams_at, anchors = map(np.concatenate, (docs, starts, grams_at, anchors))
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(p, len(number)) for p in parts), np.int64, len(parts))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[docs])
        lead = ids[docs] == least[which]
        sizes = np.fromiter(map(len, parts), np.uint16, len(parts))
        packer = X.Packer(ids, versions)
        kept = np.flatnonzero(lead)
        kept = kept[np.lexsort((which[kept], docs[kept]))]
        again = np.zeros(len(kept), bool)
        again[1:] = (which[kept[1:]] == which[kept[:-1]]) & (docs[kept[1:]] == docs[kept[:-1]])
        # shape 0: the bytes of the stretch before
        shapes = np.where(again, np.uint16(0), sizes[kept] | (anchors[kept].astype(np.uint16) << np.uint16(8)))
        rows = list(packer.rows((grams_at[kept] % np.uint64(shards)).astype(np.int32), docs[kept], starts[kept], k2=shapes,
                                body=lambda mine: b"".join([parts[j] for j in kept[mine[~again[mine]]].tolist()])))
        # stretches that a smaller id of the same portion holds too need only the way back
        away = np.flatnonzero(~lead)
        count = sizes[away].astype(np.int64) - WIDTH + 1
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rows += packer.rows(np.repeat(docs[away] % shards, count).astype(np.int32), np.repeat(docs[away], count),
                            np.repeat(starts[away], count) + inside, gone=True)
        yield X.packed_batch(rows)

    def sorted_shard(table: pa.Table) -> pa.Table:
        own, back = table.filter(pc.invert(table["gone"])), X.unpacked(table.filter(table["gone"]))
        ids, versions, starts, _, shape = X.unpacked(own, np.uint16)
        at, places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(ids):
            new = shape > 0
            ends = np.cumsum(shape[new] & 255, dtype=np.int64).tolist()
            raw = b"".join(own["body"].to_pylist())
            bodies = [raw[a:b] for a, b in zip([0, *ends], ends)]
            del raw
            of = np.cumsum(new) - 1
            at, window = shard_repeats([bodies[j] for j in of.tolist()], (shape[new] >> 8)[of], ids)
            places = starts[at].astype(np.int64) + window
        return X.runs_home(*[np.concatenate([a, b]) for a, b in zip((ids[at], versions[at], places), back)], shards)

    return X.gathered(map_rows(texts, X.in_portions(stretches), X.PACKED).groupBy("bucket").applyInArrow(sorted_shard, X.PACKED))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, places): per document the runs of windows that a smaller id holds too."""
    finder, texts, size = Anchors(), X.versioned(docs, id_col, text_col), text_bytes(docs, text_col)
    buckets, shards = max(LEAST_BUCKETS, -(-size // REVEAL_CHARS)), max(LEAST_BUCKETS, -(-size // SHARD_CHARS))
    found = materialize(X.revealed(texts, finder, buckets, across=True), "suffix-revealed")
    frequent = frequent_grams(texts, finder, size)
    runs = materialize(verified(X.with_places(texts, found, "inner"), finder, shards, frequent), "suffix-runs")
    return runs


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256 [, kept]): one row per input row."""
    runs = repeated_windows(docs, id_col, text_col)

    def finish(batch: pa.RecordBatch):
        sizes, removed, spans, kept = [], [], [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
            raw = text.encode()
            sizes.append(len(raw))
            if places:
                gone = X.covered(len(raw), places, WIDTH)
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            else:
                removed.append(0)
                spans.append(0)
            kept.append(raw)
        columns = [batch.column("id")] + [pa.array(c, pa.int64()) for c in (sizes, removed, spans)] + [
            pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_bytes:
            columns.append(pa.array(kept, pa.binary()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(columns, names)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return map_rows(X.with_places(X.versioned(docs, id_col, text_col), runs, "left"), X.in_portions(finish), schema)
