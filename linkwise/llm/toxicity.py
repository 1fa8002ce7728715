"""Toxic passages as maximum-scoring segments over token log-odds.

Learning (labelled rows outside the held-out fold only):

* ``labelled_sample`` takes at most ``sample_rows`` labelled documents by a hash
  order (the documented bound of the training sample) and splits them by crc32:
  folds 1-3 give token counts, fold 4 calibrates.
* Token log-odds with an informative Dirichlet prior (Monroe, Colaresi and Quinn
  2008): the prior of a token is its pooled share times a tenth of all tokens; a
  token is kept if its z-score is beyond ``MIN_Z`` and at least ``MIN_DOCS``
  distinct texts hold it; counts are distinct texts, so neither copies nor a word
  repeated in one text count twice. Tokens are words and their prefixes of 3 to 8 letters, so
  inflections of a known stem score too: a word takes the log-odds of whichever of
  its tokens has the largest z-score; without evidence it gets a small negative score.
* Extreme-value calibration (Karlin and Altschul 1990): the best segment score of
  a clean text of n words follows P(S > x) = 1 - exp(-K n exp(-lambda x)); K and
  lambda are fitted on clean calibration documents by maximum likelihood, and a
  logistic curve over -ln(K n exp(-lambda S)) turns significance into a
  probability.

Scoring reads whole texts in one linear scan: the best segment by running
minimum of the prefix sums, and for significant texts every maximal segment
(Ruzzo and Tompa 1999) with its own E-value.

Null or empty texts have no words: best score 0 over one word, so they get the
clean end of the scale. Without labelled rows of both classes every score is 0.
Repeated rows are scored each for itself; null ids and extra columns are kept out
of the score. Labels of one document that disagree count as toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwise.llm.common import crc_fold, id_text, map_rows
from linkwise.session import materialize

SAMPLE_ROWS = 20_000
MAX_FEATURES = 50_000
PREFIXES = (8, 7, 6, 5, 4, 3)
PRIOR_SHARE = 0.1
MIN_Z = 3.5
MIN_DOCS = 4
DRIFT = -0.05
#: Passages are reported up to this many expected chance passages per text.
MAX_EVALUE = 0.01
CACHE_WORDS = 200_000
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    odds: dict[str, tuple[float, float]]
    drift: float
    lam: float
    k: float
    slope: float
    bias: float


def features(word: str) -> list[str]:
    """The word and its prefixes, longest first; prefixes carry a ``*``."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


class _Scores(dict):
    """Score of each word, worked out once."""

    def __init__(self, odds: dict[str, tuple[float, float]], drift: float):
        super().__init__()
        self.odds, self.drift = odds, drift

    def __missing__(self, word: str) -> float:
        known = [self.odds[f] for f in features(word) if f in self.odds]
        score = max(known, key=lambda x: abs(x[1]))[0] if known else self.drift
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = score
        return score


def best_segment(scores: np.ndarray) -> float:
    """Largest sum of consecutive scores; 0 for none."""
    if not len(scores):
        return 0.0
    sums = np.cumsum(scores)
    low = np.minimum.accumulate(np.concatenate(([0.0], sums[:-1])))
    return max(0.0, float((sums - low).max()))


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in one pass."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, right = i, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, i + 1, left, right))
    return [(a, b, r - l) for a, b, l, r in stack]


def labelled_sample(labels: DataFrame, sample_rows: int = SAMPLE_ROWS, held_out: int = 0) -> DataFrame:
    """(id, fold, toxic) of at most ``sample_rows`` labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        "id is not null and toxic is not null")
    one = known.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("fold", crc_fold(F.col("id")))
    return one.where(F.col("fold") != held_out).orderBy(F.xxhash64("id"), "id").limit(sample_rows)


def token_counts(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, clean): distinct texts of each class that hold it."""

    def run(batch: pa.RecordBatch):
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[1 if toxic else 0].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        columns = [[c[x] for x in names] for c in (counts[1], counts[0])]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())] + [pa.array(c, pa.int64()) for c in columns],
                                         ["feature", "toxic", "clean"])

    once = labelled.dropDuplicates(["text", "toxic"]).select("text", "toxic")
    parts = map_rows(once, run, "feature string, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame) -> DataFrame:
    """(feature, odds, z): log-odds with the pooled counts as Dirichlet prior."""
    words = F.when(~F.col("feature").endswith("*"), 1).otherwise(0)
    totals = counts.agg(F.sum(F.col("toxic") * words).alias("nt"), F.sum(F.col("clean") * words).alias("nc")).collect()[0]
    nt, nc = float(totals["nt"] or 0), float(totals["nc"] or 0)
    if not nt or not nc:
        return counts.select("feature", F.lit(0.0).alias("odds"), F.lit(0.0).alias("z")).where(F.lit(False))
    prior, all_prior = (F.col("toxic") + F.col("clean")) * F.lit(PRIOR_SHARE), PRIOR_SHARE * (nt + nc)
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(t / (F.lit(nt + all_prior) - t)) - F.log(c / (F.lit(nc + all_prior) - c))
    scored = counts.where(F.col("toxic") + F.col("clean") >= MIN_DOCS).select(
        "feature", odds.alias("odds"), (odds / F.sqrt(1 / t + 1 / c)).alias("z"))
    return scored.where(F.abs("z") >= MIN_Z)


def fit_extremes(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of the extreme-value law by maximum likelihood."""
    grid = np.geomspace(0.02, 5.0, 120)
    words = np.maximum(words, 1).astype(float)

    def at(lam):
        tail = words * np.exp(-lam * best)
        k = len(best) / tail.sum()
        return float((np.log(k * lam * words) - lam * best - k * tail).sum()), k

    lam = max(grid, key=lambda x: at(x)[0])
    return float(lam), float(at(lam)[1])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, bias) by Newton steps with a weak ridge."""
    scale = max(1.0, float(np.abs(x).max()))
    design = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 1e-2 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model, or None where the sample lacks one of the classes.

    The labels' sample is broadcast (at most ``sample_rows`` rows); the driver
    receives at most ``MAX_FEATURES`` log-odds and one (best score, words, label)
    row per calibration document of the sample.
    """
    sample = F.broadcast(labelled_sample(labels, sample_rows))
    labelled = id_text(docs).join(sample, "id")
    table = log_odds(materialize(token_counts(labelled.where("fold <= 3")), "toxicity-counts"))
    odds = {r["feature"]: (float(r["odds"]), float(r["z"])) for r in
            table.orderBy(F.abs("z").desc(), "feature").limit(MAX_FEATURES).collect()}
    if not any(v > 0 for v, _ in odds.values()):
        return None
    drift = DRIFT

    def run(batch: pa.RecordBatch):
        scores = _Scores(odds, drift)
        best, n = [], []
        for text in batch.column("text").to_pylist():
            s = np.array([scores[w] for w in WORD.findall(text.lower())])
            best.append(best_segment(s))
            n.append(len(s))
        yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(n, pa.int64()), batch.column("toxic")],
                                         ["best", "words", "toxic"])

    rows = map_rows(labelled.where("fold > 3").select("text", "toxic"), run,
                    "best double, words long, toxic int").toPandas()
    y = (rows["toxic"].to_numpy() > 0).astype(float)
    best, words = rows["best"].to_numpy(float), np.maximum(rows["words"].to_numpy(float), 1)
    if not 0 < y.sum() < len(y):
        return None
    lam, k = fit_extremes(best[y == 0], words[y == 0])
    slope, bias = fit_logistic(lam * best - np.log(k * words), y)
    return Model(odds, drift, lam, k, slope, bias)


def _score(model: Model, scores: _Scores, text: str | None):
    """(probability, words' matches or None, maximal segments that are significant)."""
    lowered = (text or "").lower()
    s = np.array([scores[w] for w in WORD.findall(lowered)])
    n = max(len(s), 1)
    best = best_segment(s)
    x = model.lam * best - math.log(model.k * n)
    p = 1 / (1 + math.exp(-max(-700.0, min(700.0, model.slope * x + model.bias))))
    if model.k * n * math.exp(-model.lam * best) > MAX_EVALUE:
        return p, []
    found = [(a, b, v) for a, b, v in maximal_segments(s.tolist())
             if model.k * n * math.exp(-model.lam * v) <= MAX_EVALUE]
    return p, found


PASSAGES = "array<struct<start_word:int,end_word:int,score:double,evalue:double>>"


def passages(docs: DataFrame, model: Model | None) -> DataFrame:
    """(id, score, passages): every significant segment with its word range, score and E-value."""
    kind = pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()),
                               ("evalue", pa.float64())]))

    def run(batch: pa.RecordBatch):
        scores = _Scores(model.odds, model.drift) if model else None
        out, where = [], []
        for text in batch.column(1).to_pylist():
            p, found = _score(model, scores, text) if model else (0.0, [])
            n = max(1, len(WORD.findall(text))) if found else 1
            out.append(p)
            where.append([{"start_word": a, "end_word": b, "score": v,
                           "evalue": model.k * n * math.exp(-model.lam * v)} for a, b, v in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(where, kind)],
                                         ["id", "score", "passages"])

    return map_rows(id_text(docs), run, f"id long, score double, passages {PASSAGES}")


def probability(model: Model | None):
    """Column function: probability that a text is toxic."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(0.0, index=texts.index)
        scores = _Scores(model.odds, model.drift)
        return pd.Series([_score(model, scores, t)[0] for t in texts], index=texts.index)

    return score
