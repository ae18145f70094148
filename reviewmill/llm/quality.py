"""Quality classifier: a linear support vector machine on Naive Bayes features.

Features are indicators of word-shape n-grams (a word's shape keeps its case,
digits and punctuation, and whether the word repeats the one before). Each is
scaled by the log ratio of its counts in the two classes; dual coordinate descent
fits a hinge-loss model to the scaled rows, and a logistic curve fitted to rows
kept aside turns margins into scores.

Only a bounded sample of labelled rows (``fit_rows``) is used to learn; every row is
scored, in place, from its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm.common import table

FEATURES = 1 << 18
FIT_ROWS = 20_000
THRESHOLD = 0.3
_LETTERS, _DIGITS, _RUN = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+"), re.compile(r"(.)\1+", re.DOTALL)
_KNOWN: dict[str, tuple[int, int]] = {}
_KEPT_WORDS = 200_000  # of a worker's cache


def word_shape(word: str) -> str:
    """Aa. style shape: A for capitals, X for a capitalised word, a for others, 9 for digits; runs count once."""
    shape = _LETTERS.sub(lambda m: "a" if not m[0][0].isupper() else "A" if len(m[0]) > 1 and m[0].isupper() else "X", word)
    return _RUN.sub(r"\1", _DIGITS.sub("9", shape))


def features(text: str | None) -> np.ndarray:
    """The distinct hashed 1- to 3-grams of the text's word shapes."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_KNOWN) > _KEPT_WORDS:
        _KNOWN.clear()
    coded = []
    for w in words:
        code = _KNOWN.get(w)
        if code is None:
            code = _KNOWN[w] = (zlib.crc32(word_shape(w).encode("utf-8", "replace")), zlib.crc32(w.encode("utf-8", "replace")))
        coded.append(code)
    codes = np.array(coded, dtype=np.uint64)
    shape = codes[:, 0] + np.uint64(1)
    shape[1:] += (codes[1:, 1] == codes[:-1, 1]).astype(np.uint64) << np.uint64(33)
    grams, value = [shape], shape
    for k in (1, 2):
        if len(words) > k:
            value = (value[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ shape[k:]
            grams.append(value + np.uint64(k))
    mixed = np.unique(np.concatenate(grams)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((mixed >> np.uint64(40)) % np.uint64(FEATURES)).astype(np.int64)


@dataclass
class QualityModel:
    """margin = sum(weight[f]) / sqrt(sum(square[f])) + bias; score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, f: np.ndarray) -> float:
        norm = np.sqrt(self.square[f].sum())
        return float(self.weight[f].sum() / norm + self.bias) if norm > 0 else self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.shift, -500, 500))))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-hinge support vector machine on (index, value) rows."""
    weights, bias = np.zeros(FEATURES), 0.0
    alpha, draw = np.zeros(len(rows)), np.random.default_rng(seed)
    length = np.array([float(v @ v) + 1 for _, v in rows])
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            at, value = rows[i]
            slack = signs[i] * (weights[at] @ value + bias) - 1
            new = min(max(alpha[i] - slack / length[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                weights[at] += step * value
                bias += step
                alpha[i] = new
    return weights, bias


def logistic_fit(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, towards Platt's smoothed targets."""
    n, m = good.sum(), (~good).sum()
    goal = np.where(good, (n + 1) / (n + 2), 1 / (m + 2))
    at = np.array([1.0, np.log((n + 1) / (m + 1))])
    x = np.c_[margins, np.ones(len(margins))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (goal - p))
        at = at + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(at[0], 0.0)), float(at[1])


def fit(found: list[np.ndarray], good: np.ndarray, cost: float = 1.0, epochs: int = 10, seed: int = 11) -> QualityModel:
    """A model from feature sets and their labels; with one class only, its share (smoothed) is every score."""
    if not good.any() or good.all():
        share = (good.sum() + 1) / (len(good) + 2)
        return QualityModel(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    aside = np.zeros(len(good), dtype=bool)
    aside[np.random.default_rng(seed).permutation(len(good))[: len(good) // 5]] = True
    if len({*good[aside]}) < 2 or len({*good[~aside]}) < 2:
        aside[:] = False
    counts = {kind: np.ones(FEATURES) for kind in (True, False)}
    for f, kind, out in zip(found, good, aside, strict=True):
        if not out:
            counts[bool(kind)][f] += 1
    ratio = np.log(counts[True] / counts[True].sum()) - np.log(counts[False] / counts[False].sum())
    rows = [(f, ratio[f] / max(np.sqrt((ratio[f] ** 2).sum()), 1e-12)) for f in found]
    learnt = [r for r, out in zip(rows, aside, strict=True) if not out]
    weights, bias = dual_coordinate_descent(learnt, np.where(good[~aside], 1.0, -1.0), cost, epochs, seed)
    model = QualityModel(weights * ratio, ratio**2, bias, 1.0, 0.0)
    tried = aside if aside.any() else ~aside
    margins = np.array([model.margin(f) for f, use in zip(found, tried, strict=True) if use])
    model.slope, model.shift = logistic_fit(margins, good[tried])
    return model


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit to at most ``fit_rows`` labelled rows outside the held-out fifth, taken in the order of a hash of the id.

    Labels other than 0 and 1, null ids and ids without a document are left out. An
    id with several labels gives as many rows.
    """
    key = F.col(f"`{id_col}`")
    usable = labels.filter(~held_out(key) & key.isNotNull() & F.col(f"`{label_col}`").isin(0, 1))
    sample = usable.select(key.alias("at"), F.col(f"`{label_col}`").cast("int").alias("good")).orderBy(F.xxhash64("at"), "at", "good").limit(fit_rows)
    texts = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # At most fit_rows rows of two numbers, whatever the input.
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("at")).select("doc_id", "text", "good")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(str), "good": b["good"], "found": [features(t) for t in b["text"]]})

    made = rows.mapInPandas(run, "doc_id string, good int, found array<int>").toPandas()
    order = sorted(range(len(made)), key=lambda i: (made["doc_id"][i], made["good"][i], len(made["found"][i])))
    return fit([np.asarray(made["found"][i], dtype=np.int64) for i in order], np.array([made["good"][i] == 1 for i in order], dtype=bool))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def score_column(spark: SparkSession, model: QualityModel, text: Column) -> Column:
    """Score in 0 to 1 of every text; null and empty texts get the score of a text without features."""
    shared = spark.sparkContext.broadcast(model)  # two arrays of FEATURES numbers

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = shared.value
        for texts in batches:
            yield pd.Series([ready.score(t) for t in texts], dtype="float64")

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold).

    Null ids and repeated rows are scored like any other. Without usable labels every
    score is 0.5. An empty table gives an empty table.
    """
    model = learn(docs, labels, id_col=id_col, text_col=text_col, **fitting)
    scored = docs.select(F.col(f"`{id_col}`").alias("doc_id"), score_column(docs.sparkSession, model, F.col(f"`{text_col}`")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
