"""Quality rules: fixed rules on words and repeats, then a hashed n-gram logistic regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics.llm.common import WORDS, bounded, read, segment_sums, texts_of
from rentalytics.llm.features import (
    char_ngrams, code_points, counted, labelled_sample, sample_texts, word_ngrams,
)

MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
# Rows of `labels` the model is fitted on at most, and of them the part kept back for calibration.
FIT_ROWS = 4_000
CALIBRATION_PART = 4  # one row in four
# A row is kept from this calibrated probability of good quality on.
THRESHOLD = 0.5
BITS = 16
CHAR_ORDERS = (1, 2, 3)
WORD_ORDERS = (1, 2)
STEPS = 120
_FIELDS = [f"char{n}" for n in CHAR_ORDERS] + [f"word{n}" for n in WORD_ORDERS]


@dataclass
class Model:
    """One weight per field and bucket, and the calibration of their sum."""

    weights: np.ndarray  # fields x buckets
    slope: float
    intercept: float

    def raw(self, texts: list[str]) -> np.ndarray:
        """Sum over the fields of the mean weight of a text's n-grams."""
        z = np.zeros(len(texts))
        for w, (buckets, begins) in zip(self.weights, fields(texts)):
            z += segment_sums(w[buckets], begins) / np.maximum(np.diff(begins), 1)
        return z

    def probability(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.intercept, -60, 60)))


def fields(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of every n-gram and where each text begins, field by field."""
    points, bounds = code_points(texts)
    for n in CHAR_ORDERS:
        yield char_ngrams(points, bounds, n, BITS)
    for n in WORD_ORDERS:
        yield word_ngrams(texts, n, BITS)


def fit(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Weights by full-batch gradient steps with per-weight rates (Adam); classes weigh alike."""
    parts = []
    for buckets, begins in fields(texts):
        index, counts, starts = counted(buckets, begins, BITS)
        parts.append((index, counts / np.repeat(np.maximum(np.diff(begins), 1), np.diff(starts)), starts))
    w = np.zeros((len(parts), 1 << BITS))
    bias, m, v = 0.0, np.zeros_like(w), np.zeros_like(w)
    per_class = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1))
    for t in range(1, STEPS + 1):
        z = np.full(len(texts), bias)
        for k, (index, value, starts) in enumerate(parts):
            z += segment_sums(w[k][index] * value, starts)
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) * per_class
        bias -= 2.0 * error.sum()
        g = 1e-6 * w
        for k, (index, value, starts) in enumerate(parts):
            g[k] += np.bincount(index, np.repeat(error, np.diff(starts)) * value, 1 << BITS)
        m = 0.9 * m + 0.1 * g
        v = 0.98 * v + 0.02 * g * g
        w -= 0.3 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.98 ** t)) + 1e-6)
    return w


def calibrate(raw: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept by Newton steps (Platt), with smoothed targets, shifted to the share of good rows.

    With rows of one class only the probability is that share for every text.
    """
    odds = np.log(min(max(share, 1e-3), 1 - 1e-3) / (1 - min(max(share, 1e-3), 1 - 1e-3)))
    good, bad = int((labels == 1).sum()), int((labels == 0).sum())
    if not good or not bad:
        return 0.0, 5.0 if share >= 0.5 else -5.0
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    per_row = np.where(labels == 1, 0.5 / good, 0.5 / bad)
    center, scale = raw.mean(), raw.std() or 1.0
    x = np.stack([(raw - center) / scale, np.ones_like(raw)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ ((p - target) * per_row) + 1e-4 * b
        h = (x * (p * (1 - p) * per_row)[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] / scale), float(b[1] - b[0] * center / scale + odds)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    words = WORDS.findall(text)
    symbols = sum(map(text.count, SYMBOLS))
    dup_lines = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if len(words) > WINDOW:
        runs = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(runs)) < len(runs):
            times = Counter(runs)
            covered = 0  # first word that no repeated window has covered yet
            for i, run in enumerate(runs):
                if times[run] > 1:
                    repeated += i + WINDOW - max(i, covered)
                    covered = i + WINDOW
    return len(words), sum(map(len, words)), symbols, dup_lines, repeated


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, *, rows: int = FIT_ROWS, seed: int = 3) -> Model:
    """The model of ``labels.quality`` on at most ``rows`` labelled documents, fitted in one task.

    Without labels of both classes all weights are 0 and every text gets the same verdict,
    that of the larger class (good where there is no label).
    """
    sample, share = labelled_sample(docs, labels, id_col, "quality", rows, seed)
    texts = sample_texts(docs, sample, id_col, [F.coalesce(text_col, F.lit("")).alias("text")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "text"], kind="stable")
        held = np.arange(len(pdf)) % CALIBRATION_PART == 0
        own, kept = pdf[~held], pdf[held]
        y = own["label"].to_numpy(float)
        w = fit(own["text"].tolist(), y) if 0 < y.sum() < len(y) else np.zeros((len(_FIELDS), 1 << BITS))
        model = Model(w, 1.0, 0.0)
        raw = np.concatenate([model.raw(kept["text"].tolist()[i:i + 200]) for i in range(0, len(kept), 200)])
        slope, intercept = calibrate(raw, kept["label"].to_numpy(float), share)
        return pd.DataFrame([{"weights": w.astype(np.float32).tobytes(), "slope": slope, "intercept": intercept}])

    row = texts.groupBy().applyInPandas(run, "weights binary, slope double, intercept double").first()
    if row is None:
        return Model(np.zeros((len(_FIELDS), 1 << BITS), np.float32), 0.0, 5.0)
    weights = np.frombuffer(bytes(row.weights), np.float32).reshape(len(_FIELDS), -1)
    return Model(weights, row.slope, row.intercept)


def judge(docs: DataFrame, text_col: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus the base counts, ``base_failed``, ``quality`` (calibrated probability) and ``kept``.

    Null texts count as empty; they and all texts of fewer than ten words fail the base
    rules and are not kept. Long texts are read whole, one at a time. Repeated rows get equal
    verdicts, empty tables stay empty, columns of the new names are replaced.
    """
    new = (*_BASE, "base_failed", "quality", "kept")
    kept = [c for c in docs.columns if c not in new]
    rest = [c for c in kept if c != text_col]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[docs[c].alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"),
                         docs[text_col].alias("text"))
    schema = T.StructType([*packed.schema.fields, *(T.StructField(c, T.LongType()) for c in _BASE),
                           T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()),
                           T.StructField("kept", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fields x 2**BITS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            texts = texts_of(batch, "text")
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, len(_BASE))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])
            quality = shared.value.probability(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c) for c in counts.T.copy()), pa.array(failed), pa.array(quality),
                 pa.array(~failed & (quality >= threshold))], names=schema.names)

    place = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)} | {text_col: F.col("text")}
    return packed.mapInArrow(run, schema).select(*[place[c].alias(c) for c in kept], *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op3_quality_rules``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"), "doc_id", "text")
    return judge(docs, "text", model).select("doc_id", *_BASE, "base_failed", "kept", "quality")
