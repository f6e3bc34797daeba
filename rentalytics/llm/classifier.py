"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics.llm.common import bounded, mix64, read, segment_sums, texts_of, word_hashes
from rentalytics.llm.features import code_points, counted, labelled_sample, sample_texts

BITS = 15
FACTORS = 8
FIT_ROWS = 4_000
EPOCHS = 24
MIN_STEPS = 200  # more epochs for few rows
BATCH = 250
THRESHOLD = 0.3
HOLD_OUT = 5  # ids whose crc32 is a multiple of this are never learned from

STATISTICS = (
    "words", "chars_per_word", "upper", "digit", "symbol", "mark", "non_ascii", "lines_per_word", "repeat_next",
    "distinct", "short_words", "declared_chars",
)
_SYMBOLS = np.zeros(128, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>@^~_=+{}[]\\/"]] = True
_MARKS = np.zeros(128, bool)
_MARKS[[ord(c) for c in ".,;:!?\"'()-"]] = True


def statistics(texts: list[str], hashes: np.ndarray, begins: np.ndarray, declared: np.ndarray) -> np.ndarray:
    """Structure of each text, and its declared number of characters: one row per text. An empty text has zeros."""
    points, bounds = code_points(texts)
    chars = np.maximum(np.diff(bounds), 1)
    low = np.minimum(points, 127)
    plain = points < 127

    def part(mask: np.ndarray) -> np.ndarray:
        return segment_sums(mask.astype(float), bounds) / chars

    n = np.diff(begins)
    words = np.maximum(n, 1)
    same = np.concatenate([hashes[1:] == hashes[:-1], [False]]) if hashes.size else np.zeros(0, bool)
    same[begins[1:][n > 0] - 1] = False  # a text's last word has no next one
    _, _, starts = counted((hashes >> np.uint64(44)).astype(np.int64), begins, 20)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    inside = segment_sums(~blank, bounds)
    return np.stack([
        np.log1p(n) / 4, inside / words / 5, part((points >= 65) & (points <= 90)), part((points >= 48) & (points <= 57)),
        part(plain & _SYMBOLS[low]) * 4, part(plain & _MARKS[low]) * 4, part(points > 127),
        np.minimum(segment_sums(points == 10, bounds) / words, 1) * 4, segment_sums(same, begins) / words,
        np.diff(starts) / words, np.exp(-inside / words), np.log1p(np.maximum(declared, 0)) / 8,
    ], 1)


@dataclass
class Model:
    """z = bias + sum w x + 1/2 sum over factors of ((sum v x)^2 - sum v^2 x^2)."""

    bias: float
    w: np.ndarray  # buckets of words, then the statistics
    v: np.ndarray  # the same rows, FACTORS columns
    center: np.ndarray
    scale: np.ndarray
    offset: float = 0.0

    def score(self, texts: list[str], declared: np.ndarray) -> np.ndarray:
        index, value, starts, stats = features(texts, declared)
        z = self.bias + self.offset + _sums(self, index, value, starts, self.standard(stats))[0]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.center) / self.scale, -4, 4) / np.sqrt(stats.shape[1])


def features(texts: list[str], declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets with root shares as values (their squares add up to 1), where each text begins, statistics."""
    hashes, begins = word_hashes(texts)
    index, counts, starts = counted((mix64(hashes) >> np.uint64(64 - BITS)).astype(np.int64), begins, BITS)
    value = np.sqrt(counts / np.repeat(np.maximum(np.diff(begins), 1), np.diff(starts)))
    return index, value, starts, statistics(texts, hashes, begins, declared)


def _sums(m: Model, index: np.ndarray, value: np.ndarray, starts: np.ndarray, dense: np.ndarray):
    """Score without bias, and the sums of v x per factor that its gradient needs."""
    wide = 1 << BITS
    vx = m.v[index] * value[:, None]
    s = segment_sums(vx, starts) + dense @ m.v[wide:]
    q = segment_sums(vx * vx, starts) + (dense * dense) @ (m.v[wide:] ** 2)
    z = segment_sums(m.w[index] * value, starts) + dense @ m.w[wide:] + 0.5 * (s * s - q).sum(1)
    return z, s


def fit(texts: list[str], declared: np.ndarray, labels: np.ndarray, seed: int = 4) -> Model:
    """Small batches in a drawn order, rates per weight (Adam); classes weigh alike."""
    rng = np.random.default_rng(seed)
    wide, width = 1 << BITS, (1 << BITS) + len(STATISTICS)
    parts = [features(texts[i:i + BATCH], declared[i:i + BATCH]) for i in range(0, len(texts), BATCH)]
    stats = np.concatenate([p[3] for p in parts])
    m = Model(0.0, np.zeros(width), rng.normal(0, 0.05, (width, FACTORS)), stats.mean(0), np.maximum(stats.std(0), 1e-3))
    # The words of all texts as one array; a batch picks its texts' stretches.
    index = np.concatenate([p[0] for p in parts])
    value = np.concatenate([p[1] for p in parts])
    sizes = np.concatenate([np.diff(p[2]) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    dense = m.standard(stats)
    per_class = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9))
    theta = np.concatenate([m.w[:, None], m.v], 1)
    mean, var, t = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            rows = order[k:k + BATCH]
            n = sizes[rows]
            own = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(own[-1]) + np.repeat(starts[rows] - own[:-1], n)
            i, d = index[at], dense[rows]
            # Half of the texts show their statistics only, so that learning words by heart is not enough.
            x = value[at] * np.repeat(rng.random(len(rows)) < 0.5, n)
            m.w, m.v = theta[:, 0], theta[:, 1:]
            z, s = _sums(m, i, x, own, d)
            e = (1 / (1 + np.exp(-np.clip(z + m.bias, -60, 60))) - labels[rows]) * per_class[rows] / len(rows)
            m.bias -= 0.5 * e.sum()
            ex = np.repeat(e, n) * x
            g = 1e-4 * theta
            g[:wide, 0] += np.bincount(i, ex, wide)
            g[wide:, 0] += d.T @ e
            long_s = np.repeat(s, n, 0)
            for f in range(FACTORS):
                g[:wide, f + 1] += np.bincount(i, ex * (long_s[:, f] - m.v[i, f] * x), wide)
            g[wide:, 1:] += d.T @ (e[:, None] * s) - m.v[wide:] * ((d * d).T @ e)[:, None]
            t += 1
            mean = 0.9 * mean + 0.1 * g
            var = 0.98 * var + 0.02 * g * g
            theta = theta - 0.03 * (mean / (1 - 0.9 ** t)) / (np.sqrt(var / (1 - 0.98 ** t)) + 1e-6)
    m.w, m.v = theta[:, 0].copy(), theta[:, 1:].copy()
    return m


def held_out(id_col: Column) -> Column:
    """True for rows that no model may learn from. A null id counts as held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(True))


_ROW = "bias double, w binary, v binary, center array<double>, scale array<double>"


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, declared: str | None, *,
          rows: int = FIT_ROWS, seed: int = 4) -> Model:
    """The model of ``labels.quality`` on at most ``rows`` labelled rows that are not held out, fitted in one task.

    Inputs are the text and the declared length, nothing else. Classes weigh alike in the fit;
    the score is shifted back to their share among all rows it could learn from. Without rows
    of both classes every text scores that share (1 where nothing is labelled).
    """
    sample, share = labelled_sample(docs, labels.filter(~held_out(F.col(id_col))), id_col, "quality", rows, seed)
    length = F.coalesce(F.col(declared), F.length(text_col), F.lit(0)) if declared else F.coalesce(F.length(text_col), F.lit(0))
    texts = sample_texts(docs, sample, id_col, [
        F.coalesce(text_col, F.lit("")).alias("text"), length.cast("long").alias("declared")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "text"], kind="stable")
        y = pdf["label"].to_numpy(float)
        if not 0 < y.sum() < len(y):
            return pd.DataFrame({c.split()[0]: [] for c in _ROW.split(", ")})
        m = fit(pdf["text"].tolist(), pdf["declared"].to_numpy(float), y)
        return pd.DataFrame([{"bias": m.bias, "w": m.w.astype(np.float32).tobytes(), "v": m.v.astype(np.float32).tobytes(),
                              "center": m.center, "scale": m.scale}])

    row = texts.groupBy().applyInPandas(run, _ROW).first()
    width = (1 << BITS) + len(STATISTICS)
    odds = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))))
    if row is None:
        zero = np.zeros(len(STATISTICS))
        return Model(0.0, np.zeros(width, np.float32), np.zeros((width, FACTORS), np.float32), zero, zero + 1, odds)
    return Model(row.bias, np.frombuffer(bytes(row.w), np.float32), np.frombuffer(bytes(row.v), np.float32).reshape(width, -1),
                 np.array(row.center), np.array(row.scale), odds)


def score(docs: DataFrame, text_col: str, declared: str | None, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1, higher: better) and ``predicted`` (1 from ``threshold`` on).

    A null text counts as empty, a null declared length as the text's own; an empty text is
    scored by its statistics. Long texts are scored whole. Equal rows score alike; an empty
    table stays empty; columns of the two new names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rest = [c for c in kept if c != text_col]
    length = F.coalesce(docs[declared], F.length(docs[text_col]), F.lit(0)) if declared else \
        F.coalesce(F.length(docs[text_col]), F.lit(0))
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[docs[c].alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"),
                         docs[text_col].alias("text"), length.cast("long").alias("declared"))
    schema = T.StructType([*packed.schema.fields[:2], T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            p = shared.value.score(texts_of(batch, "text"), batch.column("declared").to_numpy(zero_copy_only=False).astype(float))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=schema.names)

    place = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)} | {text_col: F.col("text")}
    return packed.mapInArrow(run, schema).select(*[place[c].alias(c) for c in kept], "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op4_classifier``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = train(docs, read(spark, sf_dir, "labels"), "doc_id", "text", "n_chars")
    return score(docs, "text", "n_chars", model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
