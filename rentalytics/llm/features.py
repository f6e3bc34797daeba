"""Hashed features of texts, as flat arrays over a batch, and the labelled sample models are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentalytics.llm.common import mix64, windows, word_hashes


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and where each text begins."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def char_ngrams(points: np.ndarray, bounds: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of ``n`` code points inside a text. Shorter texts have none."""
    h = np.zeros(max(points.size - n + 1, 0), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + points[k:k + h.size]
    h = mix64(h + np.uint64(n)) >> np.uint64(64 - bits)
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begins[-1]) + np.repeat(bounds[:-1] - begins[:-1], counts)
    return h[at].astype(np.int64), begins


def word_ngrams(texts: list[str], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of ``n`` words; a shorter text has one run of all its words."""
    hashes, bounds = word_hashes(texts)
    found, begins = windows(hashes, bounds, n)
    return (found >> np.uint64(64 - bits)).astype(np.int64), begins


def counted(buckets: np.ndarray, begins: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text in order, how often each occurs there, and where each text begins."""
    text = np.repeat(np.arange(begins.size - 1, dtype=np.int64), np.diff(begins))
    keys, counts = np.unique((text << bits) | buckets, return_counts=True)
    starts = np.searchsorted(keys >> bits, np.arange(begins.size))
    return keys & ((1 << bits) - 1), counts.astype(np.float64), starts


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, rows: int, seed: int) -> tuple[DataFrame, float]:
    """At most ``rows`` labelled rows (``id``, ``label``), half of each class at most, and the share of class 1.

    ``labels`` has one row per id and class; an id with several labels gets their mean, rounded
    up from a half. The sample is the rows with the smallest hash of the id in each class: the
    same on any partitioning. The share counts all labelled rows that ``docs`` has.
    """
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    known = docs.select(F.col(id_col).alias("id")).distinct().join(marked, "id")
    share = known.agg(F.avg("label")).first()[0]
    half = max(rows // 2, 1)
    draw = F.xxhash64(F.lit(seed), "id")
    parts = [known.filter(F.col("label") == k).orderBy(draw, "id").limit(half) for k in (0, 1)]
    return parts[0].unionByName(parts[1]), 1.0 if share is None else float(share)


def sample_texts(docs: DataFrame, sample: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """The sample's rows with columns of ``docs``. The sample is bounded by its parameter, so it is broadcast."""
    return docs.select(F.col(id_col).alias("id"), *columns).join(F.broadcast(sample), "id")
