"""Helpers of the training-data operators: reading, word rules, bounded batches, hashed text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words are runs of anything but blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
# Text a Python worker turns into number arrays at once; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, *range(0x09, 0x0E)]] = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; none in a null text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def bounded(batches: Iterable[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text, never less than one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held + size > limit and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; a null one is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def contiguous(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of neighbouring rows with equal keys, over batch limits. Rows are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits (the finalizer of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, and where each text's words begin (one more entry at the end).

    A word's hash is a polynomial over its bytes, taken from prefix sums modulo 2**64 and
    shifted back to the word's start, so equal words hash alike wherever they stand.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    if not data.size:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    blank = _BLANKS[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _powers(_MULTIPLIER, data.size), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * _powers(_INVERSE, data.size)[starts])
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return hashes, np.searchsorted(starts, begins).astype(np.int64)


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words, and where each text's windows begin.

    A text with words, but fewer than ``n``, has one window: all its words.
    """
    counts = np.diff(bounds)
    out_counts = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(out_counts)])
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    first = np.arange(begins[-1]) - np.repeat(begins[:-1] - bounds[:-1], out_counts)
    left = np.repeat(counts, out_counts)
    total = np.zeros(begins[-1], np.uint64)
    for k in range(n):
        term = padded[first + k]
        if k:
            term = np.where(left > k, term, np.uint64(0))
        total = mix64(total * np.uint64(_MULTIPLIER) + term + np.uint64(k + 1))
    return total, begins


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each stretch of ``values``; an empty stretch sums to zero."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` plus ``name``: 0, 1, ... in the given order, numbered in parallel.

    The sorted rows are written with their place in the partition; only one count per
    partition meets in one task.
    """
    from rentalytics.runtime import stage

    sorted_rows = rows.orderBy(*order).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    return dense(stage(sorted_rows, "numbered"), "at", name).select("row.*", name)


def dense(rows: DataFrame, at: str, name: str) -> DataFrame:
    """``rows`` plus ``name``: the rank of ``at``, a stored ``monotonically_increasing_id``, without gaps."""
    part, place = F.shiftright(F.col(at), 33), F.col(at).bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy(part.alias("_part")).count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    # One row per partition of the stored table: as many rows as it had tasks.
    return rows.withColumn("_part", part).join(F.broadcast(firsts), "_part").withColumn(
        name, F.col("_first") + place).drop("_part", "_first")
