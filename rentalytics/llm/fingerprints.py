"""Document fingerprints by locally consistent parsing.

A text is cut into phrases at places that only the characters around them decide: labels
from deterministic coin tossing (position and value of the lowest bit in which a symbol
differs from its left neighbour, three times over), and a phrase at each local maximum of
the labels. A phrase's name is a hash of what it holds; the names are the symbols of the
next level. Equal stretches of two texts get equal names except near their ends, wherever
they stand. A fingerprint keeps the smallest hashes of the names of three levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics.llm.common import BATCH_BYTES, bounded, mix64, read
from rentalytics.llm.features import code_points

LEVELS = (2, 3, 4)  # phrases of some 9, 27 and 80 characters
KEPT = 32  # hashes a fingerprint keeps per level
_ROUNDS = 3
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(255, np.uint64(0xD6E8FEB86659FD93))]))


def _coin(left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which ``own`` differs from ``left``, plus that bit; 0 if they are equal."""
    d = left ^ own
    power = (d & (~d + np.uint64(1))).astype(np.float64)  # exact: a power of two, its place is the exponent
    low = ((power.view(np.int64) >> 52) - 1023).clip(0).astype(np.uint64)
    label = (low << np.uint64(1)) | ((own >> low) & np.uint64(1))
    label[d == 0] = 0
    return label.astype(np.uint8)


# Labels of the later rounds, which start from numbers below 128: by left neighbour and own number.
_NEXT_COIN = _coin(np.repeat(np.arange(128, dtype=np.uint64), 128), np.tile(np.arange(128, dtype=np.uint64), 128))


def _coin_labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8 that differ from one symbol to the next, from symbols that do.

    A symbol without a left neighbour counts as one that differs in the lowest bit.
    """
    at = np.flatnonzero(first)
    left = np.concatenate([x[:1], x[:-1]])
    left[at] = x[at] ^ np.uint64(1)
    x = _coin(left, x)
    for _ in range(_ROUNDS - 1):
        left = np.concatenate([x[:1], x[:-1]])
        left[at] = x[at] ^ np.uint8(1)
        x = _NEXT_COIN[(left.astype(np.int64) << 7) | x]
    return x


def next_level(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of the next level, and where each text's phrases begin.

    Equal neighbours are one symbol first, named by the symbol and its number of repeats.
    """
    if not x.size:
        return x, bounds
    begins = np.zeros(x.size, bool)
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    new = begins.copy()
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate([at, [x.size]])).astype(np.uint64)
    y = np.where(times == 1, x[at], mix64(x[at] + times * np.uint64(0x9E3779B97F4A7C15)))
    first = begins[at]
    label = _coin_labels(y, first)
    same = np.concatenate([[False], y[1:] == y[:-1]]) & ~first  # two names that hash alike
    rise = np.concatenate([[True], label[1:] > label[:-1]]) | same
    fall = np.concatenate([label[:-1] > label[1:], [True]]) | np.concatenate([first[1:], [True]])
    starts = np.flatnonzero(first | (rise & fall))
    place = np.arange(y.size) - np.repeat(starts, np.diff(np.concatenate([starts, [y.size]])))
    terms = mix64(y) * _POWERS[place & 255] + (place >> 8).astype(np.uint64)
    names = mix64(np.add.reduceat(terms, starts))
    # Where each text begins, first in symbols y, then in phrases.
    in_y = np.concatenate([[0], np.cumsum(new)])[bounds]
    return names, np.searchsorted(starts, in_y).astype(np.int64)


def fingerprints(texts: list[str], levels: tuple[int, ...] = LEVELS, kept: int = KEPT) -> list[str]:
    """One fingerprint per text: per level the smallest hashes in hexadecimal. Empty for an empty text."""
    points, bounds = code_points(texts)
    x = mix64(points.astype(np.uint64) + np.uint64(1))
    sections: list[list[str]] = [[] for _ in texts]
    for level in range(1, max(levels) + 1):
        x, bounds = next_level(x, bounds)
        if level not in levels:
            continue
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        h = (mix64(x + np.uint64(level)) >> np.uint64(32)).astype(np.int64)
        keys = np.sort((text << 32) | h)
        keys = keys[np.diff(keys, prepend=-1) != 0]
        starts = np.searchsorted(keys >> 32, np.arange(len(texts) + 1))
        low = (keys & 0xFFFFFFFF).astype(">u4")
        for i in range(len(texts)):
            sections[i].append(low[starts[i]:min(starts[i + 1], starts[i] + kept)].tobytes().hex())
    return ["" if not t else ".".join(s) for t, s in zip(texts, sections)]


def likeness(a: str, b: str, kept: int = KEPT) -> float:
    """Estimated share of common phrases, from two fingerprints: 0 to 1. Two empty ones are alike.

    Levels of long phrases weigh more, as far as the texts have phrases there.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    total = weights = 0.0
    for k, (p, q) in enumerate(zip(a.split("."), b.split("."))):
        x = {p[i:i + 8] for i in range(0, len(p), 8)}
        y = {q[i:i + 8] for i in range(0, len(q), 8)}
        lowest = set(islice(sorted(x | y), kept)) if len(x) == kept or len(y) == kept else x | y
        w = 1.0 if k == 0 else 6.0 * min(1.0, min(len(x), len(y)) / 8)
        total += w * len(lowest & x & y) / max(len(lowest), 1)
        weights += w
    return total / weights


def fingerprint(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` plus ``fingerprint``. Null texts count as empty, and empty texts have an empty one.

    Long texts are read whole. Equal texts have equal fingerprints; an empty table stays
    empty; a column of the new name is replaced.
    """
    kept = [c for c in rows.columns if c != "fingerprint"]
    packed = rows.select(F.struct(*[rows[c].alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), rows[text].alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            found = fingerprints([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], names=schema.names)

    return packed.mapInArrow(run, schema).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "fingerprint")


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first characters of the following text."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _bucket(id_col: Column, bounds: list[int]) -> Column:
    """Number of bounds above the id, by bisection: descending ids have ascending buckets; null ids the last."""
    n = len(bounds)
    if not n:
        return F.when(id_col.isNull(), F.lit(1)).otherwise(F.lit(0))
    limits = F.array(*[F.lit(b) for b in sorted(bounds, reverse=True)])

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.element_at(limits, F.least(mid + F.lit(1), F.lit(n))) > id_col
        return F.when(s["lo"] >= s["hi"], s).when(above, F.struct((mid + F.lit(1)).alias("lo"), s["hi"].alias("hi"))) \
            .otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, halve, lambda s: s["lo"])
    return F.when(id_col.isNull(), F.lit(n + 1)).otherwise(found)


def with_next(
    docs: DataFrame, id_col: str, text: str, rows_per_bucket: int = 4_000, most_buckets: int = 10_000,
) -> DataFrame:
    """``id``, ``text``, ``bucket``, ``ahead``: rows in descending order of a whole-number id, in buckets of neighbours.

    The first rows of a bucket are also at the end of the one before (``ahead`` = 1), the
    first of all at the end of the last, so that each row's next one is in its own
    partition: texts are moved once. Rows with equal ids follow the hash of their text.

    The driver knows one bound per bucket. From ``most_buckets`` on buckets get larger
    instead of more; a task reads its bucket as a stream, sorted on disk if need be.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    buckets = min(most_buckets, max(1, -(-ids.count() // rows_per_bucket)))
    shares = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(ids.agg(F.percentile_approx("id", shares, 20 * buckets)).first()[0] or [])) if shares else []
    bucket = _bucket(F.col("id"), bounds)
    # One row per bucket: as many as the bounds just drawn.
    heads = {r.bucket: r.head for r in ids.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("head")).collect()}
    full = sorted(heads)
    size = (full[-1] + 1) if full else 1
    before = {b: full[k - 1] for k, b in enumerate(full)}
    head = F.array(*[F.lit(heads.get(b)).cast("long") for b in range(size)])
    prior = F.array(*[F.lit(before.get(b, 0)) for b in range(size)])
    at = F.col("bucket") + F.lit(1)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead"))
    sent = F.struct(F.element_at(prior, at).alias("bucket"), F.lit(1).alias("ahead"))
    places = F.when(F.col("id").eqNullSafe(F.element_at(head, at)), F.array(own, sent)).otherwise(F.array(own))
    placed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")) \
        .withColumn("bucket", bucket).withColumn("place", F.explode(places)) \
        .select("id", "text", F.col("place.bucket").alias("bucket"), F.col("place.ahead").alias("ahead"))
    return placed.repartitionById(size, F.col("bucket")).sortWithinPartitions(
        "bucket", "ahead", F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")


_EDITED = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def compare_with_next(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and the likeness to that and to the next row's.

    The next row is the one with the next smaller id; the smallest id's next is the largest. A
    single row is its own next. Null ids come last. Empty tables give no row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        held_bytes, own, known = 0, None, None  # known: fingerprint of held[0], if there is one already

        def flush(following: str | None, keep_last: bool) -> pa.RecordBatch | None:
            nonlocal held, held_bytes, known
            done = held[:-1] if keep_last else held
            if not done:
                return None
            texts = [t for _, t in held] + ([] if keep_last else [following])
            changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
            found = fingerprints((texts if known is None else texts[1:]) + changed)
            plain = ([] if known is None else [known]) + found[:len(found) - len(changed)]
            other = found[len(found) - len(changed):]
            n = len(done)
            out = pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in done], pa.int64()), pa.array([len(t) for _, t in done], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array(plain[:n]), pa.array(other), pa.array([likeness(a, b) for a, b in zip(plain, other)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(plain[:n], plain[1:])], pa.float64()),
            ], names=[c.split()[0] for c in _EDITED.split(", ")])
            known = plain[n] if keep_last else None
            held = held[-1:] if keep_last else []
            held_bytes = sum(len(t) for _, t in held)
            return out

        for batch in batches:
            for i, t, b, ahead in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "bucket", "ahead"))):
                if b != own:
                    own = b
                    held, held_bytes, known = [], 0, None
                if ahead:
                    if held and (out := flush(t, False)) is not None:
                        yield out
                    continue
                held.append((i, t))
                held_bytes += len(t)
                if held_bytes > BATCH_BYTES // 2 and (out := flush(None, True)) is not None:
                    yield out

    return with_next(docs, id_col, text).mapInArrow(run, _EDITED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op7_fingerprints``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_with_next(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")
