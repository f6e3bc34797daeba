"""N-gram Jaccard join: MinHash banding, candidates shuffled by band hash, pairs verified on full n-gram sets.

Rows with equal n-gram sets are one class, found by grouping, and only classes are joined.
Classes that agree in a whole band of MinHash values meet in a bucket. A bucket's pairs are
verified where its texts are: every pair at the first band it agrees in, so that each is
counted once. Buckets are cut into blocks of bounded size that meet two by two, and a task
returns a link count and one edge per class, never pairs. Edges become groups by
alternating star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics.llm.common import bounded, contiguous, mix64, read, windows, word_hashes
from rentalytics.runtime import stage

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
MAX_HASHES = 128
# n-grams of one block: what one side of a verification holds in memory. Every text counts as some
# n-grams more, so that a block of short texts has no more than 5,000 of them to compare.
BLOCK_NGRAMS, TEXT_NGRAMS = 1_000_000, 200


def band_plan(similarity: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows per band: the most rows for which a pair at ``similarity`` meets with probability ``recall``."""
    best = (1, 1)
    for rows in range(1, max_hashes + 1):
        p = similarity ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _factors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) + mix64(np.array([seed], np.uint64)))
    return h[:n] | np.uint64(1), h[n:]


def band_hashes(grams: np.ndarray, begins: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """One hash per text and band over the smallest values of ``rows`` hash functions. Texts have n-grams."""
    out = np.empty((len(begins) - 1, bands), np.uint64)
    a, b = _factors(bands * rows, seed)
    for band in range(bands):
        h = np.full(len(begins) - 1, np.uint64(band + 1))
        for k in range(band * rows, (band + 1) * rows):
            low = np.minimum.reduceat(grams * a[k] + b[k], begins[:-1])
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, band] = h
    return out


def ngram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, and where each text begins."""
    grams, begins = windows(*word_hashes(texts), n)
    sets = [np.unique(grams[a:b]) for a, b in zip(begins, begins[1:])]
    return (np.concatenate(sets) if sets else grams), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _signatures(rows: DataFrame, n: int, bands: int, per_band: int, seed: int) -> DataFrame:
    """Per row: its key, the key of its n-gram set (two numbers), the set's size and its band hashes."""
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in ("sa", "sb", "grams")),
                           T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            grams, begins = ngram_sets([t or "" for t in batch.column("text").to_pylist()], n)
            sizes = np.diff(begins)
            full = np.flatnonzero(sizes > 0)
            keys = np.zeros((len(sizes), 2), np.int64)
            found = np.zeros((0, bands), np.int64)
            if len(full):
                starts = begins[full]
                for k in (0, 1):
                    total = np.add.reduceat(mix64(grams + np.uint64(k + 1)), starts)
                    keys[full, k] = mix64(total + sizes[full].astype(np.uint64)).view(np.int64)
                found = band_hashes(grams, np.append(starts, begins[-1]), bands, per_band, seed).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum((sizes > 0) * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(sizes),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _verified(group: pa.Table, n: int, similarity: float) -> list[tuple[int, int, int]]:
    """(class, smallest class it is linked to here, links) of one pair of blocks of a bucket."""
    classes = group.column("c").to_numpy()
    order = np.argsort(classes, kind="stable")
    group = group.take(pa.array(order))
    classes, copies = classes[order], group.column("n").to_numpy()
    block, band = group.column("block").to_numpy(), group.column("band")[0].as_py()
    cross = group.column("p")[0].as_py() != group.column("q")[0].as_py()
    bands = np.array(group.column("bands").to_pylist(), np.int64)
    grams, begins = ngram_sets(group.column("text").to_pylist(), n)
    sizes = np.diff(begins)
    _, grams = np.unique(grams, return_inverse=True)
    marks = np.zeros(int(grams.max()) + 1, bool)
    root = np.arange(len(classes))
    links = np.zeros(len(classes), np.int64)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for i in range(len(classes) - 1):
        rest = slice(i + 1, None)
        new = ~(bands[rest, :band] == bands[i, :band]).any(1)  # no earlier band has seen the pair
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        new &= small >= similarity * large - 1e-9
        if cross:
            new &= block[rest] != block[i]
        near = np.flatnonzero(new) + i + 1
        if not len(near):
            continue
        own = grams[begins[i]:begins[i + 1]]
        marks[own] = True
        if 4 * len(near) < len(classes) - i:
            common = np.array([np.count_nonzero(marks[grams[begins[j]:begins[j + 1]]]) for j in near])
        else:
            common = np.add.reduceat(marks[grams[begins[i + 1]:]].astype(np.int64), begins[i + 1:-1] - begins[i + 1])[near - i - 1]
        marks[own] = False
        for j in near[common >= similarity * (sizes[near] + sizes[i] - common) - 1e-9].tolist():
            links[i] += copies[j]
            links[j] += copies[i]
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [(int(classes[i]), int(classes[top(i)]), int(links[i])) for i in np.flatnonzero(links)]


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node of its group) for undirected ``edges`` (``u``, ``v``).

    Large and small stars in turn, each round written to the shared folder, until no edge changes.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _keys(rows: DataFrame, id_col: str, text: str) -> list:
    """Two hashes of id and text: the name of a row. Rows that agree in both are repeats."""
    return [F.xxhash64(rows[id_col], rows[text]).alias("k1"), F.xxhash64(rows[text], rows[id_col], F.lit(1)).alias("k2")]


def _joined(rows: DataFrame, id_col: str, text: str, n: int, similarity: float, recall: float, seed: int,
            block_ngrams: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and per class its group's head row and its number of links."""
    bands, per_band = band_plan(similarity, recall)
    source = rows.select(rows[id_col].alias("id"), *_keys(rows, id_col, text), rows[text].alias("text"))
    signed = stage(_signatures(source, n, bands, per_band, seed), "signatures")
    head = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")
    classes = signed.groupBy("sa", "sb").agg(
        F.count("*").alias("n"), F.min(head).alias("head"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    classes = stage(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    spots = classes.select("c", "grams", F.posexplode("bands").alias("band", "h"))
    buckets = spots.groupBy("band", "h").agg(
        F.count("*").alias("m"), F.sum(F.col("grams") + TEXT_NGRAMS).alias("weight"), F.bit_xor(F.xxhash64("c")).alias("x1"),
        F.bit_xor(F.xxhash64("c", F.lit(1))).alias("x2")).filter("m > 1")
    # Buckets of several bands with the same classes are one; the first band's stays.
    buckets = buckets.groupBy("m", "x1", "x2").agg(F.min(F.struct("band", "h", "weight")).alias("b")).select("b.*")
    buckets = stage(buckets.withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    blocks = F.ceil(F.col("weight") / block_ngrams).cast("long")
    members = spots.join(buckets, ["band", "h"]).select(
        "bucket", "band", "c", blocks.alias("blocks"), F.pmod(F.xxhash64("c"), blocks).alias("block"))
    members = stage(members, "members")
    meets = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "bucket", "band", "c", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    wanted = classes.join(members.select("c").distinct(), "c").select("c", "n", "bands", "head.k1", "head.k2")
    texts = source.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).groupBy("k1", "k2").agg(
        *[F.first(x).alias(x) for x in ("c", "n", "bands", "text")]).drop("k1", "k2")
    ready = meets.join(texts, "c").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in contiguous(batches, ["bucket", "p", "q"]):
            found = _verified(group, n, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)],
                                             names=["c", "root", "links"])

    linked = stage(ready.mapInArrow(run, "c long, root long, links long"), "links")
    labels = components(linked.select(F.col("c").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("c").agg(F.sum("links").alias("links"))
    told = classes.select("c", "sa", "sb", "n", "head").join(links, "c", "left").join(
        labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    told = stage(told.select("label", "sa", "sb", "n", "head", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "told")
    heads = told.groupBy("label").agg(F.min("head").alias("first"))
    return signed, told.join(heads, "label")


def similar(
    rows: DataFrame, id_col: str, text: str, *, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL,
    seed: int = 8, block_ngrams: int = BLOCK_NGRAMS,
) -> DataFrame:
    """One row per row: ``id``, ``class_id``, ``n_links``, ``n_copies``.

    Rows are linked when their n-gram sets overlap by ``similarity`` or more; ``n_links`` counts a
    row's links, ``n_copies`` the rows with its very set, itself included. ``class_id`` is the
    smallest id of all rows that links connect.

    A text shorter than ``n`` words has one n-gram, all its words. Texts without a word (null,
    empty, blank) have equal, empty sets and are one class. Repeated rows are copies of each
    other. Null ids count as rows and are never a class id unless no row of the class has
    another. No row gives no row. Columns besides id and text do not matter.
    """
    signed, told = _joined(rows, id_col, text, n, similarity, recall, seed, block_ngrams)
    out = signed.select("id", "sa", "sb").join(told, ["sa", "sb"])
    return out.select("id", F.col("first.id").alias("class_id"), F.col("n_links").cast("long"), F.col("n").alias("n_copies"))


def keep_one(rows: DataFrame, id_col: str, text: str, **options) -> DataFrame:
    """``rows`` with one row of each class: that with the smallest id; among its repeats, any one."""
    settings = {"n": WORDS, "similarity": SIMILARITY, "recall": RECALL, "seed": 8, "block_ngrams": BLOCK_NGRAMS} | options
    _, told = _joined(rows, id_col, text, **settings)
    stay = stage(told.select("first.k1", "first.k2").distinct(), "stay")
    whole = rows.select(F.struct("*").alias("row"), *_keys(rows, id_col, text))
    return whole.join(stay, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, five words, similarity of 0.8 or more."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return similar(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")
