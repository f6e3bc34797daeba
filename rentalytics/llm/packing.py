"""Packing documents into windows of equal length by multiway differencing.

A document is cut into full windows and a rest. The full windows stand alone. Of the rest
a multiple of a quarter window is one piece and what remains another, so that windows are
filled from small pieces. Pieces meet in groups of bounded size; each group is divided
into as many windows as its tokens need by Karmarkar-Karp differencing: the two partial
partitions with the largest differences are merged again and again, the full bins of one
onto the empty bins of the other. If a window comes out too long, the group gets one more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics.llm.common import bounded, read
from rentalytics.llm.tokens import default_tokenizer, encoder
from rentalytics.runtime import stage

WINDOW = 2048
END_ID = 1
GROUP_PIECES = 1_024
_PIECE = T.StructType().add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long")


def cuts(n: int, window: int = WINDOW) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, in order."""
    full, rest = divmod(n, window)
    unit = max(window // 4, 1)
    even = rest // unit * unit
    return [window] * full + [x for x in (even, rest - even) if x]


def divide(sizes: np.ndarray, k: int) -> np.ndarray:
    """Bin (0 to k - 1) of each size, all bins about equally full: Karmarkar-Karp differencing.

    A partial partition has its non-empty bins sorted by sum, largest first, sums relative
    to its emptiest bin. What a bin holds is a tree of merges, read out at the end.
    """
    n = len(sizes)
    if k == 1 or n <= 1:
        return np.zeros(n, np.int64)
    left, right = [-1] * n, [-1] * n
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            sums, nodes = np.concatenate([a, b]), np.concatenate([x, y])
        else:
            sums, nodes = np.zeros(k, np.int64), np.full(k, -1)
            sums[:len(a)], nodes[:len(a)] = a, x
            at = np.arange(k - 1, k - 1 - len(b), -1)  # the fullest bin of b onto the emptiest of a
            sums[at] += b
            both = nodes[at] >= 0
            fresh = np.arange(len(left), len(left) + int(both.sum()))
            left += nodes[at[both]].tolist()
            right += y[both].tolist()
            nodes[at] = np.where(both, -1, y)
            nodes[at[both]] = fresh
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        serial += 1
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), serial, sums, nodes))
    bins = np.zeros(n, np.int64)
    for b, node in enumerate(heap[0][3]):
        stack = [int(node)]
        while stack:
            i = stack.pop()
            if i < n:
                bins[i] = b
            else:
                stack += [left[i], right[i]]
    return bins


def windows_of(sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Window of each piece, none above ``window`` tokens."""
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        bins = divide(sizes, k)
        if np.bincount(bins, sizes).max() <= window:
            return bins
        k += 1


def pieces(rows: DataFrame, text: str, keys: list[str], tokenizer: str, window: int = WINDOW, end_id: int = END_ID,
           keep_ids: bool = False) -> DataFrame:
    """One row per piece: the key columns, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` (and ``ids``)."""
    packed = rows.select(F.struct(F.lit(0).alias("_"), *[rows[c].alias(f"c{i}") for i, c in enumerate(keys)]).alias("row"),
                         rows[text].alias("text"))
    extra = [T.StructField("ids", T.BinaryType())] if keep_ids else []
    schema = T.StructType([packed.schema["row"], *_PIECE.fields, *extra])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in bounded(batches, "text"):
            at, out, parts = [], [], []
            for i, ids in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                start, n = 0, len(ids) // 4
                for length in cuts(n, window):
                    piece = ids[4 * start:4 * (start + length)]
                    at.append(i)
                    out.append((start, length, zlib.crc32(piece), n))
                    if keep_ids:
                        parts.append(piece)
                    start += length
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(at, pa.int64())), *(pa.array(c.copy()) for c in columns),
                 *([pa.array(parts, pa.binary())] if keep_ids else [])], names=schema.names)

    return packed.mapInArrow(run, schema).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keys)],
                                                 *schema.names[1:])


def pack(
    rows: DataFrame, text: str, keys: list[str], *, tokenizer: str | None = None, window: int = WINDOW,
    end_id: int = END_ID, group_pieces: int = GROUP_PIECES, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: the key columns, the piece's columns, ``sequence_id`` and ``offset``.

    Null and empty texts have one token, the end id. Equal rows are packed one by one. Rows of
    an empty table make no sequences. Key columns keep their names unless these are among the
    new ones. Groups hold about ``group_pieces`` pieces, drawn by their place in the stored
    table of pieces, so that neither a key nor a text can fill one; ids do not travel
    to the groups unless ``keep_ids`` asks for them.
    """
    made = pieces(rows, text, keys, tokenizer or default_tokenizer(), window, end_id, keep_ids)
    names = [f"k{i}" for i in range(len(keys))]
    new = made.columns[len(keys):]
    made = stage(made.toDF(*names, *new).withColumn("at", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-made.count() // group_pieces))
    grouped = made.withColumn("group", F.pmod(F.xxhash64("at"), F.lit(groups)))
    schema = T.StructType([*made.schema.fields[:-1], T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ignore_index=True)
        length = pdf["length"].to_numpy()
        own = np.flatnonzero(length == window)
        rest = np.flatnonzero(length != window)
        local = np.zeros(len(pdf), np.int64)
        local[own] = np.arange(len(own))
        if len(rest):
            local[rest] = len(own) + windows_of(length[rest], window)
        pdf["sequence_id"] = (int(pdf["group"].iloc[0]) << 32) + local
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf[schema.names]

    return grouped.groupBy("group").applyInPandas(run, schema).toDF(*keys, *new, "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op6_pack``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, "text", ["doc_id"])
