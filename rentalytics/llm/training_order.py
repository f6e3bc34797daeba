"""Training-order materialisation: token sequences in a keyed random order, in shards of fixed stride.

Every sequence has a dense index, and a keyed Feistel permutation of the indices gives its
slot. Slots are uniform, so cutting them into ranges gives equal partitions without
sampling. A record has a fixed number of bytes: slot ``s`` is in shard ``s // per_shard`` at
byte ``(s % per_shard) * stride``, and reading can start or resume at any slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics.llm.common import bounded, dense, mix64, read
from rentalytics.llm.tokens import default_tokenizer, encoder
from rentalytics.runtime import stage

CONTEXT = 512
END_ID = 1
ROUNDS = 6
SHARD_BYTES = 32 << 20
_HEADER = 4  # the record's number of ids


def permute(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Slot of each index below ``n``: a permutation of 0 to n - 1.

    The network works on the smallest even number of bits that holds ``n`` values, fewer than
    four times too many; what falls outside walks on along its cycle until it is inside.
    """
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key & (2 ** 64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return (left << shift) | right

    slot = once(index.astype(np.uint64))
    while (out := slot >= np.uint64(n)).any():
        slot[out] = once(slot[out])
    return slot.astype(np.int64)


def _slot(index: Column, n: int, key: int) -> Column:
    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(permute(values.to_numpy(), n, key))

    return run(index)


def sequences(rows: DataFrame, text: str, keys: list[str], *, tokenizer: str, context: int, end_id: int, wide: bool) -> DataFrame:
    """One row per sequence: key columns ``k0``..., ``start``, ``n_ids``, ``ids`` (not padded)."""
    packed = rows.select(F.struct(F.lit(0).alias("_"), *[rows[c].alias(f"k{i}") for i, c in enumerate(keys)]).alias("row"),
                         rows[text].alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in bounded(batches, "text"):
            at, starts, counts, parts = [], [], [], []
            for i, raw in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                ids = np.frombuffer(raw + np.array([end_id], "<u4").tobytes(), "<u4")
                if not wide and ids.max() >= 1 << 16:
                    raise ValueError("an id needs more than 16 bits: pass wide=True")
                for start in range(0, len(ids), context):
                    piece = ids[start:start + context]
                    at.append(i)
                    starts.append(start)
                    counts.append(len(piece))
                    parts.append(piece.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(parts, pa.binary())], names=schema.names)

    return packed.mapInArrow(run, schema).select("row.*", "start", "n_ids", "ids").drop("_")


def materialise(
    rows: DataFrame, text: str, keys: list[str], *, key: int = 2024, tokenizer: str | None = None, context: int = CONTEXT,
    end_id: int = END_ID, wide: bool = False, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Records in training order: key columns, ``start``, ``n_ids``, ``slot``, ``shard``, ``byte_offset``, ``record``.

    A text's ids and the end id are cut into sequences of ``context`` ids. A record is the
    number of ids (32 bits) and the ids (16 bits, 32 with ``wide``), filled up with zeros. Rows come
    in partitions of whole shards, sorted by slot. Which row gets which index follows the
    stored table of sequences; the order of indices is the key's.

    Null and empty texts make one sequence, the end id. Equal rows make sequences of their
    own. No row makes no record. Columns other than the keys do not travel.
    """
    ids = sequences(rows, text, keys, tokenizer=tokenizer or default_tokenizer(), context=context, end_id=end_id, wide=wide)
    ids = stage(ids.withColumn("at", F.monotonically_increasing_id()), "sequences")
    n = ids.count()
    stride = _HEADER + context * (4 if wide else 2)
    per_shard = max(1, shard_bytes // stride)
    shards = max(1, -(-n // per_shard))
    placed = dense(ids, "at", "index").withColumn("slot", _slot(F.col("index"), max(n, 1), key))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int")).drop("index", "at")
    ordered = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    names = [f"k{i}" for i in range(len(keys))]
    schema = T.StructType([*ordered.schema.fields[:len(names)], *(T.StructField(c, T.LongType()) for c in (
        "start", "n_ids", "slot")), T.StructField("shard", T.IntegerType()), T.StructField("byte_offset", T.LongType()),
        T.StructField("record", T.BinaryType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, slots = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_ids", "slot"))
            records = [(c.to_bytes(_HEADER, "little") + i).ljust(stride, b"\0")
                       for c, i in zip(counts.tolist(), batch.column("ids").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*names, "start", "n_ids", "slot", "shard")),
                 pa.array(slots % per_shard * stride), pa.array(records, pa.binary())], names=schema.names)

    return ordered.mapInArrow(fill, schema).toDF(*keys, *schema.names[len(names):])


_MANIFEST = "shard int, first_slot long, records long, bytes long, crc32 long, path string"


def write_shards(records: DataFrame, path: str) -> DataFrame:
    """Writes each shard as one file of records under ``path`` and returns the manifest, one row per shard.

    ``records`` is the result of ``materialise``. A file gets its name when it is complete, so a
    repeated task leaves a whole file of the same content. ``path`` is a folder or address that
    every executor reaches. A shard is written record by record.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(path)
        target.create_dir(root, recursive=True)
        state, made = None, []

        def close() -> None:
            state["sink"].close()
            target.move(state["draft"], state["final"])
            made.append((state["shard"], state["first"], state["n"], state["bytes"], state["crc"], state["final"]))

        for batch in batches:
            for shard, slot, record in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "record"))):
                if state is None or shard != state["shard"]:
                    if state:
                        close()
                    final = f"{root}/shard-{shard:06d}.bin"
                    draft = f"{root}/.draft-{uuid.uuid4().hex}"
                    state = {"shard": shard, "first": slot, "n": 0, "bytes": 0, "crc": 0, "final": final, "draft": draft,
                             "sink": target.open_output_stream(draft)}
                state["sink"].write(record)
                state["crc"] = zlib.crc32(record, state["crc"])
                state["n"] += 1
                state["bytes"] += len(record)
        if state:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in _MANIFEST.split(", ")], m)) for m in made],
                                         schema=pa.schema([("shard", pa.int32()), *((c, pa.int64()) for c in (
                                             "first_slot", "records", "bytes", "crc32")), ("path", pa.string())]))

    return stage(records.select("shard", "slot", "record").mapInArrow(run, _MANIFEST), "shard-manifest")


def read_shards(spark: SparkSession, path: str, *, context: int = CONTEXT, wide: bool = False,
                shard_bytes: int = SHARD_BYTES, from_slot: int = 0) -> DataFrame:
    """``slot`` and ``ids`` of all records from ``from_slot`` on. A file, at most ``shard_bytes`` long, is read at once."""
    stride = _HEADER + context * (4 if wide else 2)
    per_shard = max(1, shard_bytes // stride)
    kind = "<u4" if wide else "<u2"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path).select("path", "content")
    number = F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long")
    files = files.select(number.alias("shard"), "content").filter((F.col("shard") + 1) * per_shard > from_slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist()):
                first = max(0, from_slot - shard * per_shard)
                rows = np.frombuffer(content, np.uint8).reshape(-1, stride)[first:]
                counts = rows[:, :_HEADER].copy().view("<u4")[:, 0]
                ids = [r[_HEADER:].tobytes() for r in rows]
                width = 4 if wide else 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard * per_shard + first + np.arange(len(rows), dtype=np.int64)),
                     pa.array([np.frombuffer(i[:c * width], kind).astype(np.int32) for i, c in zip(ids, counts.tolist())],
                              pa.list_(pa.int32()))], names=["slot", "ids"])

    return files.mapInArrow(run, "slot long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in training order, every record in full."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return materialise(docs, "text", ["doc_id"]).withColumn("record_crc32", F.crc32("record"))
