"""Stable shards for keys: jump consistent hashing, written in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentalytics.runtime import stage

# The generator of the published algorithm: key <- key * FACTOR + 1 modulo 2**64.
FACTOR = 2862933555777941757
_LOW = (1 << 22) - 1
_TOP = (1 << 20) - 1
# Rows of one numbering range inside a shard.
RANGE_ROWS = 100_000


def key_hash(*columns: Column) -> Column:
    """64-bit key of a row's stable columns. Nulls are keys like any other."""
    return F.xxhash64(*columns)


def _next_key(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """One step of the generator on limbs of 22, 22 and 20 bits: no product exceeds 2**63."""
    f0, f1, f2 = FACTOR & _LOW, (FACTOR >> 22) & _LOW, FACTOR >> 44
    r0 = a * f0 + F.lit(1)
    r1 = a * f1 + b * f0 + F.shiftright(r0, 22)
    r2 = a * f2 + b * f1 + c * f0 + F.shiftright(r1, 22)
    return r0.bitwiseAND(_LOW), r1.bitwiseAND(_LOW), r2.bitwiseAND(_TOP)


def jump(key: Column, shards: int) -> Column:
    """``struct(shard, next)``: the shard among ``shards``, and the next bucket the key would jump to.

    With more shards the key stays where it is until their number exceeds ``next``, so one
    evaluation serves all shard counts up to ``next + 1``. A jump goes up by one bucket at
    least: ``shards`` steps suffice for every key, and steps after the last jump do nothing.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(
        key.bitwiseAND(_LOW).alias("a"),
        F.shiftrightunsigned(key, 22).bitwiseAND(_LOW).alias("b"),
        F.shiftrightunsigned(key, 44).bitwiseAND(_TOP).alias("c"),
        long(-1).alias("shard"), long(0).alias("next"),
    )

    def step(s: Column, _: Column) -> Column:
        a, b, c = _next_key(s["a"], s["b"], s["c"])
        high = F.shiftleft(c, 11) + F.shiftright(b, 11)  # the upper 31 bits
        ahead = ((s["next"] + long(1)) * (F.lit(2147483648.0) / (high + long(1)))).cast("long")
        moved = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), s["next"].alias("shard"), ahead.alias("next"))
        return F.when(s["next"] < long(shards), moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: F.struct(
        s["shard"].cast("int").alias("shard"), s["next"].alias("next")))


def shard_rows(
    rows: DataFrame, keys: list[str], shards: int, tie: list[str] | None = None, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``rows`` plus ``shard``, ``grown_shard`` (with one shard more) and ``slot`` (0, 1, ... in the shard).

    The shard depends on the key columns and the number of shards only; appending a shard
    moves keys into the new one and nowhere else. Slots follow the key's hash, then ``tie``
    (default: every other column that can be ordered).

    Nulls in a key are a key of their own; rows with equal keys share a shard and get
    slots of their own; an empty table stays empty. The three new columns replace columns
    of the same names. No text is moved beyond the columns of ``rows`` itself.

    Slots: each shard is cut into hash ranges of about ``range_rows`` rows, rows are numbered
    per range, and ranges are shifted by the sizes of those before. Only equal keys can make
    a range larger; it is sorted on disk if need be.
    """
    kept = [c for c in rows.columns if c not in ("shard", "grown_shard", "slot")]
    tie = [c for c in kept if c not in keys and dict(rows.dtypes)[c].split("<")[0] not in ("map", "variant")] \
        if tie is None else tie
    row = F.struct(*[rows[c].alias(f"c{i}") for i, c in enumerate(kept)])
    key = key_hash(*[rows[k] for k in keys])
    at = {c: F.col(f"row.c{i}") for i, c in enumerate(kept)}
    placed = rows.select(row.alias("row"), key.alias("key"), jump(key, shards).alias("to"))
    placed = stage(placed.select("row", "key", F.col("to.shard").alias("shard"), F.col("to.next").alias("ahead")),
                   "shards")
    ranges = max(1, -(-placed.count() // (shards * range_rows)))
    # The key's unsigned upper 31 bits, cut into equal ranges.
    high = F.shiftrightunsigned("key", 33)
    placed = placed.withColumn("part", F.floor(high * F.lit(ranges) / F.lit(float(1 << 31))).cast("long"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("shard", "part").count().select(
        "shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy(high, "key", *[at[k] for k in keys], *[at[c] for c in tie])
    numbered = placed.withColumn("n", F.row_number().over(inside)).join(sizes, ["shard", "part"])
    grown = F.when(F.col("ahead") == shards, F.lit(shards)).otherwise(F.col("shard")).cast("int")
    return numbered.select(
        *[at[c].alias(c) for c in kept], F.col("shard"), grown.alias("grown_shard"),
        (F.col("first") + F.col("n") - 1).cast("long").alias("slot"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of ``op2_shards``: law ``key`` over all documents, 40 shards."""
    from rentalytics.llm.common import read

    text = F.coalesce("text", F.lit(""))
    slim = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(slim, ["doc_id"], 40).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
