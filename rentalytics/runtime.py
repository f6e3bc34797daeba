"""Session settings, shared staging and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup side is broadcast only after its size was measured below this bound.
BROADCAST_BYTES = 32 << 20
SALTS = 32
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_STAGED = re.compile(r"-[0-9a-f]{32}$")  # what stage_path puts behind a label
_local_dirs: dict[str, str] = {}  # application -> folder, for local masters only


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rentalytics")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="rentalytics-")
    return _local_dirs[app]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A write inside frees its shuffle files when it ends, and not when the driver next collects garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(
    df: DataFrame, label: str, partition_by: Sequence[str] = (), compression: str | None = None
) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives executor loss, keeps column pruning, and gives the
    optimizer the true size of the data. Shuffle files of the write are freed with it.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    with shuffles_dropped(spark):
        df.write.partitionBy(*partition_by).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def restage(df: DataFrame, label: str) -> DataFrame:
    """``stage`` for a table that takes the place of all staged tables it is made of: these are deleted.

    Only tables of this process's folder whose names ``stage`` gave go. Nothing else may read them any more.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    out = stage(df, label, compression="zstd")
    for folder in folders:
        parent, _, name = folder.rpartition("/")
        if parent.split(":", 1)[-1].lstrip("/") == root.split(":", 1)[-1].lstrip("/") and _STAGED.search(name):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values: eight for a number or a date, the length of texts and of JSON for nested values."""
    fixed = 8 * sum(isinstance(f.dataType, _FIXED) for f in df.schema.fields)
    sizes = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.octet_length(c))
        elif not isinstance(f.dataType, _FIXED):
            sizes.append(F.octet_length(F.to_json(F.struct(c))))
    row = df.agg(F.count("*").alias("n"), *[F.sum(s.cast("long")).alias(f"s{i}") for i, s in enumerate(sizes)]).first()
    return row.n * fixed + sum(row[f"s{i}"] or 0 for i in range(len(sizes)))


def small_or_plain(df: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it measures at most so many bytes, else without a hint."""
    return F.broadcast(df) if measured_bytes(df) <= broadcast_bytes else df


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    salt_by: Sequence[str],
    *,
    how: str = "inner",
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int | None = None,
) -> DataFrame:
    """Join a large frame to an aggregated lookup with one row per key.

    The lookup is computed once (while the query is built) and measured. Up to
    ``broadcast_bytes`` it is broadcast, so the large side never moves. Beyond that both
    sides are shuffled on the key plus a salt taken from ``salt_by``: a key holding a third
    of all rows is then spread over ``salts`` tasks, at the price of ``salts`` copies of each
    lookup row. By default salts grow with the session's shuffle partitions.
    """
    lookup = stage(lookup, "lookup")
    if measured_bytes(lookup) <= broadcast_bytes:
        return rows.join(F.broadcast(lookup), list(keys), how)
    if salts is None:
        salts = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        rows.withColumn("_salt", salt)
        .join(lookup.withColumn("_salt", copies), [*keys, "_salt"], how)
        .drop("_salt")
    )
