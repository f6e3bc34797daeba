"""Small tables with every awkward case, and the given documents."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(40_000))
SECRET = 'here token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and that is all of it for today my friends'
# doc_id, text, lang, source, n_chars: nulls, empty and blank texts, ties, repeats, a very long text.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, "  \n\t ", "en", "b", 5),
    (5, LONG, "en", "b", len(LONG)),
    (6, "the quick brown fox jumps over the lazy dog and runs away", "en", None, 57),
    (6, "the quick brown fox jumps over the lazy dog and runs away", "en", None, 57),
    (None, "a text whose row has no id but words enough to be kept by rules", "de", "b", None),
    (7, SECRET, "en", "c", len(SECRET)),
    (8, "größe straße 文字 \U0001f600 ünï", None, "c", 20),
    (9, "x", "en", "", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
CLASHING = (
    "row", "id", "key", "k0", "k1", "c0", "_", "at", "n", "x", "m", "size", "tag", "h1", "h2", "label", "shard", "slot",
    "copies", "target", "kept", "score", "quality", "host", "path", "rule", "verdict", "base", "spans", "start", "length",
    "bucket", "place", "ahead", "fingerprint", "group", "part", "name",
)


def awkward(spark, extra: bool = True):
    df = spark.createDataFrame(ROWS, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, n: int = 10):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, n)] + [(None, 1, 0), (1, 0, 0), (3, None, 0)],
                                 "doc_id long, quality int, toxic int")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
