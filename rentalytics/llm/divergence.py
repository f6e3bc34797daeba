"""Source divergence audit: how far each source's term shares stand from its language's and from each other source's.

Per language, terms found in a minimum number of documents are kept, with no bound on their number; their counts are
summed per group in Spark, and pairs of sources meet only on the terms they share, the rest in closed terms.
``vectors`` gives the same counts by a ``CountVectorizer`` per language, exact sparse document vectors summed per
group; it holds the vocabularies on the driver, which at 0.5 GB of documents took more than 1.5 GB there, so the
registered audit counts its vocabulary as a table (``held_counts``) and ``vectors`` is kept for smaller corpora and
tested to agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics.llm.common import bounded, read
from rentalytics.runtime import join_lookup, small_or_plain, stage, stage_path

# Fixed values of the audit: a term is a run of anything but ASCII other than letters; only A-Z is lowered.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DF = 3
VOCAB_SIZE = 2**31 - 1
SCALE = 1_000_000_000
TOP_TERMS = 200
# A group's terms are first ranked in so many parts of their hash, so that no task sorts all terms of a hot source.
SPREAD = 64
# Text whose terms a Python worker counts at once.
COUNT_BYTES = 16 << 20
# A sum below this, times SCALE, is still a 64-bit number.
NARROW = (2**63 - 1) // SCALE
# Bytes of UTF-8: separators 0, letters lowered in A-Z, everything above ASCII as it is.
_TERM_BYTES = np.arange(256, dtype=np.uint8)
_TERM_BYTES[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0
_TERM_BYTES[0x41:0x5B] += 0x20
_PARTIAL = "lang string, source string, term string, c long, df long"
_VECTOR = T.StructType([
    T.StructField("type", T.ByteType()), T.StructField("size", T.IntegerType()),
    T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType())),
])


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + vocabulary))``, in whole numbers of any size."""
    wide = T.DecimalType(38, 0)
    total, one = total.cast("long") + vocabulary.cast("long"), F.lit(1).cast("long")
    exact = F.call_function("div", (count.cast(wide) + F.lit(1)) * F.lit(SCALE).cast(wide), total.cast(wide)).cast("long")
    quick = F.call_function("div", (count.cast("long") + one) * F.lit(SCALE).cast("long"), total)
    return one + F.when((total < NARROW) & (count < NARROW - 1), quick).otherwise(exact)


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)² / q)`` in whole numbers."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_lists(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source`` (null: '') and ``terms``, the terms of the text in order (null text: none)."""
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)).alias("terms"),
    )


def vectors(lists: DataFrame, min_df: int = MIN_DF) -> tuple[DataFrame, DataFrame]:
    """Sparse count vectors of every document by ``CountVectorizer``, one vocabulary per language, and the vocabularies.

    Terms are prefixed by their language before the fit, so one model holds the vocabularies of all languages side by
    side: a term's document frequency is counted among its language's documents only, and a vector holds only
    its language's terms. Returns ``(lang, source, vector)`` with ``vector`` as a struct (``indices``, ``values``),
    and ``(lang, i, term)``. Without a term in ``min_df`` documents of its language the vocabulary is empty and so are
    the vectors. The vocabularies are held by the driver's JVM, as ``CountVectorizer`` keeps them in its model;
    the table of terms is read back from the saved model by the executors.
    """
    spark = lists.sparkSession
    prefix = F.concat(F.hex(F.encode("lang", "UTF-8")), F.lit(":"))
    keyed = lists.select("lang", "source", F.transform("terms", lambda t: F.concat(prefix, t)).alias("terms"))
    fit = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=VOCAB_SIZE)
    try:
        model = fit.fit(keyed)
    except Exception as e:  # Spark refuses an empty vocabulary: then no language keeps a term
        if "vocabulary size should be > 0" not in str(e):
            raise
        model = None
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("vector", _VECTOR)])
    if model is None:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "lang string, i int, term string")
    # The vector leaves the model as its stored struct: written once and read with the struct's schema.
    path = stage_path(spark, "vectors")
    model.transform(keyed).select("lang", "source", "vector").write.parquet(path)
    # The vocabulary is read from the saved model, so that it never passes through Python.
    saved = stage_path(spark, "vectorizer")
    model.write().save(saved)
    named = spark.read.parquet(f"{saved}/data").select(F.posexplode("vocabulary").alias("i", "term"))
    cut = F.instr("term", ":")
    words = named.select(F.decode(F.unhex(F.substr("term", F.lit(1), cut - 1)), "UTF-8").alias("lang"),
                         F.col("i").cast("int").alias("i"), F.substr("term", cut + 1).alias("term"))
    return spark.read.schema(schema).parquet(path), stage(words, "vocabulary")


def term_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts one after the other, and how many each text has.

    Every byte of a character above ASCII belongs to a term, so the rule for characters holds byte by byte.
    """
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0]:bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    low = _TERM_BYTES[data]
    inside = low != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = bounds[:-1][np.diff(bounds) > 0]
    starts[firsts] = inside[firsts]
    letters = low[inside]
    offsets = np.append(np.flatnonzero(starts[inside]), letters.size)
    found = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters))
    return found, np.diff(np.searchsorted(np.flatnonzero(starts), bounds))


def count_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``lang, source, term, c, df`` of the batch's texts: per group and term its places and its documents."""
    terms, sizes = term_array(batch.column("text"))
    groups = batch.select(["lang", "source"]).to_struct_array()
    names = groups.field("lang").dictionary_encode(), groups.field("source").dictionary_encode()
    langs, sources = (n.indices.to_numpy(zero_copy_only=False).astype(np.int64) for n in names)
    width = max(len(names[1].dictionary), 1)
    group = langs * width + sources
    order = np.argsort(group, kind="stable")  # documents by group: a term's places by document are places by group
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    words = terms.dictionary_encode()
    docs = max(batch.num_rows, 1)
    keys = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * docs + np.repeat(place, sizes)
    keys.sort()
    new_doc = np.ones(keys.size, bool)
    new_doc[1:] = keys[1:] != keys[:-1]
    word, own = keys // docs, group[order][keys % docs] if keys.size else keys
    new_row = np.ones(keys.size, bool)
    new_row[1:] = (word[1:] != word[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new_row)
    c = np.diff(np.append(at, keys.size))
    df = np.add.reduceat(new_doc.astype(np.int64), at) if at.size else at
    return pa.RecordBatch.from_arrays([
        names[0].dictionary.take(pa.array(own[at] // width)), names[1].dictionary.take(pa.array(own[at] % width)),
        words.dictionary.take(pa.array(word[at])).cast(pa.string()), pa.array(c, pa.int64()), pa.array(df, pa.int64()),
    ], names=[f.split()[0] for f in _PARTIAL.split(", ")])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, "text", COUNT_BYTES):
        yield count_terms(batch)


def held_counts(docs: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """``(lang, term, held)`` of every kept term, ``held`` the groups that hold it: ``(source, c)`` each.

    ``docs`` has ``lang``, ``source`` and ``text`` without nulls. A language keeps the terms found in ``min_df`` of its
    documents or more, without any bound on their number, and nothing reaches the driver. One pass over the texts counts
    places and documents together; a batch's counts are summed before they are shuffled, once, by language and term.
    """
    partial = docs.select("lang", "source", "text").mapInArrow(_count_batches, _PARTIAL)
    per_group = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("c").alias("c"), F.sum("df").alias("df"))
    return stage(per_group.groupBy("lang", "term").agg(
        F.sum("df").alias("df"), F.collect_list(F.struct("source", "c")).alias("held"))
        .filter(F.col("df") >= min_df).select("lang", "term", "held"), "counts")


def each_group(held: DataFrame) -> DataFrame:
    """``held_counts`` with a row for each group: ``(lang, source, term, c)``."""
    return held.select("lang", "term", F.inline("held")).select("lang", "source", "term", "c")


def group_counts(lists: DataFrame, min_df: int = MIN_DF) -> tuple[DataFrame, DataFrame]:
    """``(lang, source, term, c)``: each group's count of every kept term it holds, and ``(lang, v)``.

    The same counts as ``vectors`` gives, summed per group, with the vocabulary as a table (``held_counts``).
    """
    held = held_counts(lists.select("lang", "source", F.array_join("terms", " ").alias("text")), min_df)
    return each_group(held), held.groupBy("lang").agg(F.count("*").cast("long").alias("v"))


def vectorizer_counts(lists: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """``group_counts`` by way of ``vectors``: ``CountVectorizer``'s sparse vectors summed per group."""
    found, vocabularies = vectors(lists, min_df)
    entry = F.explode(F.arrays_zip(F.col("vector.indices").alias("i"), F.col("vector.values").alias("c")))
    sums = found.select("lang", "source", entry.alias("e")).groupBy("lang", "source", F.col("e.i").alias("i")).agg(
        F.sum(F.col("e.c").cast("long")).alias("c"))
    return sums.join(vocabularies, ["lang", "i"]).select("lang", "source", "term", "c")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *,
          min_df: int = MIN_DF, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) group that occurs.

    Null lang, source and text count as ''. Per language the kept terms are those in at least ``min_df`` of its
    documents (V of them). A group's share of a term is ``p = 1 + floor(SCALE (count + 1) / (N + V))``, N the group's
    count of kept terms; the language's share ``q`` alike over all its documents. Part ``pair``: every other source of
    the language, value the sum over all kept terms of ``floor((p - q)² / q)`` with q the other source's share (0 when
    V is 0). Part ``term``: kept terms the group holds with p above the language's share, value ``floor((p - q)² / q)``,
    the first ``top`` only. Ranks from 1 per group and part, value descending, then item in UTF-8 order. A group without
    kept terms has pair rows and no term rows; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    held = held_counts(docs, min_df)
    groups = stage(docs.select("lang", "source").distinct(), "groups")
    sizes = held.groupBy("lang").agg(F.count("*").cast("long").alias("v"))
    hist = stage(each_group(held).groupBy("lang", "source", "c").agg(F.count("*").alias("m")), "histograms")
    totals = stage(groups.join(hist.groupBy("lang", "source").agg(F.sum(F.col("c") * F.col("m")).alias("n")),
                               ["lang", "source"], "left")
                   .join(small_or_plain(sizes), "lang", "left")
                   .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")),
                   "totals")
    return terms_part(held, totals, top).unionByName(pairs_part(held, hist, totals, groups))


def terms_part(held: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Terms each group holds more of than its language, at most ``top`` of them, ranked."""
    lang_totals = totals.groupBy("lang").agg(F.sum("n").alias("nl"), F.max("v").alias("vl"))
    in_lang = F.aggregate("held", F.lit(0).cast("long"), lambda s, h: s + h["c"])
    rows = held.withColumn("cl", in_lang).join(small_or_plain(lang_totals), "lang")
    rows = rows.select("lang", "term", share(F.col("cl"), F.col("nl"), F.col("vl")).alias("q"), F.inline("held"))
    rows = join_lookup(rows, totals, ["lang", "source"], ["term"])
    p, q = share(F.col("c"), F.col("n"), F.col("v")), F.col("q")
    scored = rows.select("lang", "source", "term", p.alias("p"), q.alias("q")).filter("p > q")
    scored = scored.select("lang", "source", "term", gap(F.col("p"), F.col("q")).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    spread = scored.select("lang", "source", F.col("term").alias("item"), "value").withColumn(
        "_sub", F.pmod(F.xxhash64("item"), F.lit(SPREAD)))
    first = spread.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "source", "_sub").orderBy(*order)))
    kept = first.filter(F.col("_r") <= top).drop("_sub", "_r")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", F.col("rank").cast("int"))


def pairs_part(held: DataFrame, hist: DataFrame, totals: DataFrame, groups: DataFrame) -> DataFrame:
    """Every other source of the language, by the summed gap over all kept terms.

    With ``p0`` a group's share of an absent term and ``f`` the gap, the sum over all V terms is
    ``A + B + sum over shared terms of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)) + (V - |g| - |o|) f(p0, q0)``, where
    A sums ``f(p, q0)`` over the group's terms and B ``f(p0, q)`` over the other's. A and B come from histograms of
    counts (one row per distinct count), and so does the shared sum: a term's pairs, each once, are counted by their
    two counts, and the gaps are taken both ways once for each pair of counts.
    """
    wide = "decimal(38,0)"
    others = small_or_plain(groups.select("lang", F.col("source").alias("other")))
    g = totals.select("lang", "source", F.col("n").alias("ng"), "v")
    o = totals.select("lang", F.col("source").alias("other"), F.col("n").alias("no"))
    zero = F.lit(0).cast("long")
    p0, q0 = share(zero, F.col("ng"), F.col("v")), share(zero, F.col("no"), F.col("v"))
    pairs = groups.join(others, "lang").filter(F.col("source") != F.col("other"))
    pairs = pairs.join(small_or_plain(g), ["lang", "source"]).join(small_or_plain(o), ["lang", "other"])
    pairs = stage(pairs, "pairs")
    own = hist.join(pairs, ["lang", "source"]).groupBy("lang", "source", "other").agg(
        F.sum((gap(share(F.col("c"), F.col("ng"), F.col("v")), q0) * F.col("m")).cast(wide)).alias("a"),
        F.sum("m").alias("sg"))
    theirs = hist.withColumnRenamed("source", "other").join(pairs, ["lang", "other"]).groupBy(
        "lang", "source", "other").agg(
        F.sum((gap(p0, share(F.col("c"), F.col("no"), F.col("v"))) * F.col("m")).cast(wide)).alias("b"),
        F.sum("m").alias("so"))
    met = held.filter(F.size("held") > 1).select("lang", "held", F.inline("held")).select(
        "lang", F.col("source").alias("s1"), F.col("c").alias("c1"), F.inline("held")).filter(F.col("s1") < F.col("source"))
    met = stage(met.groupBy("lang", "s1", F.col("source").alias("s2"), "c1", F.col("c").alias("c2")).agg(
        F.count("*").alias("m")), "pair-counts")
    shared = met.select("lang", F.col("s1").alias("source"), F.col("s2").alias("other"), F.col("c1").alias("cg"),
                        F.col("c2").alias("co"), "m").unionByName(
        met.select("lang", F.col("s2").alias("source"), F.col("s1").alias("other"), F.col("c2").alias("cg"),
                   F.col("c1").alias("co"), "m"))
    shared = join_lookup(shared, pairs, ["lang", "source", "other"], ["cg", "co"])
    p, q = share(F.col("cg"), F.col("ng"), F.col("v")), share(F.col("co"), F.col("no"), F.col("v"))
    shared = shared.select("lang", "source", "other", "m", p.alias("p"), q.alias("q"), p0.alias("p0"), q0.alias("q0"))
    p, q, r, t = (F.col(c) for c in ("p", "q", "p0", "q0"))
    both = shared.groupBy("lang", "source", "other").agg(
        F.sum((gap(p, q) - gap(p, t) - gap(r, q) + gap(r, t)).cast(wide) * F.col("m")).alias("i_sum"))
    value = (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) + F.coalesce("i_sum", F.lit(0))
             + (F.col("v") - F.coalesce("sg", F.lit(0)) - F.coalesce("so", F.lit(0))).cast(wide) * gap(p0, q0))
    value = F.when(F.col("v") == 0, F.lit(0)).otherwise(value)
    keys = ["lang", "source", "other"]
    ranked = pairs.join(own, keys, "left").join(theirs, keys, "left").join(both, keys, "left").select(
        "lang", "source", F.col("other").alias("item"), value.cast("long").alias("value"))
    return ranked.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int")).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the audit of all ``documents``: three documents at least per term, the first 200 terms of each group."""
    return audit(read(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
occ AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
vsize AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
gc AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS c FROM occ o JOIN kept k USING (lang, term)
       GROUP BY o.lang, o.source, o.term),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n, coalesce(max(vs.v), 0)::HUGEINT AS v
       FROM groups g LEFT JOIN gc c USING (lang, source) LEFT JOIN vsize vs ON vs.lang = g.lang
       GROUP BY g.lang, g.source),
lc AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM gc GROUP BY lang, term),
ln AS (SELECT lang, sum(n)::HUGEINT AS n, max(v)::HUGEINT AS v FROM gn GROUP BY lang),
full_g AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0)::HUGEINT AS c, g.n, g.v
           FROM gn g JOIN kept k ON k.lang = g.lang LEFT JOIN gc c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pg AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 1)) // (n + v) AS p FROM full_g),
pl AS (SELECT l.lang, l.term, 1 + (1000000000 * (l.c + 1)) // (n.n + n.v) AS q FROM lc l JOIN ln n USING (lang)),
terms_part AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value
    FROM pg JOIN pl USING (lang, term) WHERE c > 0 AND p > q),
pair_sums AS (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM pg x JOIN pg y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
    GROUP BY x.lang, x.source, y.source),
pair_part AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (
    SELECT lang, source, part, item, value::BIGINT AS value,
           (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
    FROM (SELECT * FROM terms_part UNION ALL SELECT * FROM pair_part))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
