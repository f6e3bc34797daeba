"""Spelling variant grouping: words one edit apart found through a trie of letter-group counts.

A word's frequency vector counts its letters by level: each of a-z is a level, and the Latin-1 letters form four more.
One inserted, deleted or replaced letter moves that vector by at most one unit up (surplus) and one unit down
(deficit) on different levels; only a replacement inside a Latin-1 group leaves it as it is. The words of a bucket
lie sorted by their vectors, which makes an implicit trie: a node is a range of rows with equal leading counts. A
depth-first search from the root spends a surplus and a deficit budget of one each; the words at the leaves it reaches
are verified by an exact one-edit test.

The trie's top levels and the length are the shuffle key, so a word travels once as an index row to its own bucket and
as a few query copies to the buckets its neighbours may lie in; each copy carries what is left of its budget. A
bucket of more than ``BUCKET_ROWS`` index words is split by word hash, and its query copies go to every part. Tasks
stream the query copies past one bucket's index at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics.llm.common import read
from rentalytics.runtime import join_lookup, stage

# Fixed values of the grouping: runs of these letters, only A-Z lowered; the deletion rule's divisor.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIVISOR = 31
MIN_CHARS = 7
MIN_COUNT = 2
FORM_RATIO = 10
# Levels of the vector: a-z by falling letter frequency, then the Latin-1 letters in groups of 16 code points.
ORDER = "eaitnorslcdumhgpbfvkwyzjxq"
LATIN_GROUPS = 4
LEVELS = len(ORDER) + LATIN_GROUPS
TOP = 3  # levels in the shuffle key, besides the length
BUCKET_ROWS = 20_000
_LEVEL = {c: i for i, c in enumerate(ORDER)} | {chr(0xC0 + k): len(ORDER) + k // 16 for k in range(64)}

_COPY = T.StructType([
    T.StructField("length", T.IntegerType()), *[T.StructField(f"t{k}", T.IntegerType()) for k in range(TOP)],
    T.StructField("kind", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("surplus", T.IntegerType()), T.StructField("deficit", T.IntegerType()),
])
_FOUND = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()),
    T.StructField("best", T.StringType()), T.StructField("best_n", T.LongType()),
])


def vector(word: str) -> np.ndarray:
    """Counts of the word's letters by level."""
    v = np.zeros(LEVELS, np.int32)
    for ch in word:
        v[_LEVEL[ch]] += 1
    return v


def one_edit(a: str, b: str) -> bool:
    """Whether ``b`` is ``a`` with exactly one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1:] == b[i + 1:]
    return a[i:] == b[i + 1:]


def copies(word: str, n: int) -> list[tuple]:
    """The index row of a word and its query copies: (length, top counts, kind, word, n, surplus, deficit).

    A copy names the bucket (length and top counts) where neighbours of one kind of change lie, with the budget still
    to spend below the top levels. Each possible neighbour vector lies on exactly one copy's path.
    """
    v = vector(word)
    size, top = len(word), tuple(int(x) for x in v[:TOP])
    out = [(size, *top, 0, word, n, 0, 0)]
    latin = bool(v[len(ORDER):].any())
    plans = []  # (length change, surplus level or None or -1 for below, deficit level likewise)
    if latin:
        plans.append((0, None, None))
    for up in [*range(TOP), -1]:
        plans.append((1, up, None))
    for down in [*range(TOP), -1]:
        plans.append((-1, None, down))
    for up in [*range(TOP), -1]:
        for down in [*range(TOP), -1]:
            if up == down and up != -1:
                continue
            plans.append((0, up, down))
    for change, up, down in plans:
        t = list(top)
        if up is not None and up >= 0:
            t[up] += 1
        if down is not None and down >= 0:
            if t[down] == 0:
                continue
            t[down] -= 1
        if size + change < 1:
            continue
        out.append((size + change, *t, 1, word, n, int(up == -1), int(down == -1)))
    return out


_LEVEL_TABLE = np.zeros(256, np.int64)
for _c, _l in _LEVEL.items():
    _LEVEL_TABLE[ord(_c)] = _l
# Query copies searched together against one bucket's trie.
CHUNK = 20_000


def vectors_of(words: list[str]) -> np.ndarray:
    """Frequency vectors of many words at once (one row each)."""
    if not words:
        return np.zeros((0, LEVELS), np.int64)
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    rows = np.repeat(np.arange(len(words)) * LEVELS, [len(w) for w in words])
    return np.bincount(rows + _LEVEL_TABLE[codes], minlength=len(words) * LEVELS).reshape(-1, LEVELS)


class Bucket:
    """The index words of one bucket, sorted by their vectors below the top levels: an implicit trie.

    Rows sorted by vector make every trie node a range of rows. For each level, ``children[level]`` holds a row of
    ``width`` places per node: the child with count c is at c + 1, -1 where there is none, so that a count below 0 or
    above all counts of the bucket is a place without a child. A node of the last level is one distinct vector, its
    rows from ``first[node]`` on.
    """

    def __init__(self, words: list[str], counts: list[int]) -> None:
        vectors = vectors_of(words)[:, TOP:]
        order = np.lexsort(vectors.T[::-1]) if len(words) else np.zeros(0, np.int64)
        vectors = np.ascontiguousarray(vectors[order].T)
        self.words = [words[i] for i in order]
        self.counts = [counts[i] for i in order]
        self.most = int(vectors.max(initial=0))
        self.width = self.most + 6
        self.codes = CodePoints(self.words)
        best = sorted(range(len(order)), key=lambda i: (-self.counts[i], self.words[i]))
        self.best = np.array(best, np.int64)  # rows by falling count, then in code-point order
        self.rank = np.empty(len(order), np.int64)
        self.rank[self.best] = np.arange(len(order))
        self.empty = [not counts_here.any() for counts_here in vectors]
        self.children = []
        node = np.zeros(len(order), np.int64)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for level, counts_here in enumerate(vectors):
            if self.empty[level]:
                self.children.append(None)
                continue
            table = np.full((int(node[-1]) + 1) * self.width, -1, np.int32)
            new[1:] |= counts_here[1:] != counts_here[:-1]
            at = np.flatnonzero(new)
            table[node[at] * self.width + counts_here[at] + 1] = np.arange(len(at))
            self.children.append(table)
            node = np.cumsum(new) - 1
        self.first = np.append(np.flatnonzero(new), len(order))

    def leaves(self, targets: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of every index row whose vector differs from the query's target by exactly its budget: one up
        on one level where ``surplus`` is 1, one down on another where ``deficit`` is 1.

        All queries descend the trie together, level by level, those with the same budget left side by side: a
        node's children are its count, one more while surplus is left, one less while deficit is left; a path that
        could no longer spend its budget stops.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.words or not len(targets):
            return none
        levels = np.ascontiguousarray(np.minimum(targets, self.most + 3).T)
        paths = {}
        for s, d in ((0, 0), (1, 0), (0, 1), (1, 1)):
            query = np.flatnonzero((surplus == s) & (deficit == d))
            if len(query):
                paths[s, d] = [(query, np.zeros(len(query), np.int32))]
        for level, table in enumerate(self.children):
            left = len(self.children) - level - 1
            onward: dict[tuple[int, int], list] = {}
            for (s, d), parts in paths.items():
                query, node = parts[0] if len(parts) == 1 else (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                here = levels[level][query]
                for delta, ns, nd in ((0, s, d), (1, s - 1, d), (-1, s, d - 1)):
                    if ns < 0 or nd < 0 or ns + nd > left:
                        continue
                    if table is None:  # every word counts 0 here, the node stays the same
                        hit = np.flatnonzero(here == -delta)
                        child = node
                    else:
                        child = table[node * self.width + (here + (delta + 1))]
                        hit = np.flatnonzero(child >= 0)
                    if len(hit):
                        onward.setdefault((ns, nd), []).append((query[hit], child[hit]))
            paths = onward
        parts = paths.get((0, 0), [])
        if not parts:
            return none
        query, node = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        lo = self.first[node]
        sizes = self.first[node + 1] - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.repeat(query, sizes), rows

    def near(self, words: list[str], surplus: np.ndarray, deficit: np.ndarray) -> list[tuple[int, str | None, int]]:
        """For each query copy: how many near words of this bucket lie on its path, and the one of largest count."""
        found: list[tuple[int, str | None, int]] = [(0, None, -1)] * len(words)
        for q, n, row in zip(*(a.tolist() for a in self.nearest(words, surplus, deficit))):
            found[q] = n, self.words[row], self.counts[row]
        return found

    def nearest(self, words: list[str], surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, ...]:
        """The query copies with near words in this bucket on their path (ascending), how many those are, and the row
        of the one of largest count (ties: least in code-point order).

        Leaves are verified on code-point rows in arrays; words longer than ``CodePoints.WIDTH`` by ``one_edit``.
        """
        queries, rows = self.leaves(vectors_of(words)[:, TOP:], surplus, deficit)
        met = np.zeros(len(words), bool)
        met[queries] = True
        asked = np.flatnonzero(met)
        near, unsure = CodePoints([words[i] for i in asked.tolist()]).one_edit(
            (np.cumsum(met) - 1)[queries], self.codes, rows)
        for k in np.flatnonzero(unsure).tolist():
            near[k] = one_edit(words[queries[k]], self.words[rows[k]])
        queries, ranks = queries[near], self.rank[rows[near]]
        order = np.lexsort((ranks, queries))
        queries, ranks = queries[order], ranks[order]
        new = np.ones(len(queries), bool)
        new[1:] = queries[1:] != queries[:-1]
        at = np.flatnonzero(new)
        return queries[at], np.diff(np.append(at, len(queries))), self.best[ranks[at]]


class CodePoints:
    """Words as rows of code points, from the front and from the back, padded with zeros to ``WIDTH``."""

    WIDTH = 32

    def __init__(self, words: list[str]) -> None:
        self.lengths = np.array([len(w) for w in words], np.int64).reshape(len(words))
        front = np.zeros((len(words), self.WIDTH), np.uint8)
        back = np.zeros((len(words), self.WIDTH), np.uint8)
        short = np.flatnonzero(self.lengths <= self.WIDTH)
        if len(short):
            codes = np.frombuffer("".join(words[i] for i in short.tolist()).encode("latin-1"), np.uint8)
            sizes = self.lengths[short]
            row = np.repeat(short, sizes)
            place = np.arange(sizes.sum()) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            front[row, place] = codes
            back[row, np.repeat(sizes, sizes) - 1 - place] = codes
        self.front, self.back = front, back

    def one_edit(self, mine: np.ndarray, other: CodePoints, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the pairs (mine[k], theirs[k]): whether they are one edit apart, and which pairs hold a word longer
        than ``WIDTH``, left undecided. One edit apart: not equal, lengths within one, and the common beginning and
        the common end together at least the longer length less one."""
        la, lb = self.lengths[mine], other.lengths[theirs]
        unsure = (la > self.WIDTH) | (lb > self.WIDTH)
        out = np.zeros(len(mine), bool)
        step = 100_000  # pairs at a time, to bound the arrays
        for start in range(0, len(mine), step):
            part = slice(start, start + step)
            same = self.front[mine[part]] == other.front[theirs[part]]
            pre = np.where(same.all(axis=1), self.WIDTH, same.argmin(axis=1))
            same = self.back[mine[part]] == other.back[theirs[part]]
            suf = np.where(same.all(axis=1), self.WIDTH, same.argmin(axis=1))
            x, y = la[part], lb[part]
            out[part] = ~((x == y) & (pre >= x)) & (np.abs(x - y) <= 1) & (pre + suf >= np.maximum(x, y) - 1)
        return out & ~unsure, unsure


def _plans() -> list[tuple[int, int | None, int | None, bool]]:
    """(length change, surplus level or -1 for below, deficit level likewise, Latin-1 words only) of each copy kind."""
    below = [*range(TOP), -1]
    plans = [(0, None, None, True)]
    plans += [(1, up, None, False) for up in below]
    plans += [(-1, None, down, False) for down in below]
    plans += [(0, up, down, False) for up in below for down in below if up != down or up == -1]
    return plans


PLANS = _plans()
_COPY_ARROW = pa.schema([pa.field(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else
                                  pa.int64() if isinstance(f.dataType, T.LongType) else pa.string())
                         for f in _COPY.fields])


def copy_batch(words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """``copies`` of many words at once, made plan by plan with array operations."""
    texts = words.to_pylist()
    v = vectors_of(texts)
    size = np.array([len(w) for w in texts], np.int64)
    latin = v[:, len(ORDER):].any(axis=1)
    parts = [(np.arange(len(texts)), size, v[:, :TOP], 0, 0, 0)]
    for change, up, down, latin_only in PLANS:
        t = v[:, :TOP].copy()
        ok = size + change >= 1
        if latin_only:
            ok &= latin
        if up is not None and up >= 0:
            t[:, up] += 1
        if down is not None and down >= 0:
            ok &= t[:, down] > 0
            t[:, down] -= 1
        rows = np.flatnonzero(ok)
        parts.append((rows, size[rows] + change, t[rows], 1, int(up == -1), int(down == -1)))
    rows = np.concatenate([p[0] for p in parts])
    lengths = np.concatenate([p[1] for p in parts])
    tops = np.concatenate([p[2] for p in parts])
    fill = lambda k: np.concatenate([np.full(len(p[0]), p[k], np.int32) for p in parts])
    index = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(lengths.astype(np.int32)), *[pa.array(tops[:, k].astype(np.int32)) for k in range(TOP)],
         pa.array(fill(3)), words.take(index), pa.array(counts[rows].astype(np.int64)), pa.array(fill(4)),
         pa.array(fill(5))], schema=_COPY_ARROW)


def _copy_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield copy_batch(batch.column("word"), batch.column("n").to_numpy(zero_copy_only=False))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, part and kind: the index rows of a bucket part come before its query copies, which are
    searched in chunks of ``CHUNK`` against the part's trie. Work is done per run of equal keys, not per row."""
    key, index_words, index_counts, bucket = None, [], [], None
    held_words: list[str] = []
    held_s: list[np.ndarray] = []
    held_d: list[np.ndarray] = []

    def flush() -> pa.RecordBatch | None:
        nonlocal held_words, held_s, held_d
        if not held_words:
            return None
        trie = bucket if bucket is not None else Bucket(index_words, index_counts)
        queries, near, rows = trie.nearest(held_words, np.concatenate(held_s), np.concatenate(held_d))
        queries, rows = queries.tolist(), rows.tolist()
        columns = [[held_words[q] for q in queries], near, [trie.words[r] for r in rows], [trie.counts[r] for r in rows]]
        held_words, held_s, held_d = [], [], []
        if not queries:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_FOUND)],
                                          schema=_ARROW_FOUND)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "t0", "t1", "t2", "part")],
                        axis=1)
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        texts = batch.column("word").to_numpy(zero_copy_only=False).tolist()
        counts = batch.column("n").to_numpy(zero_copy_only=False)
        surplus = batch.column("surplus").to_numpy(zero_copy_only=False)
        deficit = batch.column("deficit").to_numpy(zero_copy_only=False)
        changed = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *changed.tolist()], [*changed.tolist(), batch.num_rows]):
            here = tuple(keys[a].tolist())
            if here != key:
                if (out := flush()) is not None:
                    yield out
                key, index_words, index_counts, bucket = here, [], [], None
            if kind[a] == 0:
                index_words.extend(texts[a:b])
                index_counts.extend(counts[a:b].tolist())
                continue
            if bucket is None:
                bucket = Bucket(index_words, index_counts)
            start = a
            while start < b:
                stop = min(b, start + CHUNK - len(held_words))
                held_words.extend(texts[start:stop])
                held_s.append(surplus[start:stop])
                held_d.append(deficit[start:stop])
                start = stop
                if len(held_words) >= CHUNK and (out := flush()) is not None:
                    yield out
    if (out := flush()) is not None:
        yield out


_ARROW_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def words(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``word, n``: the counted words of all texts. Runs are lowered in A-Z only; where the unsigned CRC-32 of
    ``<id>:<run>`` (a null id written as '') is divisible by ``DIVISOR`` the code point at that hash modulo the run's
    length is deleted. Kept: results of at least ``MIN_CHARS`` code points found ``MIN_COUNT`` times or more."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(
        F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + F.lit(2)))
    word = F.when(h % DIVISOR == 0, cut).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= MIN_CHARS) & (F.col("n") >= MIN_COUNT))


def near_words(counted: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``word, n, n_near, best, best_n`` for every counted word: how many words are one edit away, and the one of them
    with the largest count (ties: the least in code-point order; null if none)."""
    spark = counted.sparkSession
    rows = stage(counted.select("word", "n").mapInArrow(_copy_rows, _COPY), "variant-copies")
    key = ["length", *[f"t{k}" for k in range(TOP)]]
    sizes = rows.filter("kind = 0").groupBy(*key).agg(
        F.ceil(F.count("*") / F.lit(bucket_rows)).cast("int").alias("parts"))
    parted = join_lookup(rows, sizes, key, ["word"]).withColumn(
        "part", F.when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))).otherwise(
            F.sequence(F.lit(0), F.col("parts") - 1)))
    parted = parted.select(*key, F.explode("part").alias("part"), "kind", "word", "n", "surplus", "deficit")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = parted.repartition(partitions, *key, "part").sortWithinPartitions(*key, "part", "kind")
    found = dealt.mapInArrow(_search, _FOUND).groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("best_n")).alias("neg"), F.col("best").alias("best"))).alias("b"))
    return counted.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("b.best").alias("best"),
        (-F.col("b.neg")).alias("best_n"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *,
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every counted word of the documents.

    A word's form is its near word of largest count (ties: least in code-point order) if that count is at least
    ``FORM_RATIO`` times its own, else null; ``form_n`` is the form's count or null. ``root`` follows forms to the
    last; a word without a form is its own root. Null texts have no words; an empty table gives no rows; other
    columns are ignored. Forms only point to words of larger count, so the chains end.
    """
    counted = stage(words(docs, id_col, text), "variant-words")
    near = stage(near_words(counted, bucket_rows), "variant-near")
    has_form = F.col("best_n") >= F.col("n") * FORM_RATIO
    table = stage(near.select("word", "n", "n_near", F.when(has_form, F.col("best")).alias("form"),
                              F.when(has_form, F.col("best_n")).alias("form_n")), "variant-forms")
    return table.join(roots(table), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(table: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form, by pointer doubling: each round a word jumps to its pointer's
    pointer, so a chain of length k needs about log2(k) rounds; each round is written before the next."""
    links = stage(table.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("to")), "variant-links")
    while True:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        stepped = links.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"),
                                                         F.col("next").isNotNull().alias("moved"))
        stepped = stage(stepped, "variant-roots")
        if not stepped.filter("moved").limit(1).count():
            return stepped.select("word", F.col("to").alias("root"))
        links = stepped.drop("moved")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: variant groups of the words of all documents."""
    return group_variants(read(spark, sf_dir, "documents"))
