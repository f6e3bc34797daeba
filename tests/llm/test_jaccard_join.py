import random
from collections import defaultdict
from itertools import combinations

from rentalytics.llm.jaccard_join import band_plan, components, keep_one, query, similar
from tests.llm.data import WORD, awkward, documents, empty


def by_hand(docs, threshold=0.8):
    """(class, links) per position, by comparing all pairs of word-window sets."""
    sets = []
    for _, text in docs:
        w = WORD.findall(text or "")
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, links = list(range(len(docs))), [0] * len(docs)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a == b or len(a & b) >= threshold * len(a | b):
            links[i] += 1
            links[j] += 1
            root[max(top(i), top(j))] = min(top(i), top(j))
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[top(i)].append(docs[i][0])
    least = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return sorted(((d, least[top(i)], links[i]) for i, (d, _) in enumerate(docs)), key=str)


def found(df):
    return sorted(((r[0], r.class_id, r.n_links) for r in df.collect()), key=str)


def test_query_against_all_pairs(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    assert found(query(spark, sf_dir)) == by_hand(docs)


def near_copies(n, words=60, changes=(0, 1, 1, 2, 3)):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.choice(changes)):
            t[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(t))
    return out


def test_group_of_near_copies_in_small_blocks(spark):
    """A bucket over many blocks: every link counted once, whatever the blocks."""
    docs = [(i, t) for i, t in enumerate(near_copies(120))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = by_hand(docs)
    assert found(similar(df, "doc_id", "text", block_ngrams=3_000)) == want
    assert found(similar(df, "doc_id", "text")) == want


def test_recall_at_the_threshold():
    for recall in (0.9, 0.9995, 0.9999):
        bands, rows = band_plan(0.8, recall)
        assert 1 - (1 - 0.8 ** rows) ** bands >= recall and bands * rows <= 128


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 101), (7, 7), (200, 201)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[i] == 1 for i in range(2, 41))
    assert out[100] == out[101] == 50 and out[201] == 200 and 1 not in out


def test_awkward_rows(spark):
    df = awkward(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert found(similar(df, "doc_id", "text")) == by_hand(docs)
    kept = keep_one(df, "doc_id", "text")
    rows = kept.collect()
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 2, 5, None, 7, 8, 9], key=str)
    assert similar(empty(spark), "doc_id", "text").count() == 0
    assert keep_one(empty(spark), "doc_id", "text").count() == 0


def test_short_texts_have_one_gram(spark):
    docs = [(1, "a b c"), (2, "a b c"), (3, "a b"), (4, "a b c d"), (5, " a  b\nc ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(similar(df, "doc_id", "text")) == by_hand(docs)


def test_keep_one_keeps_one_of_each_group(spark, sf_dir):
    docs = documents(spark, sf_dir)
    classes = {d: c for d, c, _ in by_hand([(r.doc_id, r.text) for r in docs.collect()])}
    assert sorted(r.doc_id for r in keep_one(docs, "doc_id", "text").collect()) == sorted(set(classes.values()))
