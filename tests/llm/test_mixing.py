from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rentalytics.llm.common import n_words
from rentalytics.llm.mixing import _duels, fill_targets, mix, mixed_rows, query
from tests.llm.data import WORD, awkward, documents, empty

WEIGHTS = (3, 1, 2)


def expected_targets(sizes: dict, share: float = 1.5, cap: float = 2.0) -> dict:
    """Shares by weight, the excess over the cap shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    open_, left = set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= cap * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_query_meets_targets(spark, sf_dir):
    texts = {r.doc_id: r for r in documents(spark, sf_dir).collect()}
    out = query(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == Counter(texts.keys())
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        source = texts[r.doc_id].source
        assert r.size == len(WORD.findall(texts[r.doc_id].text or ""))
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[source] += r.size
        taken[source] += r.taken
        longest[source] = max(longest[source], r.size)
    target = expected_targets(sizes)
    for r in out:
        source = texts[r.doc_id].source
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(target[source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] + 1


def test_reruns_and_partitionings_agree(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "source", "text")
    one = mix(rows, n_words(F.col("text")), "source", weights=WEIGHTS)
    two = mix(rows.repartition(7), n_words(F.col("text")), "source", weights=WEIGHTS)
    assert sorted(one.select("doc_id", "copies").collect()) == sorted(two.select("doc_id", "copies").collect())


def test_tree_of_small_leaves(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 2).cast("string").alias("source"), (F.col("id") % 50 + 1).alias("size_"))
    out = mix(rows, F.col("size_"), "source", weights=(1, 2), share=1.2, leaf_rows=40, fan_in=4).collect()
    for s in "01":
        own = [r for r in out if r.source == s]
        assert len(own) == 1500
        assert sum(r.copies * r.size for r in own) == pytest.approx(own[0].target, abs=51)


def test_expectation_is_kept():
    """Over many draws a row's mean number of copies is its probability."""
    size, p = np.array([5, 3, 8, 2, 7, 4]), np.array([0.3, 0.8, 0.5, 0.1, 0.6, 0.45])
    total = np.zeros(6)
    for seed in range(4000):
        pdf = pd.DataFrame({"tag": "t", "node": 0, "h1": np.arange(6), "h2": np.arange(6) * 7919, "at": np.arange(6),
                            "size": size, "p": p, "now": p})
        out = _duels(pdf, seed * 1_000_003 + 17, True)
        total += out.sort_values("at")["x"].to_numpy(float)
        assert set(out["x"]) <= {0, 1}
    assert np.abs(total / 4000 - p).max() < 0.04


def test_awkward_rows(spark):
    out = mix(awkward(spark).drop("size", "target", "copies"), n_words(F.col("text")), "source", weights=WEIGHTS)
    rows = out.collect()
    assert len(rows) == 11 and out.columns[-4:] == ["size", "source_size", "target", "copies"]
    assert all(r.row == "own row" and 0 <= r.copies <= 2 for r in rows)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}


def test_repeated_rows_share_copies(spark):
    rows = spark.createDataFrame([(1, "a", 10)] * 6 + [(2, "b", 40)], "id long, source string, words long")
    out = mix(rows, F.col("words"), "source", weights=(1, 1)).collect()
    own = [r.copies for r in out if r.source == "a"]
    assert len(own) == 6 and max(own) - min(own) <= 1


def test_empty_table_and_rows_back(spark):
    assert mix(empty(spark), n_words(F.col("text")), "source", weights=WEIGHTS).count() == 0
    back = mixed_rows(awkward(spark), n_words(F.col("text")), "source", weights=WEIGHTS)
    assert back.columns == awkward(spark).columns
    assert back.count() > 0


def test_targets_with_all_capped(spark):
    df = spark.createDataFrame([("a", 10, 1.0), ("b", 5, 1.0)], "tag string, source_size long, weight double")
    assert {r.tag: r.target for r in fill_targets(df, 100, 2.0).collect()} == {"a": 20.0, "b": 10.0}
