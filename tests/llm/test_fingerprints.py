import hashlib

import numpy as np

from rentalytics.llm.features import code_points
from rentalytics.llm.common import mix64
from rentalytics.llm.fingerprints import (
    compare_with_next, edited, fingerprint, fingerprints, likeness, next_level, query, with_next,
)
from tests.llm.data import LONG, awkward, documents, empty


def check_neighbours(docs: dict, rows) -> None:
    """Rows against the contract, spelled out over sorted ids."""
    order = sorted(docs, reverse=True)
    rows = {r[0]: r for r in rows}
    assert len(rows) == len(docs)
    for k, doc in enumerate(order):
        text, following = docs[doc] or "", docs[order[(k + 1) % len(order)]] or ""
        n = len(text) // 3
        changed = text[:len(text) - n] + following[:n]
        r = rows[doc]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        own, other, after = (fingerprints([t])[0] for t in (text, changed, following))
        assert (r.fingerprint, r.edited_fingerprint) == (own, other)
        assert (r.near_edited, r.near_next) == (likeness(own, other), likeness(own, after))


def test_query_against_brute_force(spark, sf_dir):
    check_neighbours({r.doc_id: r.text for r in documents(spark, sf_dir).collect()}, query(spark, sf_dir).collect())


def test_neighbours_over_many_buckets(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    placed = with_next(docs, "doc_id", "text", rows_per_bucket=7).collect()
    order = sorted({(r.bucket, r.ahead, -r.id) for r in placed})
    own = [-i for _, ahead, i in order if not ahead]
    assert own == sorted(own, reverse=True) and len(own) == 200
    for b in {r.bucket for r in placed}:
        last = min(r.id for r in placed if r.bucket == b and not r.ahead)
        assert [r.id for r in placed if r.bucket == b and r.ahead] == [last - 1 if last else 199]


def test_equal_stretches_share_names():
    """Interior names of a text do not depend on where it stands."""
    core = "Reouha the of heblee ndonou the shre onthon of thth ansthe " * 3 + "erwhat is it then " * 5
    for pre in ("", "x", "some other words before ", "aaaaaaa"):
        sets = []
        for t in (core, pre + core):
            points, bounds = code_points([t])
            x = mix64(points.astype(np.uint64) + np.uint64(1))
            for _ in range(2):
                x, bounds = next_level(x, bounds)
            sets.append(set(x.tolist()))
        assert len(sets[0] - sets[1]) <= 4


def test_phrases_cover_texts_and_are_bounded():
    texts = ["", "a", "ab", "aaaaaaaaaa", "abababababab", "the cat sat on the mat " * 20, "", "z" * 5000 + "y"]
    points, bounds = code_points(texts)
    x = mix64(points.astype(np.uint64) + np.uint64(1))
    names, begins = next_level(x, bounds)
    sizes = np.diff(begins)
    assert begins[-1] == len(names)
    assert [bool(s) for s in sizes] == [bool(t) for t in texts]
    assert sizes[3] == 1 and sizes[5] <= len(texts[5]) / 1.8
    alone = [next_level(mix64(code_points([t])[0].astype(np.uint64) + np.uint64(1)), np.array([0, len(t)]))[0] for t in texts]
    assert np.array_equal(names, np.concatenate(alone))  # a text's names do not depend on its batch


def test_likeness():
    a, b = fingerprints([LONG[:5000], LONG[200_000:205_000]])
    assert likeness(a, a) == 1 and likeness("", "") == 1 and likeness(a, "") == 0
    near = fingerprints([LONG[:4900] + "and another end of it"])[0]
    assert likeness(a, near) > 0.85 > 0.3 > likeness(fingerprints(["der Hund läuft"])[0], a)
    assert fingerprints([LONG])[0] == fingerprints([LONG])[0]
    assert edited("abcdef", "XYZ") == "abcdXY" and edited("abcdef", "X") == "abcdX" and edited("ab", "X") == "ab"


def test_awkward_rows(spark):
    df = awkward(spark)
    out = fingerprint(df, "text")
    rows = out.collect()
    assert len(rows) == 11 and out.columns == [*[c for c in df.columns if c != "fingerprint"], "fingerprint"]
    assert all((r.fingerprint == "") == (not r.text) for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 6)}) == 1
    next_rows = compare_with_next(df, "doc_id", "text").collect()
    assert len(next_rows) == 11
    assert sum(r.id is None for r in next_rows) == 1
    unique = df.filter("doc_id is not null and doc_id <> 6")
    check_neighbours({r.doc_id: r.text for r in unique.collect()}, compare_with_next(unique, "doc_id", "text").collect())
    check_neighbours({1: "only one text"}, compare_with_next(spark.createDataFrame([(1, "only one text")], "doc_id long, text string"),
                                                            "doc_id", "text").collect())
    assert compare_with_next(empty(spark), "doc_id", "text").count() == 0
    assert fingerprint(empty(spark), "text").count() == 0


def test_labels_are_those_of_the_rule():
    """Labels by table against the rule taken bit by bit, with texts that begin anywhere and equal neighbours."""
    import random

    import numpy as np

    from rentalytics.llm.fingerprints import _NEXT_COIN, _coin_labels

    rng = random.Random(7)
    x = [rng.choice([0, 1, 2**63, 2**64 - 1, rng.getrandbits(64), rng.getrandbits(3)]) for _ in range(3_000)]
    first = [i == 0 or rng.random() < 0.1 for i in range(len(x))]
    want = x
    for _ in range(3):
        d = [1 if f else a ^ b for f, a, b in zip(first, want, [0, *want])]
        low = [(v & -v).bit_length() - 1 for v in d]
        want = [0 if not v else 2 * k + (a >> k & 1) for v, k, a in zip(d, low, want)]
    got = _coin_labels(np.array(x, np.uint64), np.array(first))
    assert got.tolist() == want
    assert _NEXT_COIN.size == 128 * 128 and _NEXT_COIN.dtype == np.uint8
    assert _coin_labels(np.zeros(0, np.uint64), np.zeros(0, bool)).size == 0
