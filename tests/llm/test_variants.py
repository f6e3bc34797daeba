"""Spelling variants against a brute-force search over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rentalytics.llm.variants import Bucket, copies, group_variants, one_edit, vector
from tests.llm.data import ROWS, awkward, empty

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def counted_by_hand(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def lev1(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1] == 1


def by_hand(rows):
    n = counted_by_hand(rows)
    out = {}
    for w in n:
        near = [x for x in n if lev1(w, x)]
        best = min(near, key=lambda x: (-n[x], x)) if near else None
        form = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [form, None, n[w], len(near), n[form] if form else None]
    for w, r in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        r[1] = root
    return sorted((w, *r) for w, r in out.items())


def near_by_trie(words):
    from collections import defaultdict
    buckets = defaultdict(list)
    queries = []
    for w in words:
        for row in copies(w, 1):
            key = row[:4]
            (buckets[key] if row[4] == 0 else queries).append(row)
    built = {k: Bucket([r[5] for r in v], [1] * len(v)) for k, v in buckets.items()}
    found = Counter()
    for q in queries:
        b = built.get(q[:4])
        if b is not None:
            found[q[5]] += b.near([q[5]], np.array([q[7]]), np.array([q[8]]))[0][0]
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abeiqxàáéÿ", min_size=1, max_size=6), min_size=1, max_size=25, unique=True))
def test_trie_finds_every_near_word_once(words):
    found = near_by_trie(words)
    for w in words:
        assert found[w] == sum(lev1(w, x) for x in words), w


def test_one_edit():
    assert one_edit("kitten", "kitte") and one_edit("kitten", "sitten") and one_edit("kitten", "kittens")
    assert not one_edit("kitten", "kitten") and not one_edit("kitten", "sittes") and not one_edit("ab", "ba")
    assert list(vector("eeà")[:2]) == [2, 0]


def fixture():
    rnd = random.Random(7)
    base = ["colour", "organise", "organize", "behaviour", "behavior", "travelled", "traveled", "programme", "ÉCOLEÀ"]
    rows = []
    for i in range(300):
        words = [rnd.choice(base) + rnd.choice(["", "s", "d", "x"]) for _ in range(rnd.randint(0, 30))]
        if i % 3 == 0:
            words += ["organizes"] * 12 + ["orgnizes", "organizesz", "Organizes"]
        rows.append((i if i % 50 else None, " ".join(words) + " ÿaaaaaaa ÿaaaaaab"))
    rows += [(999, None), (1000, ""), (1001, "a" * 5000 + " " + "a" * 5000)]
    return rows


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_hand(rows)
    assert any(r[1] for r in want) and any(r[1] != r[2] for r in want if r[1])
    assert rows_of(group_variants(df)) == want
    assert rows_of(group_variants(df, bucket_rows=3)) == want


def test_awkward_and_empty(spark):
    assert rows_of(group_variants(awkward(spark))) == by_hand([(r[0], r[1]) for r in ROWS])
    assert group_variants(empty(spark)).count() == 0


def test_copies_in_arrays_equal_the_rule():
    import pyarrow as pa

    from rentalytics.llm.variants import copy_batch

    rnd = random.Random(1)
    words = ["".join(rnd.choice("abeiqxàé") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    got = sorted(tuple(r.values()) for r in copy_batch(pa.array(words), np.arange(300)).to_pylist())
    assert got == sorted(c for i, w in enumerate(words) for c in copies(w, i))


def test_trie_of_children_against_all_pairs():
    """Every word against one bucket by every budget: counts above all of the bucket, levels without a letter, long
    words, ties of the best; leaves are gathered from the places of children alone."""
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("fgÿé") for _ in range(rng.randint(7, 9))) for _ in range(400)}
                   | {"f" * 40, "f" * 39 + "g", "g" * 12})
    counts = [rng.randint(2, 4) for _ in words]
    bucket = Bucket(words, counts)
    assert [c is None for c in bucket.children] == bucket.empty and not all(bucket.empty)
    asked = [*words, "f" * 41, "zzzzzzz", "g" * 13]
    for s, d in ((0, 0), (1, 0), (0, 1), (1, 1)):
        found = bucket.near(asked, np.full(len(asked), s), np.full(len(asked), d))
        for word, (n, best, best_n) in zip(asked, found):
            near = []
            for other, count in zip(words, counts):
                gap = vector(other)[3:] - vector(word)[3:]
                if sorted(gap[gap != 0].tolist()) == [-1] * d + [1] * s and one_edit(word, other):
                    near.append((-count, other))
            assert (n, best, best_n) == ((len(near), min(near)[1], -min(near)[0]) if near else (0, None, -1))
