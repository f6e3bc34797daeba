"""The divergence audit against exact arithmetic by hand, and against its DuckDB statement."""

import re
from collections import Counter, defaultdict

import duckdb

from rentalytics.llm.divergence import SQL, audit, query
from tests.llm.data import CLASHING, ROWS, SCHEMA, awkward, empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def by_hand(rows, min_df=3, top=200):
    docs = []
    for text, lang, source in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
        docs.append((lang or "", source or "", TERM.findall(low)))
    out = []
    for lang in sorted({d[0] for d in docs}):
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= min_df)
        v = len(kept)
        count = defaultdict(Counter)
        for _, s, terms in mine:
            count[s].update(t for t in terms if t in df and df[t] >= min_df)
            count[s]  # every group occurs
        for _, s, _ in mine:
            count.setdefault(s, Counter())
        whole = sum(count.values(), Counter())

        def p(c, t):
            return {k: 1 + 10**9 * (c[k] + 1) // (sum(c.values()) + v) for k in kept}

        shares = {s: p(c, None) for s, c in count.items()}
        lang_share = p(whole, None)
        for s in count:
            pairs = [(o, sum((shares[s][k] - shares[o][k]) ** 2 // shares[o][k] for k in kept)) for o in count if o != s]
            terms = [(k, (shares[s][k] - lang_share[k]) ** 2 // lang_share[k]) for k in kept
                     if count[s][k] > 0 and shares[s][k] > lang_share[k]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                for r, (item, value) in enumerate(items[:limit], 1):
                    out.append((lang, s, part, item, value, r))
    return sorted(out)


TEXTS = [
    ("Alpha beta gamma ALPHA délta", "en", "a"), ("alpha beta beta x1y", "en", "b"), ("beta gamma alpha", "en", None),
    ("gamma Délta délta", "en", "a"), (None, "en", "c"), ("", None, "a"), ("uno dos tres", "es", "a"),
    ("uno dos", "es", "a"), ("uno tres", "es", "b"), ("dos uno", "es", "b"), ("alpha beta gamma", "en", "a"),
    ("solo", "fr", "z"), ("solo", "fr", "z"),
]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_exact_arithmetic(spark):
    df = spark.createDataFrame(TEXTS, "text string, lang string, source string")
    assert rows_of(audit(df)) == by_hand(TEXTS)
    assert rows_of(audit(df, min_df=1, top=2)) == by_hand(TEXTS, min_df=1, top=2)


def test_awkward_rows_and_clashing_columns(spark):
    got = rows_of(audit(awkward(spark)))
    assert got == by_hand([(r[1], r[2], r[3]) for r in ROWS])
    assert got == rows_of(audit(awkward(spark, extra=False)))


def test_empty_table(spark):
    assert audit(empty(spark)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(tuple(r) for r in con.execute(f"SELECT lang, source, part, item, value, rank FROM ({SQL})").fetchall())
    assert rows_of(query(spark, sf_dir)) == want


def test_vectorizer_counts_agree(spark):
    from rentalytics.llm.divergence import group_counts, term_lists, vectorizer_counts

    for df in (spark.createDataFrame(TEXTS, "text string, lang string, source string"), awkward(spark)):
        lists = term_lists(df)
        counts, _ = group_counts(lists)
        assert sorted(map(tuple, counts.select("lang", "source", "term", "c").collect())) == sorted(
            map(tuple, vectorizer_counts(lists).collect()))


def test_terms_of_bytes_and_partial_counts():
    """One pass over a batch's bytes: terms as the pattern finds them, places and documents counted together."""
    import pyarrow as pa

    from rentalytics.llm.divergence import count_terms, term_array

    texts = ["", "Alpha\x00beta BETA", "gÖteborg×x", "", "\U0001f600  z9Z", "beta", "[a]`b`{c}~\x7fD@"]
    low = [TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for t in texts]
    for begin in (0, 2, 6):
        terms, sizes = term_array(pa.array(texts)[begin:])
        assert terms.to_pylist() == [t for found in low[begin:] for t in found]
        assert sizes.tolist() == [len(found) for found in low[begin:]]
    assert term_array(pa.array([], pa.string()))[0].to_pylist() == []
    langs, sources = ["en", "en", "de", "en", "de", "en", "en"], ["a", "b", "a", "a", "a", "b", "a"]
    rows = list(zip(langs, sources, low)) * 2
    want = Counter((g, s, t) for g, s, found in rows for t in found)
    docs = Counter((g, s, t) for g, s, found in rows for t in set(found))
    batch = pa.RecordBatch.from_pydict({"lang": langs * 2, "source": sources * 2, "text": texts * 2})
    got = count_terms(batch).to_pylist()
    assert {(r["lang"], r["source"], r["term"]): (r["c"], r["df"]) for r in got} == {k: (want[k], docs[k]) for k in want}
    assert len(got) == len(want)
    assert count_terms(batch.slice(0, 0)).num_rows == 0


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from rentalytics.llm.divergence import NARROW, share

    rows = [(0, 1, 1), (NARROW - 2, NARROW - 2, 1), (NARROW, NARROW + 7, 5), (10**15, 3 * 10**15, 11)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(
        "c", "n", "v", share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // (r.n + r.v) for r in got)
