from collections import Counter

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from rentalytics.llm.secrets import base_spans, guessed_spans
from rentalytics.runtime import stage
from tests.llm.data import WORD
from tests.llm.test_jaccard_join import by_hand
from tests.llm.test_packing import check_ids, check_pieces, plain_ids
from tests.llm.test_quality import base_by_hand


def test_every_operator_is_registered():
    names = queries()
    assert "pipeline" in names
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(oracle_sql()) <= set(names)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, table = docs.columns, [docs]
    for _, apply in corpus_pipeline.STAGES:
        table.append(stage(apply(spark, table[-1], sf_dir), "test-stage"))
    given, good, distinct, clean, mixed, packed = table
    assert all(t.columns == columns for t in (good, distinct, clean, mixed))

    texts = {r.doc_id: r for r in given.collect()}
    kept = {r.doc_id for r in good.collect()}
    for d, r in texts.items():
        n = base_by_hand(r.text)
        if n[0] < 10 or 100 * n[4] > 20 * n[0]:
            assert d not in kept
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = [(d in kept) == bool(q) for d, q in marks.items() if base_by_hand(texts[d].text)[0] >= 10]
    assert sum(right) >= 0.95 * len(right)

    left = {c for _, c, _ in by_hand([(d, texts[d].text) for d in sorted(kept)])}
    assert {r.doc_id for r in distinct.collect()} == left

    after = {r.doc_id: r for r in clean.collect()}
    assert set(after) == left
    for d, r in after.items():
        spans = [*base_spans(texts[d].text), *guessed_spans(texts[d].text)]
        assert (r.text == texts[d].text) == (not spans)
        assert not base_spans(r.text) and (not spans or r.n_chars == len(r.text))

    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= left and max(copies.values()) <= 2
    words = {d: len(WORD.findall(r.text)) for d, r in after.items()}
    assert abs(sum(copies[d] * words[d] for d in copies) - 1.5 * sum(words.values())) < 0.1 * sum(words.values())

    rows = packed.collect()
    once = {d for d, n in copies.items() if n == 1}
    check_ids([r for r in rows if r.doc_id in once], {d: plain_ids(after[d].text) for d in once})
    assert sum(r.length for r in rows) == sum(n * len(plain_ids(after[d].text)) for d, n in copies.items())
    assert check_pieces(rows, {}) < 0.05


def test_run_on_an_empty_table(spark, tmp_path):
    from tests.llm.data import empty, labels

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
