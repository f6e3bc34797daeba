import numpy as np
import pytest

from rentalytics.llm import classifier, quality_rules
from rentalytics.llm.common import windows, word_hashes
from tests.llm.data import LONG, WORD, awkward, documents, empty, labels

SF = "/root/testdata/sf0.01"  # labels enough to learn from


def base_by_hand(text: str) -> tuple:
    words = WORD.findall(text)
    runs = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    marked = set()
    for i, run in enumerate(runs):
        if runs.count(run) > 1:
            marked |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


@pytest.mark.parametrize("text", [
    "", " ", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n\n\nx y", "#a|b <c> 文 ü\U0001f600", "a b c d",
    "a b c d e f a b c d e g a b c d e f", "a\x0bb\x0cc\x1cd e", "\n\n \n",
])
def test_base_counts(text):
    assert quality_rules.base_counts(text) == base_by_hand(text)


def test_base_counts_of_documents(spark, sf_dir):
    for r in documents(spark, sf_dir).limit(60).collect():
        if len(r.text) < 8000:
            assert quality_rules.base_counts(r.text) == base_by_hand(r.text)


def test_rules_separate_labelled_documents(spark):
    out = {r.doc_id: r for r in quality_rules.query(spark, SF).collect()}
    assert len(out) == 1000
    marks = spark.read.parquet(f"{SF}/labels.parquet").collect()
    kept = [out[m.doc_id].kept == bool(m.quality) for m in marks if not out[m.doc_id].base_failed]
    assert np.mean(kept) > 0.97
    for r in out.values():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_classifier_on_held_out_rows(spark):
    out = {r.doc_id: r for r in classifier.query(spark, SF).collect()}
    assert len(out) == 1000
    import zlib

    right = []
    for m in spark.read.parquet(f"{SF}/labels.parquet").collect():
        r = out[m.doc_id]
        assert r.held_out == (zlib.crc32(str(m.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.predicted == m.quality)
    assert len(right) > 50 and np.mean(right) > 0.93


def test_factorisation_identity():
    """The linear-time sum equals the sum over all pairs."""
    rng = np.random.default_rng(1)
    width = (1 << classifier.BITS) + len(classifier.STATISTICS)
    m = classifier.Model(0.0, rng.normal(size=width), rng.normal(size=(width, classifier.FACTORS)),
                         np.zeros(len(classifier.STATISTICS)), np.ones(len(classifier.STATISTICS)))
    index, value, starts, stats = classifier.features(["one two two three", "", "x"], np.array([17.0, 0, 1]))
    dense = m.standard(stats)
    z, _ = classifier._sums(m, index, value, starts, dense)
    for t in range(3):
        at = [*index[starts[t]:starts[t + 1]], *range(1 << classifier.BITS, width)]
        x = [*value[starts[t]:starts[t + 1]], *dense[t]]
        want = sum(m.w[i] * a for i, a in zip(at, x))
        want += sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert z[t] == pytest.approx(want)


@pytest.mark.parametrize("with_labels", [True, False])
def test_awkward_rows(spark, with_labels):
    docs = awkward(spark)
    marks = labels(spark) if with_labels else labels(spark).filter("false")
    out = quality_rules.judge(docs, "text", quality_rules.train(docs, marks, "doc_id", "text")).collect()
    assert len(out) == 11 and all(r.row == "own row" for r in out)
    by_id = {r.doc_id: r for r in out}
    assert all(by_id[i].base_failed and not by_id[i].kept and by_id[i].n_words == 0 for i in (2, 3, 4))
    assert by_id[5].n_words == len(WORD.findall(LONG))
    model = classifier.train(docs, marks, "doc_id", "text", "n_chars")
    scored = classifier.score(docs, "text", "n_chars", model).collect()
    assert len(scored) == 11 and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id == 6}) == 1


def test_empty_tables(spark):
    docs = empty(spark)
    assert quality_rules.judge(docs, "text", quality_rules.train(docs, labels(spark), "doc_id", "text")).count() == 0
    model = classifier.train(docs, labels(spark), "doc_id", "text", "n_chars")
    assert classifier.score(docs, "text", "n_chars", model).count() == 0


def test_word_hashes_and_windows():
    texts = ["a b c", "", "  c\tb  a ", "a b c d e f", "größe"]
    hashes, bounds = word_hashes(texts)
    words = [WORD.findall(t) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len({*hashes.tolist()}) == len({*flat})
    assert all((x == y) == (a == b) for x, a in zip(hashes, flat) for y, b in zip(hashes, flat))
    found, begins = windows(hashes, bounds, 3)
    assert np.diff(begins).tolist() == [1, 0, 1, 4, 1]
    assert found[0] == found[2] and found[0] != found[1]
