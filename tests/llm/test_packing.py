import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rentalytics.llm.packing import WINDOW, cuts, divide, pack, query, windows_of
from rentalytics.llm.tokens import default_tokenizer, encoder
from tests.llm.data import LONG, awkward, documents, empty


def plain_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_ids(rows, ids_of):
    """Each id of the documents in exactly one piece."""
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            piece = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(piece))
            at += r.length
        assert at == len(ids)


def check_pieces(rows, ids_of):
    """Whole documents, offsets without gaps, no sequence above the window. Returns padding per token."""
    check_ids(rows, ids_of)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= WINDOW
        padding += 0 if at & (at - 1) == 0 else WINDOW - at
    return padding / sum(r.length for r in rows)


def test_query_round_trip(spark, sf_dir):
    docs = {r.doc_id: plain_ids(r.text) for r in documents(spark, sf_dir).collect()}
    assert check_pieces(query(spark, sf_dir).collect(), docs) < 0.03


def test_padding_at_a_larger_scale(spark):
    rows = query(spark, "/root/testdata/sf0.01").collect()
    assert check_pieces(rows, {}) < 0.01


@pytest.mark.parametrize("text", [
    "It's  we'll\u00a0go\u2003NOW", "ÉTÉ e\u0301 ΣΑΣ", "a\x1cb\x85c\u2028d", "<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|> A<|b", "Word, word!! (Word) <b>|x|", "123 4.5 —!?", "\ufeffx",
    "!" * 100, "a" * 300, "\U0001f600\U0001f468\u200d\U0001f469 ok",
])
def test_words_encode_as_the_whole_text(text):
    raw = encoder(default_tokenizer())([text])[0]
    assert np.frombuffer(raw, "<u4").tolist() == plain_ids(text)[:-1]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_a_whole(text):
    raw = encoder(default_tokenizer())([text])[0]
    assert np.frombuffer(raw, "<u4").tolist() == plain_ids(text)[:-1]


def test_differencing_beats_the_bound():
    assert sorted(np.bincount(divide(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) in ([14, 16], [15, 15])
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 500, 2000)
    sums = np.bincount(divide(sizes, 40), sizes, 40)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 5
    bins = windows_of(sizes)
    assert np.bincount(bins, sizes).max() <= WINDOW


@given(st.lists(st.integers(1, 2047), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_no_window_overflows(sizes):
    sizes = np.array(sizes)
    bins = windows_of(sizes)
    assert np.bincount(bins, sizes).max() <= WINDOW and len(bins) == len(sizes)


def test_cuts_cover_the_document():
    for n in (1, 511, 512, 513, 2047, 2048, 2049, 5000):
        assert sum(cuts(n)) == n and max(cuts(n)) <= WINDOW


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = pack(docs, "text", ["doc_id", "row"]).collect()
    assert {r.row for r in rows} == {"own row"}
    ids = {1: plain_ids("the quick brown fox jumps over the lazy dog and runs away"), 2: [1], 3: [1], 4: [1],
           5: plain_ids(LONG), 9: plain_ids("x")}
    check_ids(rows, ids)
    check_pieces(rows, {})
    for doc, want in ids.items():
        assert sum(r.length for r in rows if r.doc_id == doc) == len(want)
    assert sum(r.length for r in rows if r.doc_id == 6) == 2 * len(ids[1])
    assert sum(r.doc_id is None for r in rows) == 1
    assert pack(empty(spark), "text", ["doc_id"]).count() == 0


def test_kept_ids_are_the_pieces(spark):
    rows = pack(awkward(spark), "text", ["doc_id"], keep_ids=True, group_pieces=5).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    sums = defaultdict(int)
    for r in rows:
        sums[r.sequence_id] += r.length
    assert max(sums.values()) <= WINDOW
