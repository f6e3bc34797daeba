import numpy as np
import pytest

from rentalytics.llm.tokens import default_tokenizer, encoder
from rentalytics.llm.training_order import CONTEXT, materialise, permute, query, read_shards, write_shards
from tests.llm.data import awkward, documents, empty


def ids_of(text):
    return [*np.frombuffer(encoder(default_tokenizer())([text or ""])[0], "<u4").tolist(), 1]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    slots = permute(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 100:
        assert permute(np.arange(n), n, 8).tolist() != slots.tolist()
        assert np.mean(np.abs(np.diff(slots))) > n / 5  # neighbours are torn apart


def decoded(record, n_ids):
    raw = bytes(record)
    assert int.from_bytes(raw[:4], "little") == n_ids and len(raw) == 4 + 2 * CONTEXT
    assert not any(raw[4 + 2 * n_ids:])
    return np.frombuffer(raw[4:4 + 2 * n_ids], "<u2").tolist()


def test_query_round_trip(spark, sf_dir):
    docs = {r.doc_id: ids_of(r.text) for r in documents(spark, sf_dir).collect()}
    rows = query(spark, sf_dir).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    back = {}
    for r in sorted(rows, key=lambda r: r.start):
        back.setdefault(r.doc_id, []).extend(decoded(r.record, r.n_ids))
        assert r.byte_offset == r.slot % ((32 << 20) // 1028) * 1028
    assert back == docs


def test_shards_are_written_and_resumed(spark, sf_dir, tmp_path):
    options = {"context": 64, "shard_bytes": 132 * 50}
    records = materialise(documents(spark, sf_dir), "text", ["doc_id"], **options)
    manifest = write_shards(records, f"file://{tmp_path}/out").collect()
    rows = sorted(records.select("slot", "n_ids", "record").collect())
    assert sum(m.records for m in manifest) == len(rows)
    assert all(m.first_slot == 50 * m.shard and m.bytes == 132 * m.records for m in manifest)
    files = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert files == [f"shard-{k:06d}.bin" for k in range(len(manifest))]
    for start in (0, 77, len(rows) - 1):
        got = sorted((r.slot, r.ids) for r in read_shards(spark, f"file://{tmp_path}/out", from_slot=start, **options).collect())
        assert [s for s, _ in got] == list(range(start, len(rows)))
        for slot, ids in got[:40]:
            raw = bytes(rows[slot].record)
            assert ids == np.frombuffer(raw[4:4 + 2 * rows[slot].n_ids], "<u2").tolist()


def test_awkward_rows(spark):
    rows = materialise(awkward(spark), "text", ["doc_id", "slot"], wide=True).collect()
    assert sorted({r.doc_id for r in rows}, key=str) == sorted([1, 2, 3, 4, 5, 6, 7, 8, 9, None], key=str)
    assert [r.n_ids for r in rows if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert sum(r.doc_id == 6 for r in rows) == 2
    assert materialise(empty(spark), "text", ["doc_id"]).count() == 0
