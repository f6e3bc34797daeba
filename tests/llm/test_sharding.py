import zlib
from collections import Counter, defaultdict

import xxhash

from rentalytics.llm.sharding import query, shard_rows
from tests.llm.data import awkward, documents, empty


def jump(key: int, shards: int) -> int:
    """The published algorithm in whole numbers."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_query_against_the_algorithm(spark, sf_dir):
    docs = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    slots = defaultdict(list)
    rows = query(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    for r in rows:
        key = xxhash.xxh64(r.doc_id.to_bytes(8, "little", signed=True), seed=42).intdigest()
        text = (docs[r.doc_id] or "").encode()
        assert (r.shard, r.grown_shard) == (jump(key, 40), jump(key, 41))
        assert (r.size, r.text_crc32, r.law) == (len(text) + 16, zlib.crc32(text), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_appending_moves_into_the_new_shard_only(spark):
    ids = spark.range(5000)
    before = {r.id: r for r in shard_rows(ids, ["id"], 9).collect()}
    after = {r.id: r.shard for r in shard_rows(ids, ["id"], 10).collect()}
    moved = [i for i in before if before[i].shard != after[i]]
    assert all(after[i] == 9 for i in moved) and 350 < len(moved) < 650
    assert all(before[i].grown_shard == after[i] for i in before)


def test_ranges_do_not_change_slots(spark):
    ids = spark.range(3000)
    one, many = shard_rows(ids, ["id"], 3), shard_rows(ids, ["id"], 3, range_rows=50)
    assert sorted(one.collect()) == sorted(many.collect())


def test_awkward_rows(spark):
    df = awkward(spark).drop("shard", "slot")
    out = shard_rows(df, ["doc_id"], 5)
    rows = out.collect()
    assert len(rows) == 11 and out.columns == [*df.columns, "shard", "grown_shard", "slot"]
    twice = [r for r in rows if r.doc_id == 6]
    assert twice[0].shard == twice[1].shard and twice[0].slot != twice[1].slot
    assert sum(r.doc_id is None for r in rows) == 1
    assert shard_rows(empty(spark), ["doc_id"], 5).count() == 0
