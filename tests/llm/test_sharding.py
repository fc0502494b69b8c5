import zlib
from collections import defaultdict

from lexiloom.llm import sharding

SF = "/root/testdata/sf0.01"


def check(rows, docs, shards):
    assert sorted(r.doc_id or 0 for r in rows) == sorted(i or 0 for i, _ in docs)
    by_id, size, slots = dict(docs), defaultdict(int), defaultdict(list)
    for r in rows:
        text = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "bytes", None) and 0 <= r.shard < shards
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    most = max(r.size for r in rows)
    assert all(abs(b - sum(size.values()) / shards) <= 2 * most for b in size.values())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 24)
    near = defaultdict(set)
    for r in rows:
        near[r.text_crc32].add(r.shard)
    assert sum(len(x) > 1 for x in near.values()) < 24  # equal texts lie side by side


def test_hot_group_and_edges(spark):
    docs = [(i, "the same text") for i in range(4000)] + [(5000 + i, "x" * i) for i in range(300)] + [(9000, None), (9001, ""), (None, "no id")] + [(9002, "twice")] * 3
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, shard int, part int")
    check(sharding.shard(frame).collect(), docs, 24)
    check(sharding.shard(frame, shards=3).collect(), docs, 3)
    assert sharding.shard(frame.limit(0)).collect() == []
