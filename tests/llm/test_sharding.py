import zlib
from collections import Counter

from demandlens.llm.sharding import shard


def jump(key, shards):
    """The published loop."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_odd_documents(odd_docs, no_docs):
    found = shard(odd_docs, 5).collect()
    assert len(found) == odd_docs.count() and shard(no_docs, 5).count() == 0
    for r in found:
        assert r.shard == jump(r.doc_id or 0, 5) and r.grown_shard == jump(r.doc_id or 0, 6) and r.law == "key"
    wanted = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == wanted


def test_slots_have_no_gaps_and_growth_moves_rows_to_the_new_shard_only(spark):
    ids = [*range(-500, 3000), 2**62, -(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    found = shard(docs, 40).collect()
    slots = {}
    for r in found:
        assert r.shard == jump(r.doc_id, 40) and r.grown_shard == jump(r.doc_id, 41)
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 40
