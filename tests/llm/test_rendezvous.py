import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from cachescope.llm import rendezvous

from .helpers import EDGES, edges, empty, frame


def test_growth_moves_rows_only_into_the_new_shard(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(4000)])
    rows = rendezvous.assign(docs, [1.0] * 16, grown_weights=[1.0] * 17).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(r.grown_shard == 16 for r in moved)
    assert 4000 / 17 * 0.7 < len(moved) < 4000 / 17 * 1.3
    assert max(Counter(r.shard for r in rows).values()) < 4000 / 16 * 1.4


def test_slots_are_gapless_and_the_same_for_any_partitioning(spark):
    rows = [(i, f"text {i % 40}") for i in range(700)]
    one = rendezvous.assign(frame(spark, rows, 1), [1.0] * 4, buckets=8)
    other = rendezvous.assign(frame(spark, rows[::-1], 7), [1.0] * 4, buckets=8)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    for _, slots in one.groupBy("shard").agg(F.collect_list("slot")).collect():
        assert sorted(slots) == list(range(len(slots)))


def test_shard_is_the_smallest_weighted_score(spark):
    import struct

    import xxhash

    def hashed(key, shard):  # columns: not null, key, shard, each with the hash so far as its seed
        h = xxhash.xxh64(struct.pack("<i", 0), seed=42).intdigest()
        h = xxhash.xxh64(struct.pack("<q", key), seed=h).intdigest()
        return xxhash.xxh64(struct.pack("<i", shard), seed=h).intdigest()

    weights = [1.0, 2.0, 5.0]
    for r in rendezvous.assign(frame(spark, [(i, "x") for i in range(60)]), weights).collect():
        score = [-math.log(((hashed(r.doc_id, i) >> 12) + 0.5) / 2**52) / w for i, w in enumerate(weights)]
        assert r.shard == score.index(min(score))


def test_edges(spark):
    rows = rendezvous.assign(edges(spark).withColumn("slot", F.lit("mine")), [1.0, 1.0]).collect()
    assert len(rows) == len(EDGES)
    assert {r.size for r in rows if r.text is None} == {1}
    for r in rows:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert rendezvous.assign(empty(spark), [1.0]).collect() == []
