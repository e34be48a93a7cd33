import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cachescope.llm import packing
from cachescope.llm.queries import PACK_END_ID, QUERIES, tokenizer_path

from ..conftest import SF_SMALL
from .helpers import EDGES, edges, empty, frame


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return lambda t: tok.encode(t, add_special_tokens=False).ids


def test_cuts():
    assert packing.cuts(0) == [] and packing.cuts(1) == [(0, 1)] and packing.cuts(2048) == [(0, 2048)]
    assert packing.cuts(13, 4) == [(0, 4), (4, 4), (8, 4), (12, 1)]
    for n in range(1, 5000, 7):
        got = packing.cuts(n)
        assert [s for s, _ in got] == [sum(m for _, m in got[:k]) for k in range(len(got))]
        assert sum(m for _, m in got) == n and all(m & (m - 1) == 0 and m <= 2048 for _, m in got)
        assert len({m for _, m in got if m < 2048}) == sum(m < 2048 for _, m in got)
    with pytest.raises(ValueError):
        packing.cuts(5, 12)


def check(rows, docs, library, end=PACK_END_ID, max_len=packing.MAX_LEN):
    """Every document comes back whole from its pieces, every sequence holds one piece."""
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= max_len for r in rows)
    assert [r.length for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted((r.length for r in rows), reverse=True)
    want = []
    for key, text in docs:
        ids = np.array([*library(text or ""), end], dtype="<u4")
        want += [(key, s, m, zlib.crc32(ids[s:s + m].tobytes()), len(ids)) for s, m in packing.cuts(len(ids), max_len)]
    order = lambda r: (r[0] is not None, *(x or 0 for x in r))
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("max_len", [2048, 64, 1])
def test_round_trip(spark, library, max_len):
    docs = EDGES if max_len > 1 else [d for d in EDGES if len(d[1] or "") < 1000]
    rows = packing.pack(frame(spark, docs).withColumn("length", F.lit("x")).withColumn("ids", F.lit(1)),
                        tokenizer_path(), PACK_END_ID, max_len).collect()
    check(rows, docs, library, max_len=max_len)
    assert all(zlib.crc32(np.frombuffer(bytes(r.ids), "<u2").astype("<u4")) == r.ids_crc32 for r in rows)


def test_numbers_do_not_depend_on_files(spark):
    pick = lambda n: {(r.doc_id, r.start, r.ids_crc32, r.sequence_id) for r in packing.pack(
        frame(spark, [(i, f"text {i} " * (i % 90)) for i in range(200)], n), tokenizer_path(), 1).collect()}
    assert pick(2) == pick(7)


def test_special_tokens_as_the_library_has_them(spark, library):
    docs = [(1, "a <|startoftext|> b"), (2, "<|endoftext|>"), (3, "<|ENDOFTEXT|> c")]
    assert library(docs[0][1]) == [320, 49406, 321]
    check(packing.pack(frame(spark, docs), tokenizer_path(), PACK_END_ID).collect(), docs, library)


def test_empty(spark):
    assert packing.pack(empty(spark), tokenizer_path(), 1).collect() == []


def test_buckets_and_batches(spark, scratch):
    made = packing.pack(edges(spark), tokenizer_path(), 1)
    packing.write_buckets(made, f"{scratch}/buckets")
    back = spark.read.parquet(f"{scratch}/buckets")
    assert {(r.sequence_id, r.length, bytes(r.ids)) for r in back.collect()} == {
        (r.sequence_id, r.length, bytes(r.ids)) for r in made.collect()}
    for r in packing.batches(back, 4096).collect():
        assert r.per_batch * r.length == 4096 and r.n_tokens == r.n_sequences * r.length
        assert (r.n_batches - 1) * r.per_batch < r.n_sequences <= r.n_batches * r.per_batch


def test_query(spark, library):
    rows = QUERIES["op13_packing"](spark, SF_SMALL).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check(rows, docs, library)
