"""Streaming forms equal the batch operators on the same input."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cachescope.operators import pii, replay
from cachescope.operators import telemetry as tel
from cachescope.sources import tables as src
from cachescope.streaming import queries as sq
from cachescope.streaming import tables as st

from .conftest import SF_SMALL


def _requests_files(spark, scratch, parts=4):
    """The request log split into ``parts`` files in time order (one per trigger)."""
    req = src.gw_requests(spark, SF_SMALL)
    path = os.path.join(scratch, "requests")
    bounds = req.select(F.percentile_approx("ts", [i / parts for i in range(1, parts)]).alias("q")).first().q
    edges = [None] + list(bounds) + [None]
    for i in range(parts):
        part = req
        if edges[i] is not None:
            part = part.where(F.col("ts") > F.lit(edges[i]))
        if edges[i + 1] is not None:
            part = part.where(F.col("ts") <= F.lit(edges[i + 1]))
        part.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"part{i}"))
    return req, os.path.join(path, "part*")


def _run(df, scratch, name, mode, sink=None):
    q = sq.start(df, os.path.join(scratch, f"ckpt-{name}"), sink=sink, name=name, mode=mode,
                 available_now=True)
    q.awaitTermination()
    return q


def test_traffic_by_minute_stream_equals_batch(spark, scratch):
    req, glob = _requests_files(spark, scratch)
    stream = sq.file_stream(spark, glob, req.schema, max_files=1)
    _run(sq.traffic_by_minute(stream), scratch, "traffic_s", "complete")
    got = {tuple(r) for r in spark.table("traffic_s").collect()}
    want = {tuple(r) for r in tel.traffic_by_minute(req).collect()}
    assert got == want


def test_counters_stream_equals_batch(spark, scratch):
    req, glob = _requests_files(spark, scratch)
    stream = sq.file_stream(spark, glob, req.schema, max_files=1)
    _run(sq.counters(stream), scratch, "counters_s", "complete")
    got = spark.table("counters_s").first()
    want = tel.metrics(req, None, as_of="2030-01-01 00:00:00").first()
    assert got.total_requests == want.total_requests
    assert got.cache_hits == want.cache_hits
    assert got.tokens_saved == want.tokens_saved
    assert got.total_requests == got.cache_hits + got.cache_misses


def test_latency_runs_stream_equals_batch(spark, scratch):
    req, glob = _requests_files(spark, scratch)
    stream = sq.file_stream(spark, glob, req.schema, max_files=1)
    _run(sq.latency_runs(stream, "30 minutes"), scratch, "runs_s", "complete")
    got = sorted((r.run_start, r.n_requests, r.sum_latency_ms) for r in spark.table("runs_s").collect())
    want = sorted((r.run_start, r.n_requests, r.sum_latency_ms)
                  for r in tel.latency_runs(req, "30 minutes").collect())
    assert got == want


def test_redaction_stream_equals_batch(spark, scratch):
    docs = src.documents(spark, SF_SMALL)
    path = os.path.join(scratch, "docs")
    docs.repartition(3).write.parquet(path)
    stream = sq.file_stream(spark, path, docs.schema, max_files=1)
    _run(sq.redaction(stream, "text").select("doc_id", "sanitized_text"), scratch, "red_s", "append")
    got = {tuple(r) for r in spark.table("red_s").collect()}
    want = {tuple(r) for r in pii.redact(docs, "text").select("doc_id", "sanitized_text").collect()}
    assert got == want


def test_event_ring_sink_keeps_newest(spark, scratch):
    req, glob = _requests_files(spark, scratch)
    stream = sq.file_stream(spark, glob, req.schema, max_files=1)
    ring_path = os.path.join(scratch, "ring")
    _run(tel.hit_events(stream), scratch, "ring", "append", sink=sq.event_ring_sink(ring_path, 100))
    got = [r.event_id for r in sq.read_ring(spark, ring_path, _ring_schema(spark))
           .orderBy(F.col("ts").desc(), F.col("event_id").desc()).collect()]
    want = [r.event_id for r in tel.event_ring(tel.hit_events(req), 100).collect()]
    assert got == want


def test_cache_lookup_sink_equals_batch_replay(spark, scratch):
    rng = np.random.default_rng(7)
    n, d = 240, 8
    base = rng.normal(size=(12, d))
    vecs = base[rng.integers(0, 12, n)] + 0.35 * rng.normal(size=(n, d))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    log = spark.createDataFrame(rows, "request_id long, embedding array<float>")
    path = os.path.join(scratch, "log")
    for i in range(4):
        log.where((F.col("request_id") >= i * 60) & (F.col("request_id") < (i + 1) * 60)) \
            .coalesce(1).write.parquet(os.path.join(path, f"p{i}"))
    tau = 0.3
    stream = sq.file_stream(spark, os.path.join(path, "p*"), log.schema, max_files=1)
    out = os.path.join(scratch, "out")
    cache_path = os.path.join(scratch, "cache")
    _run(stream, scratch, "lookup", "append", sink=sq.cache_lookup_sink(cache_path, out, tau, dim=8, compact_every=2))
    got = {r.request_id: (r.outcome, r.match_id) for r in spark.read.parquet(out).collect()}
    want = {r.id: (r.outcome, r.match_id)
            for r in replay.cache_replay(log, tau, dim=8, id_col="request_id").collect()}
    assert got == want
    entries = st.read(spark, cache_path, "key long, embedding array<float>")
    assert entries.count() == sum(1 for o, _ in want.values() if o == "MISS")


def _ring_schema(spark):
    return tel.hit_events(src.gw_requests(spark, SF_SMALL)).schema


class _Crash(Exception):
    pass


@pytest.mark.parametrize("crash_after", [1, 2, 3])
def test_lookup_sink_repeats_a_batch(spark, scratch, monkeypatch, crash_after):
    """A batch that is run again, whole or after a crash between its writes, gives what one run gives."""
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(6, 4))[rng.integers(0, 6, 60)] + 0.2 * rng.normal(size=(60, 4))
    rows = [(f"r{i:03d}", [float(x) for x in v]) for i, v in enumerate(vecs)]
    log = spark.createDataFrame(rows, "request_id string, embedding array<float>")
    want = {r.id: (r.outcome, r.match_id) for r in replay.cache_replay(log, 0.3, dim=4).collect()}
    cache_path, out = os.path.join(scratch, "c"), os.path.join(scratch, "o")
    sink = sq.cache_lookup_sink(cache_path, out, 0.3, dim=4, compact_every=2)
    batches = [log.where(F.col("request_id").between(f"r{k * 20:03d}", f"r{k * 20 + 19:03d}")) for k in range(3)]
    sink(batches[0], 0)
    written, real = [], st.append

    def failing(*a, **k):
        real(*a, **k)
        written.append(a)
        if len(written) == crash_after:
            raise _Crash

    monkeypatch.setattr(st, "append", failing)
    with pytest.raises(_Crash):
        sink(batches[1], 1)
    monkeypatch.setattr(st, "append", real)
    for k in (1, 1, 2, 2):
        sink(batches[k], k)
    got = {r.request_id: (r.outcome, r.match_id) for r in spark.read.parquet(out).collect()}
    assert got == want
    stored = [r.key for r in st.read(spark, cache_path, "key string, embedding array<float>").collect()]
    assert sorted(stored) == sorted(k for k, (o, _) in want.items() if o == "MISS")


def test_ring_sink_repeats_a_batch(spark, scratch):
    events = tel.hit_events(src.gw_requests(spark, SF_SMALL))
    halves = [events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")]
    path = os.path.join(scratch, "ring-again")
    sink = sq.event_ring_sink(path, 30)
    for k in (0, 0, 1, 1):
        sink(halves[k], k)
    got = {r.event_id for r in sq.read_ring(spark, path, events.schema).collect()}
    assert got == {r.event_id for r in tel.event_ring(events, 30).collect()}


def test_run_that_starts_exactly_one_gap_later(spark, scratch):
    rows = [(1, "2024-01-01 00:00:00", 5), (2, "2024-01-02 00:00:00", 7), (3, "2024-01-02 23:59:59", 9)]
    req = spark.createDataFrame(rows, "request_id long, ts string, latency_ms long").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    path = os.path.join(scratch, "gap")
    req.coalesce(1).write.parquet(path)
    _run(sq.latency_runs(sq.file_stream(spark, path, req.schema), "24 hours"), scratch, "gap_s", "complete")
    got = sorted((str(r.run_start), r.n_requests) for r in spark.table("gap_s").collect())
    want = sorted((str(r.run_start), r.n_requests) for r in tel.latency_runs(req, "24 hours").collect())
    assert got == want and len(got) == 2


def test_session_log_sink_and_load(spark, scratch):
    log = src.gw_session_log(spark, SF_SMALL)
    path = os.path.join(scratch, "sessions")
    log.repartition(2).write.parquet(path)
    stream = sq.file_stream(spark, path, log.schema, max_files=1)
    log_path = os.path.join(scratch, "session_log")
    _run(stream, scratch, "sess", "append", sink=sq.session_log_sink(log_path))
    from cachescope.operators import sessions as sess

    ids = log.select("session_id")
    got = {repr(r) for r in sq.load_sessions(spark, log_path, ids, "2024-01-03 00:00:00").collect()}
    want = {repr(r) for r in sess.load(ids, log, "2024-01-03 00:00:00").collect()}
    assert got == want


def test_cache_upsert_sink_equals_batch(spark, scratch):
    from cachescope.operators import cache

    writes = cache.entries_from_pairs(src.gw_pairs(spark, SF_SMALL)).select(
        "key", "original_text", "response_text", F.col("seq.conv_id").alias("seq"))
    path = os.path.join(scratch, "writes")
    writes.repartition(3, "seq").write.parquet(path)
    stream = sq.file_stream(spark, path, writes.schema, max_files=1)
    cache_path = os.path.join(scratch, "cache_tbl")
    _run(stream, scratch, "upsert", "append", sink=sq.cache_upsert_sink(cache_path))
    got = {tuple(r) for r in sq.read_cache(spark, cache_path, "key string, original_text string, "
                                           "response_text string, seq long")
           .select("key", "original_text").collect()}
    want = {tuple(r) for r in cache.upsert(writes).select("key", "original_text").collect()}
    assert got == want


def test_latency_runs_per_tenant_stream_equals_batch(spark, scratch):
    req, glob = _requests_files(spark, scratch)
    stream = sq.file_stream(spark, glob, req.schema, max_files=1)
    _run(sq.latency_runs(stream, "2 hours", keys=("tenant",)), scratch, "runs_t", "complete")
    got = sorted((r.tenant, r.run_start, r.n_requests) for r in spark.table("runs_t").collect())
    want = sorted((r.tenant, r.run_start, r.n_requests)
                  for r in tel.latency_runs(req, "2 hours", keys=("tenant",)).collect())
    assert got == want


def test_processing_time_trigger(spark, scratch):
    req, glob = _requests_files(spark, scratch)
    stream = sq.file_stream(spark, glob, req.schema, max_files=4)
    q = sq.start(sq.counters(stream), os.path.join(scratch, "ckpt-trig"), name="counters_t",
                 mode="complete", trigger="5 seconds")
    try:
        q.processAllAvailable()
        assert spark.table("counters_t").first().total_requests == req.count()
    finally:
        q.stop()


def test_two_writer_event_ring_stream(spark, scratch):
    """Hit events and PII-block events from two streams feed one ring (O1 + T4)."""
    req, glob = _requests_files(spark, scratch)
    pii_log = src.gw_pii(spark, SF_SMALL)
    pii_path = os.path.join(scratch, "pii")
    pii_log.repartition(2).write.parquet(pii_path)
    hits = tel.hit_events(sq.file_stream(spark, glob, req.schema, max_files=1))
    blocks = tel.pii_block_events(sq.file_stream(spark, pii_path, pii_log.schema, max_files=1))
    ring_path = os.path.join(scratch, "ring2")
    _run(tel.all_events(hits, blocks), scratch, "ring2", "append", sink=sq.event_ring_sink(ring_path, 100))
    got = [r.event_id for r in sq.read_ring(spark, ring_path, _ring_schema(spark))
           .orderBy(F.col("ts").desc(), F.col("event_id").desc()).collect()]
    want = [r.event_id for r in tel.event_ring(tel.all_events(tel.hit_events(req),
                                                              tel.pii_block_events(pii_log)), 100).collect()]
    assert got == want
