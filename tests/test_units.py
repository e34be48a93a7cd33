"""Boundary cases on literal rows, one group per operator family."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cachescope.functions import json_text as jt
from cachescope.functions.text import (go_quote, preview_bytes, preview_chars, prompt_key,
                                       session_id_valid)
from cachescope.operators import cache, pii, sessions, telemetry as tel, vectors as vec
from cachescope.operators.prompts import clean_session_messages
from cachescope.sources import events as ev
from cachescope.sources import requests as reqs


def _one(spark, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}")


# ------------------------------------------------------------------ requests
def test_request_parse_cases(spark):
    bodies = [
        ("normal", json.dumps({"model": "m", "messages": [{"role": "system", "content": "s"},
                                                          {"role": "user", "content": "hi there"}],
                               "stream": True})),
        ("empty", json.dumps({"model": "m", "messages": []})),
        ("nocontent", json.dumps({"model": "m", "messages": [{"role": "user", "content": "a"},
                                                             {"role": "user"}]})),
        ("numeric", json.dumps({"model": "m", "messages": [{"role": "user", "content": 42}]})),
        ("truncated", '{"model": "m", "messages": [{"role": "us'),
    ]
    df = reqs.parse_requests(spark.createDataFrame(bodies, "name string, body string"))
    ok = {r.name: r for r in reqs.accepted(df).collect()}
    assert set(ok) == {"normal", "empty", "nocontent", "numeric"}
    assert ok["normal"].prompt == "hi there" and ok["normal"].stream is True
    assert ok["empty"].prompt == "" and ok["empty"].stream is False
    assert ok["nocontent"].prompt == "" and ok["numeric"].prompt == "42"
    assert [tuple(m) for m in ok["normal"].messages] == [("system", "s"), ("user", "hi there")]
    assert [r.name for r in reqs.rejected(df).collect()] == ["truncated"]


def test_content_of_any_type_is_printed(spark):
    parts = [{"type": "text", "text": "a b"}, {"image_url": {"url": "u", "n": 1.50}, "type": "image_url"}]
    cases = [(7, "7"), (-0.5, "-0.5"), (1e21, "1e+21"), (123456789012345678901.0, "123456789012345680000"), (0.0001, "0.0001"),
             (0.00001234, "1.234e-05"), (100, "100"), (12.25, "12.25"), (0, "0"), (True, "true"), (None, "<nil>"), ([], "[]"),
             ({}, "map[]"), ([1, "x", None, [False]], "[1 x <nil> [false]]"),
             (parts, "[map[text:a b type:text] map[image_url:map[n:1.5 url:u] type:image_url]]"), ("text", "text"), ("", "")]
    df = spark.createDataFrame([(i, json.dumps({"messages": [{"role": "user", "content": "old"}, {"role": 5, "content": c}]}))
                                for i, (c, _) in enumerate(cases)], "i int, body string")
    got = {r.i: r for r in reqs.accepted(reqs.parse_requests(df)).collect()}
    assert [got[i].prompt for i in range(len(cases))] == [p for _, p in cases]
    assert {r.messages[-1].role for r in got.values()} == {"5"}
    missing = spark.createDataFrame([('{"messages":[{"role":"user"}]}',), ('{"messages":[null]}',), ('{"messages":["x"]}',)], "body string")
    assert [r.prompt for r in reqs.accepted(reqs.parse_requests(missing)).collect()] == ["", ""]


def test_request_types_are_strict(spark):
    bodies = {'{"model":5,"messages":[]}': False, '{"messages":[]} junk': False, "null": True, "[]": False, "": False,
              '{"messages":{}}': False, '{"messages":[{"content":null},null]}': True, '{"stream":"yes"}': False,
              '{"a":1},{"b":2}': False, '"x"': False, '{"messages":null,"model":null}': True}
    df = reqs.parse_requests(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert {r.body: r.request is not None for r in df.collect()} == bodies
    assert {r.body: r.prompt for r in reqs.accepted(df).collect()} == {
        "null": "", '{"messages":[{"content":null},null]}': "", '{"messages":null,"model":null}': ""}


def test_content_types_are_strict(spark):
    df = spark.createDataFrame([('{"choices":[{"message":{"content":5}}]}',)], "x string")
    assert df.select(jt.json_text("x").alias("t")).first().t == '{"choices":[{"message":{"content":5}}]}'
    body = 'data: {"choices":[{"delta":{"content":5}}]}\ndata: {"choices":[{"delta":{"content":"x"}}]}\n'
    assert spark.createDataFrame([(body,)], "x string").select(jt.sse_text("x").alias("t")).first().t == "x"


# ------------------------------------------------------------------ response bodies
def _sse(*lines):
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("body,want", [
    (_sse('data: {"choices":[{"delta":{"content":"Hel"}}]}', "",
          'data: {"choices":[{"delta":{"content":"lo"}}]}', "", "data: [DONE]"), "Hello"),
    (_sse('data: {"choices":[{"delta":{"content":"a"},"message":{"content":"b"}}]}'), "ab"),
    (_sse("data: [DONE]"), ""),
    (_sse("data: {not json", 'data: {"choices":[{"delta":{"content":"x"}}]}'), "x"),
    (_sse('{"choices":[{"delta":{"content":"no prefix"}}]}',
          'data: {"choices":[{"delta":{"content":"y"}}]}'), "y"),
    ("", ""),
])
def test_sse_text(spark, body, want):
    assert _one(spark, body).select(jt.sse_text("x").alias("t")).first().t == want


@pytest.mark.parametrize("body,want", [
    ('{"choices":[{"message":{"content":"one"}}]}', "one"),
    ('{"choices":[{"message":{"content":"a"}},{"message":{"content":"b"}}]}', "ab"),
    ('{"error":"boom"}', '{"error":"boom"}'),
])
def test_json_text(spark, body, want):
    assert _one(spark, body).select(jt.json_text("x").alias("t")).first().t == want


def test_sse_body_round_trip(spark):
    chunks = ['He said "hi"\n', "\\ é 😀", ""]
    df = spark.createDataFrame([(chunks,)], "c array<string>")
    assert df.select(jt.sse_text(jt.sse_body("c")).alias("t")).first().t == "".join(chunks)


# ------------------------------------------------------------------ keys and previews
def _ref_key(text):
    return "prompt:" + hashlib.sha256(text.strip().lower().encode()).hexdigest()[:32]


def test_prompt_key(spark):
    texts = ["Hello", " hello\n", "", "Ça va, Été?", "\tTabs "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.k for r in df.select(prompt_key("t").alias("k")).collect()]
    assert got[0] == got[1] == _ref_key("Hello")
    assert got[2] == _ref_key("")
    assert got[3] == _ref_key("Ça va, Été?")
    assert got[4] == _ref_key("\tTabs ")


@pytest.mark.parametrize("n", [60, 80, 120])
def test_preview_chars(spark, n):
    exact, longer = "é" * n, "é" * (n + 1)
    df = spark.createDataFrame([(exact,), (longer,)], "t string")
    rows = df.select(preview_chars("t", n).alias("p"), preview_chars("t", n, ellipsis=False).alias("q")).collect()
    assert rows[0].p == exact and rows[0].q == exact
    assert rows[1].p == "é" * n + "…" and rows[1].q == "é" * n


def test_preview_bytes_multibyte_cut(spark):
    df = spark.createDataFrame([("a" * 59 + "é",), ("a" * 59 + "éx",), ("a" * 60,)], "t string")
    got = [r.p for r in df.select(preview_bytes("t", 60).alias("p")).collect()]
    assert got[0] == "a" * 59 + "�…"      # 61 bytes: é cut in the middle
    assert got[1] == "a" * 59 + "�…"
    assert got[2] == "a" * 60                  # exactly 60 bytes: unchanged


def test_go_quote(spark):
    assert _one(spark, 'a"b\\c\nd').select(go_quote("x").alias("q")).first().q == '"a\\"b\\\\c\\nd"'


# ------------------------------------------------------------------ PII
PII_CASES = [
    ("email", "mail me at ann.lee@example.org now", ["EMAIL_ADDRESS"], "mail me at <EMAIL_ADDRESS> now"),
    ("two", "call 415-555-0199 or write bob@x.io", ["EMAIL_ADDRESS", "PHONE_NUMBER"],
     "call <PHONE_NUMBER> or write <EMAIL_ADDRESS>"),
    ("twice", "a@b.co and c@d.co", ["EMAIL_ADDRESS"], "<EMAIL_ADDRESS> and <EMAIL_ADDRESS>"),
    ("none", "nothing to see here", [], "nothing to see here"),
    ("empty", "", [], ""),
    ("ssn", "ssn 123-45-6789.", ["US_SSN"], "ssn <US_SSN>."),
    ("iban", "pay GB82WEST12345698765432 today", ["IBAN_CODE"], "pay <IBAN_CODE> today"),
    ("card", "card 4111 1111 1111 1111 ok", ["CREDIT_CARD"], "card <CREDIT_CARD> ok"),
    ("ip", "host 10.0.0.255 up", ["IP_ADDRESS"], "host <IP_ADDRESS> up"),
    ("ip256", "host 10.0.0.256 up", [], "host 10.0.0.256 up"),
    ("accent", "é108.51.216.133", ["IP_ADDRESS"], "é<IP_ADDRESS>"),
    ("email before a dash", "Write to mira.solano@post.example — today.", ["EMAIL_ADDRESS"],
     "Write to <EMAIL_ADDRESS> — today."),
]


def test_pii_redact_cases(spark):
    df = spark.createDataFrame([(n, t) for n, t, _, _ in PII_CASES], "name string, text string")
    got = {r.name: r for r in pii.redact(df, "text").collect()}
    for name, _, ents, red in PII_CASES:
        assert got[name].entities == ents, name
        assert got[name].sanitized_text == red, name
        assert got[name].has_pii == bool(ents), name


def test_pii_null_text_passes(spark):
    df = spark.createDataFrame([(None,)], "text string")
    r = pii.redact(df, "text").first()
    assert r.sanitized_text is None and r.entities == [] and r.has_pii is False


def test_pii_redaction_idempotent(spark):
    df = spark.createDataFrame([(t,) for _, t, _, _ in PII_CASES], "text string")
    once = pii.redact(df, "text").select(F.col("sanitized_text").alias("text"))
    twice = pii.redact(once, "text")
    assert all(r.text == r.sanitized_text for r in twice.collect())


def test_luhn_option(spark):
    df = spark.createDataFrame([("good 4111 1111 1111 1111 bad 4111 1111 1111 1112",)], "text string")
    r = pii.redact(df, "text", validate_cards=True).first()
    assert r.sanitized_text == "good <CREDIT_CARD> bad 4111 1111 1111 1112"
    c = pii.card_checks(df, "text").first()
    assert (c.n_card_candidates, c.n_card_valid) == (2, 1)


def test_pii_events_and_counts(spark):
    df = spark.createDataFrame([(1, "a@b.co 123-45-6789 " + "x" * 100), (2, "clean")],
                               "doc_id long, text string")
    evs = pii.block_events(pii.redact(df, "text"), key="doc_id").collect()
    assert sorted(e.entity for e in evs) == ["EMAIL_ADDRESS", "US_SSN"]
    assert all(e.message == "[REDACTED] " + ("<EMAIL_ADDRESS> <US_SSN> " + "x" * 100)[:80] for e in evs)
    counts = {r.entity: r.blocks for r in pii.block_counts(pii.block_events(
        pii.redact(df, "text"), key="doc_id")).collect()}
    assert counts == {"EMAIL_ADDRESS": 1, "US_SSN": 1}


def test_pii_spans_offsets(spark):
    text = "to a@b.co or 10.1.2.3"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = sorted((r.entity, r.start, r.end) for r in pii.spans(df).collect())
    assert spans == [("EMAIL_ADDRESS", 3, 9), ("IP_ADDRESS", 13, 21)]
    assert text[3:9] == "a@b.co"


def test_pii_scope_last_message(spark):
    msgs = spark.createDataFrame([(1, 0, "user", "a@b.co"), (1, 1, "assistant", "ok"),
                                  (1, 2, "user", "c@d.co")], "conv_id long, turn long, role string, content string")
    out = {r.turn: r.sanitized for r in pii.last_message_only(msgs).collect()}
    assert out == {0: "a@b.co", 1: "ok", 2: "<EMAIL_ADDRESS>"}
    out_all = {r.turn: r.sanitized for r in pii.last_message_only(msgs, scope="all").collect()}
    assert out_all[0] == "<EMAIL_ADDRESS>"


# ------------------------------------------------------------------ vectors
def _vecs(spark, rows):
    return spark.createDataFrame(rows, "key long, embedding array<float>")


def test_knn_boundaries(spark):
    cache_df = _vecs(spark, [(10, [1.0, 0.0, 0.0, 0.0]), (11, [0.0, 1.0, 0.0, 0.0]),
                             (12, [0.0, 0.0, 1.0, 0.0]), (13, [0.0, 0.0, 0.0, 0.0]), (14, [1.0, 0.0])])
    q = spark.createDataFrame([
        (1, [2.0, 0.0, 0.0, 0.0]),          # identical direction -> 0
        (2, [0.0, 0.0, 0.0, 1.0]),          # orthogonal to all -> 1, ties -> smallest key
        (3, [0.5, 0.5, 0.5, 0.5]),          # exactly 0.5 from 10, 11, 12
        (4, [1.0, 0.0]),                    # wrong dimension -> no match
        (5, [0.0, 0.0, 0.0, 0.0]),          # zero vector -> no match
    ], "query_id long, embedding array<float>")
    nn = {r.query_id: r for r in vec.knn1(q, cache_df, dim=4).collect()}
    assert (nn[1].match_key, nn[1].distance) == (10, 0.0)
    assert (nn[2].match_key, nn[2].distance) == (10, 1.0)
    assert (nn[3].match_key, nn[3].distance) == (10, 0.5)
    assert nn[4].match_key is None and nn[5].match_key is None
    d = {r.query_id: r for r in vec.hit_decision(vec.knn1(q, cache_df, dim=4), 0.5).collect()}
    assert d[3].outcome == "HIT"                       # inclusive threshold
    assert d[4].outcome == "MISS" and d[4].distance == 0.0
    d2 = {r.query_id: r.outcome for r in vec.hit_decision(vec.knn1(q, cache_df, dim=4), 0.4999).collect()}
    assert d2[3] == "MISS"
    near = {r.query_id for r in vec.near_misses(vec.knn1(q, cache_df, dim=4), 0.4999).collect()}
    assert near == {2, 3}


def test_knn_empty_cache(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    empty = spark.createDataFrame([], "key long, embedding array<float>")
    r = vec.hit_decision(vec.knn1(q, empty, dim=2), 0.15).first()
    assert r.outcome == "MISS" and r.distance == 0.0 and r.match_key is None


def test_knn_many_blocks_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    qv, cv = rng.normal(size=(150, 6)), rng.normal(size=(230, 6))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qv)], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(cv)], "key long, embedding array<double>")
    got = {r.query_id: (r.match_key, round(r.distance, 9))
           for r in vec.knn1(q, c, dim=6, block_rows=64, cache_block_rows=50).collect()}
    qn = qv / np.linalg.norm(qv, axis=1, keepdims=True)
    cn = cv / np.linalg.norm(cv, axis=1, keepdims=True)
    d = 1 - qn @ cn.T
    for i in range(150):
        j = int(np.argmin(d[i]))
        assert got[i] == (1000 + j, round(float(d[i, j]), 9))
    pairs = vec.pairs_within(q, c, 0.3, dim=6, block_rows=64, cache_block_rows=50, exclude_self=False)
    assert pairs.count() == int((d <= 0.3).sum())


# ------------------------------------------------------------------ sessions
def test_session_ids(spark):
    ids = ["0f8fad5b-d9cb-469f-a165-70867728950e", "0F8FAD5B-D9CB-469F-A165-70867728950E",
           "not-a-session", "0f8fad5b-d9cb-469f-a165-70867728950", None]
    df = spark.createDataFrame([(i,) for i in ids], "session_id string")
    assert [r.v for r in df.select(session_id_valid("session_id").alias("v")).collect()] == \
        [True, True, False, False, False]
    valid, invalid = sessions.split_valid_ids(df)
    assert valid.count() == 2 and invalid.count() == 3


def test_session_load_ttl_and_delete(spark):
    a, b, c = ("aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaaa", "bbbbbbbb-bbbb-bbbb-bbbb-bbbbbbbbbbbb",
               "cccccccc-cccc-cccc-cccc-cccccccccccc")
    log = spark.createDataFrame([
        (a, "2024-01-01 01:00:00", "save", "[1]", "m1"),      # 6 d 23 h before as_of -> live
        (b, "2024-01-01 00:00:00", "save", "[2]", "m2"),      # exactly 7 d -> expired
        (c, "2024-01-05 00:00:00", "save", "[3]", None),
        (c, "2024-01-06 00:00:00", "delete", None, None),      # deleted after save
    ], "session_id string, updated_at string, op string, payload string, model string") \
        .withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    req = spark.createDataFrame([(a,), (b,), (c,), ("dddddddd-dddd-dddd-dddd-dddddddddddd",)], "session_id string")
    got = {r.session_id: r for r in sessions.load(req, log, "2024-01-08 00:00:00").collect()}
    assert got[a].found and got[a].model == "m1" and got[a].payload == "[1]"
    assert not got[b].found and got[b].model == "llama-3.3-70b-versatile"
    assert not got[c].found
    assert not got["dddddddd-dddd-dddd-dddd-dddddddddddd"].found


def test_clean_session_messages(spark):
    df = spark.createDataFrame([([("system", "s", None), ("user", "", None), ("user", "hi", "m"),
                                  ("assistant", "yo", None)],)],
                               "m array<struct<role:string,content:string,meta:string>>")
    kept = df.select(clean_session_messages("m").alias("k")).first().k
    assert [(x.role, x.content, x.meta) for x in kept] == [("user", "hi", "m"), ("assistant", "yo", None)]


# ------------------------------------------------------------------ cache table
def test_cache_upsert_list_stats_purge(spark, scratch):
    writes = spark.createDataFrame([
        ("k1", "p1", "r1", 1), ("k1", "p1b", "r1b", 2), ("k2", "", "r2", 3), ("k3", "p3", "x" * 130, 4)],
        "key string, original_text string, response_text string, seq int")
    c = cache.upsert(writes)
    rows = {r.key: r for r in c.collect()}
    assert rows["k1"].original_text == "p1b"
    listed = cache.list_entries(c, limit=2)      # k1, k2 taken, k2 dropped after the limit
    assert [r.key for r in listed.collect()] == ["k1"]
    l3 = {r.key: r for r in cache.list_entries(c, limit=50).collect()}
    assert l3["k3"].response_preview == "x" * 120 + "…" and l3["k3"].response_length == 130
    assert cache.list_entries(c, limit=0).count() == 0
    st = cache.stats(c, dim=4, threshold=0.15).first()
    assert st.entry_count == 3 and st.embedding_dim == 4
    newer = spark.createDataFrame([("k1", "p1c", "r1c", 0)], writes.schema)
    assert {r.key: r.original_text for r in cache.upsert(newer, c).collect()}["k1"] == "p1c"
    path = f"{scratch}/cache"
    c.write.parquet(path)
    assert cache.purge(spark, path) == 3
    assert spark.read.parquet(path).count() == 0
    assert cache.purge(spark, f"{scratch}/missing") == 0


# ------------------------------------------------------------------ telemetry
REQ_SCHEMA = "request_id long, ts timestamp_ntz, outcome string, latency_ms long, distance double"


def _reqs(spark, rows):
    return spark.createDataFrame(rows, "request_id long, ts string, outcome string, latency_ms long, "
                                       "distance double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_metrics_empty_log(spark):
    empty = spark.createDataFrame([], REQ_SCHEMA)
    m = tel.metrics(empty, None, as_of="2024-01-01 00:00:00").first()
    assert m.total_requests == 0 and m.cache_hit_rate == 0.0 and m.avg_latency_ms == 0.0
    assert m.tokens_saved == 0 and m.active_tenants == 1
    t = tel.timeline(empty, "2024-01-01 00:00:30", 0).collect()
    assert len(t) == 30 and all(p.total_requests == 0 for p in t)


def test_runs_exact_gap_and_expiry(spark):
    log = _reqs(spark, [(1, "2024-01-01 00:00:00", "HIT", 10, 0.1),
                        (2, "2024-01-02 00:00:00", "MISS", 30, None),      # exactly 24 h later: new run
                        (3, "2024-01-02 01:00:00", "MISS", 50, None)])
    runs = sorted((r.n_requests, r.sum_latency_ms) for r in tel.latency_runs(log).collect())
    assert runs == [(1, 10), (2, 80)]
    assert tel.current_latency(log, "2024-01-02 12:00:00").first().avg_latency_ms == 40.0
    assert tel.current_latency(log, "2024-01-03 01:00:00").first().avg_latency_ms == 0.0  # idle 24 h
    m = tel.metrics(log, None, as_of="2024-01-02 12:00:00").first()
    assert (m.total_requests, m.cache_hits, m.cache_misses, m.tokens_saved) == (3, 1, 2, 1500)
    assert abs(m.estimated_cost_saved - 0.003) < 1e-12


def test_event_ring_drops_oldest(spark):
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", "HIT", i, 0.1) for i in range(101)]
    evs = tel.hit_events(_reqs(spark, rows))
    ring = [r.event_id for r in tel.event_ring(evs, 100).collect()]
    assert len(ring) == 100 and 0 not in ring and ring[0] == 100
    assert len(tel.event_feed(evs).collect()) == 50
    assert tel.newest_events(evs, 0).count() == 0


def test_event_decode(spark):
    good = json.dumps({"type": "pii_blocked", "message": "m", "timestamp": "2024-01-01T00:00:07.179575+00:00",
                       "metadata": {"entity": "US_SSN"}})
    go = json.dumps({"type": "cache_hit", "message": "h", "detail": "d", "timestamp": "2024-01-01T00:00:07Z"})
    raw = spark.createDataFrame([(good,), (go,), ("{broken",)], "json string")
    out = {r.type: r for r in ev.decode_events(raw).collect()}
    assert set(out) == {"pii_blocked", "cache_hit"}
    assert str(out["pii_blocked"].ts) == "2024-01-01 00:00:07.179575"
    assert str(out["cache_hit"].ts) == "2024-01-01 00:00:07"
    assert out["pii_blocked"].metadata == {"entity": "US_SSN"} and out["cache_hit"].detail == "d"
    enc = ev.encode_events(tel.hit_events(_reqs(spark, [(1, "2024-01-01 00:00:07.5", "HIT", 5, 0.06912)])))
    back = ev.decode_events(enc).first()
    assert back.message == "Cache HIT · distance 0.0691" and back.timestamp == "2024-01-01T00:00:07Z"
    assert back.metadata == {"distance": "0.0691", "latency": "5"}


def test_read_request_files(spark, scratch):
    path = f"{scratch}/reqs.jsonl"
    with open(path, "w") as f:
        f.write(json.dumps({"model": "m", "messages": [{"role": "user", "content": "q"}]}) + "\n")
        f.write('{"model": "m", "messa\n\n')
        f.write('{"model": 5}\n{"messages": [{"content": [1]}]}\n')
    df = reqs.read_request_files(spark, path)
    assert sorted(r.prompt for r in reqs.accepted(df).collect()) == ["[1]", "q"]
    assert reqs.rejected(df).count() == 2


def test_runs_across_segments(spark):
    """Segment cuts inside a run and exactly at a boundary give the same runs."""
    import random

    random.seed(3)
    t, rows = 0, []
    for i in range(400):
        t += random.choice([5, 30, 200, 1800, 4000])
        rows.append((i, f"2024-01-01 00:00:00", "MISS", random.randint(1, 99), None, t))
    log = spark.createDataFrame(rows, "request_id long, ts string, outcome string, latency_ms long, "
                                      "distance double, sec long") \
        .withColumn("ts", F.timestamp_add("SECOND", F.col("sec"), F.col("ts").cast("timestamp_ntz")))
    one = sorted(tuple(r)[1:] for r in tel.latency_runs(log, "30 minutes").collect())
    for seg in (1, 2, 7):
        many = sorted(tuple(r)[1:] for r in tel.latency_runs(log, "30 minutes", segment_buckets=seg).collect())
        assert many == one
    # sequential check
    ts = [r[5] for r in rows]
    runs, start = [], 0
    for i in range(1, len(ts) + 1):
        if i == len(ts) or ts[i] - ts[i - 1] >= 1800:
            runs.append((i - start, sum(r[3] for r in rows[start:i])))
            start = i
    assert sorted((r[2], r[3]) for r in one) == sorted(runs)


def test_person_gazetteer_hook(spark):
    from cachescope.functions.pii_patterns import person_pattern

    df = spark.createDataFrame([("Ask Ada Lovelace or ada about it",)], "text string")
    r = pii.redact(df, "text", extra=[person_pattern(["Ada Lovelace", "Ada"])]).first()
    assert r.sanitized_text == "Ask <PERSON> or ada about it" and r.entities == ["PERSON"]


def test_embed_with_dedups_and_checks_dim(spark):
    from cachescope.operators.embed import embed_with, hashed_embedder

    df = spark.createDataFrame([(1, "hello world"), (2, "hello world"), (3, "  "), (4, "bye")],
                               "id long, text string")
    out = {r.id: r.embedding for r in embed_with(
        df, lambda texts: [[float(len(t)), 1.0] if t != "bye" else [1.0] for t in texts],
        dim=2).collect()}
    assert out[1] == out[2] == [11.0, 1.0]
    assert out[4] is None and 3 not in out or out.get(3) is None
    h = hashed_embedder(df.where("id < 3"), "text", dim=16).collect()
    assert h[0].embedding == h[1].embedding and len(h[0].embedding) == 16


def test_gateway_flow_error_replies(spark):
    from cachescope.plans.gateway import gateway_flow

    rows = [(1, "q", "upstream error body", 500, [1.0, 0.0]), (2, "q", "ok", 200, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "seq long, prompt string, response string, status int, "
                                     "embedding array<float>")
    strict = {r.request_id: (r.cache, r.stored) for r in
              gateway_flow(df, 0.15, dim=2, id_col="seq", status="status").outcomes.collect()}
    assert strict == {1: ("MISS", False), 2: ("MISS", True)}
    quirk = {r.request_id: (r.cache, r.stored) for r in
             gateway_flow(df, 0.15, dim=2, id_col="seq", status="status", cache_errors=True).outcomes.collect()}
    assert quirk == {1: ("MISS", True), 2: ("HIT", False)}


def test_cache_list_bytes_unit(spark):
    c = spark.createDataFrame([("k", "p", "é" * 70)], "key string, original_text string, response_text string")
    r = cache.list_entries(c, preview=120, unit="bytes").first()
    assert r.response_length == 140 and r.response_preview == "é" * 60 + "…"
    r2 = cache.list_entries(c, preview=120).first()
    assert r2.response_length == 70 and r2.response_preview == "é" * 70


def test_cache_lookup_enrichment(spark):
    c = spark.createDataFrame([("k1", "cached prompt", "cached answer", [1.0, 0.0]),
                               ("k2", "other", "other answer", [0.0, 1.0])],
                              "key string, original_text string, response_text string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.01]), (2, [0.7, 0.7]), (3, [])],
                              "request_id long, embedding array<float>")
    out = {r.request_id: r for r in vec.cache_lookup(q, c, 0.15, dim=2).collect()}
    assert (out[1].outcome, out[1].match_key, out[1].response) == ("HIT", "k1", "cached answer")
    assert out[2].outcome == "MISS" and out[2].matched_prompt is not None and out[2].response is None
    assert (out[3].outcome, out[3].distance, out[3].match_key) == ("MISS", 0.0, None)


def test_dashboard_tables(spark):
    from cachescope import GatewayParams
    from cachescope.plans.gateway import dashboard_tables
    from cachescope.sources import tables as src

    from .conftest import SF_SMALL

    cache_tbl = cache.upsert(cache.entries_from_pairs(src.gw_pairs(spark, SF_SMALL)))
    panels = dashboard_tables(src.gw_requests(spark, SF_SMALL), src.gw_pii(spark, SF_SMALL), cache_tbl,
                              as_of="2024-01-15 12:00:30", params=GatewayParams(threshold=0.62, dim=64))
    assert set(panels) == {"metrics", "events", "timeline", "cache_stats", "cache_entries"}
    assert panels["metrics"].count() == 1 and panels["timeline"].count() == 30
    assert panels["events"].count() == 50
    assert panels["cache_stats"].first().threshold == 0.62
    assert 0 < panels["cache_entries"].count() <= 50


def test_prompt_key_property(spark):
    """Key = 'prompt:' + sha256(strip_unicode_ws(lower(text)))[:32] on generated texts."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    # fixed values: Unicode White_Space code points (what the trim removes at both ends)
    white_space = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
                   "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
    alphabet = st.sampled_from(list("abcXYZ019 éÉçÜß-?.") + list(white_space))
    samples = []

    @settings(max_examples=60, deadline=None)
    @given(st.text(alphabet=alphabet, max_size=12))
    def collect(t):
        samples.append(t)

    collect()
    df = spark.createDataFrame([(t,) for t in samples], "t string")
    got = [r.k for r in df.select(prompt_key("t").alias("k")).collect()]
    want = ["prompt:" + hashlib.sha256(t.lower().strip(white_space).encode()).hexdigest()[:32]
            for t in samples]
    assert got == want


def test_session_id_with_a_line_break(spark):
    from cachescope.functions.text import session_id_valid

    good = "123e4567-e89b-12d3-a456-426614174000"
    df = spark.createDataFrame([(good,), (good + "\n",), (good.upper(),)], "s string")
    assert [r.ok for r in df.select(session_id_valid("s").alias("ok")).collect()] == [True, False, True]


def test_prompt_key_of_a_final_sigma(spark):
    from cachescope.functions.text import prompt_key

    df = spark.createDataFrame([("ΟΔΟΣ",), ("οδοσ",)], "p string")
    assert len({r.k for r in df.select(prompt_key("p").alias("k")).collect()}) == 1


def test_cache_list_of_no_entries_keeps_its_columns(spark):
    c = spark.createDataFrame([("k", "p", "r")], "key string, original_text string, response_text string")
    assert cache.list_entries(c, 0).columns == ["key", "prompt", "response_preview", "response_length"]
    assert cache.list_entries(c, 0).collect() == []


def test_validated_card_is_replaced_where_it_was_matched(spark):
    from cachescope.operators import pii

    text = "card 4111111111111111 and 94111111111111111111119 and 4111111111111112"
    df = spark.createDataFrame([(text,)], "text string")
    got = pii.redact(df, "text", validate_cards=True).first()
    assert got.sanitized_text == text.replace("card 4111111111111111 ", "card <CREDIT_CARD> ")


def test_embed_with_blank_and_null_texts(spark):
    from cachescope.operators.embed import embed_with

    df = spark.createDataFrame([(1, "a"), (2, " a "), (3, "  "), (4, None), (5, "bb")], "id long, text string")
    got = {r.id: r.embedding for r in embed_with(df, lambda xs: [[float(len(x))] for x in xs], dim=1).collect()}
    assert got == {1: [1.0], 2: [1.0], 3: None, 4: None, 5: [2.0]}


def test_session_messages(spark):
    stored = ('{"messages":[{"role":"user","content":"hi","meta":{"a":[1]}},{"role":"assistant","content":7,"meta":{}},'
              '{"role":5,"content":"x"},{"role":"user"},{"role":"user","content":""},{"role":"user","content":"0","meta":null},'
              '{"role":"assistant","content":[]},7],"model":"m","updatedAt":"2024-01-01T00:00:00+00:00"}')
    payloads = [stored, '[{"role":"user","content":"hi"}]', "no json", None, "5", '{"messages":5,"model":6}', "{}", stored + " x"]
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, p string")
    m = sessions.messages_of(F.col("p"))
    rows = df.select("i", m.alias("m"), sessions.model_of(F.col("p")).alias("model"),
                     sessions.worth_saving(m).alias("kept")).orderBy("i").collect()
    assert [tuple(x)[:3] for x in rows[0].m] == [
        ("user", "hi", '{"a":[1]}'), ("assistant", "7", "{}"), (None, "x", None), ("user", None, None), ("user", "", None),
        ("user", "0", None), ("assistant", "[]", None), (None, None, None)]
    assert rows[0].m[1].raw == '{"content":7,"meta":{},"role":"assistant"}' and rows[0].m[-1].raw == "7"
    assert [tuple(x) for x in rows[0].kept] == [("user", "hi", '{"a":[1]}'), ("assistant", "7", None), ("user", "0", None)]
    assert [tuple(x)[:3] for x in rows[1].m] == [("user", "hi", None)]
    assert all(r.m == [] and r.kept == [] for r in rows[2:]) and [r.model for r in rows] == ["m"] + [None] * 7


def test_stored_session_round_trip(spark):
    kind = "m array<struct<role:string,content:string,meta:string>>"
    said = [("user", 'a "b"\n€', '{"k":[1,{"x":null}]}'), ("assistant", "c", None)]
    df = spark.createDataFrame([(said,), ([],)], kind).withColumn("at", F.lit("2024-01-02 03:04:05.5").cast("timestamp_ntz"))
    back = df.select(*sessions.save_rows(F.lit("s"), F.col("m"), F.lit("own"), F.col("at")))
    rows = back.select(sessions.messages_of(F.col("payload")).alias("m"), sessions.model_of(F.col("payload")).alias("o"), "payload").collect()
    assert sorted([tuple(x)[:3] for x in r.m] for r in rows) == [[], said] and {r.o for r in rows} == {"own"}
    assert all('"updatedAt":"2024-01-02T03:04:05.500000+00:00"' in r.payload for r in rows)


# ------------------------------------------------------------------ checksums and spans
def _mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_iban_checks(spark):
    good = ["GB82WEST12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606", "NO9386011117947",
            "MT84MALT011000012345MTLCAST001S", "LC55HEMM000100010012001200023015"]
    bad = ["GB83WEST12345698765432", "DE8937040044053201300", "DE893704004405320130000", "XX82WEST12345698765432"]
    assert all(_mod97(g) == 1 for g in good)
    df = spark.createDataFrame([(g,) for g in good + bad], "text string")
    got = {r.text: (r.n_iban_candidates, r.n_iban_valid) for r in pii.iban_checks(df).collect()}
    assert got == {**{g: (1, 1) for g in good}, **{b: (1, 0) for b in bad}}
    red = pii.redact(spark.createDataFrame([(f"to {good[0]} or {bad[0]}.",)], "text string"), validate_ibans=True).first()
    assert red.sanitized_text == f"to <IBAN_CODE> or {bad[0]}." and red.entities == ["IBAN_CODE"]


def _brute_spans(text):
    import re

    from cachescope.functions.pii_patterns import patterns

    taken = []
    for entity, pat in patterns("python"):
        for m in re.finditer(pat, text or ""):
            if not any(s < m.end() and m.start() < e for _, s, e in taken):
                taken.append((entity, *m.span()))
    return taken


def test_spans_equal_a_search_by_cascade(spark):
    import random

    rnd = random.Random(5)
    bits = ["a.b@c.org", "4111 1111 1111 1111", "4111111111111112", "123-45-6789", "10.0.0.1", "415-555-0199", "+1 (415) 555-0199",
            "GB82WEST12345698765432", "é", "1234567", "@", ".", "-", " ", "x", "99", "1.2.3.4.5", "a@b", "(212) 555 1234 5678 9012 3456"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " ", "", "-"]) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "4111 1111 1111 1111" * 3, " 10.0.0.1" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {}
    for r in pii.spans(df).collect():
        assert texts[r.doc_id][r.start:r.end] == r.value
        got.setdefault(r.doc_id, []).append((r.entity, r.start, r.end))
    assert {i: sorted(s) for i, s in got.items()} == {i: sorted(s) for i, t in enumerate(texts) if (s := _brute_spans(t))}


def test_span_scores(spark):
    text = "card 4111 1111 1111 1111, 4111 1111 1111 1112, GB82WEST12345698765432, GB83WEST12345698765432, a@b.co"
    rows = pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted((r.entity, r.score) for r in rows) == [("CREDIT_CARD", 0.3), ("CREDIT_CARD", 1.0), ("EMAIL_ADDRESS", 0.9),
                                                         ("IBAN_CODE", 0.5), ("IBAN_CODE", 1.0)]
