"""Registered queries: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
input tables. Doubles are rounded at the output (4 places for distances, 6 for
money and means) so results compare equal across engines.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import json_text as jt
from ..functions.text import preview_bytes, preview_chars, prompt_key, session_id_valid
from ..operators import cache, gazetteer, lsh, pii, pivots, replay
from ..operators import chunks as ck
from ..operators import embed as emb
from ..operators import prompts as pr
from ..operators import sessions as sess
from ..operators import telemetry as tel
from ..operators import vectors as vec
from ..session import ensure_checkpoint_dir
from ..streaming import queries as sq
from ..streaming import tables
from . import gateway as gw
from ..sources import events as ev
from ..sources import requests as reqs
from ..sources import tables as src

# Parameters of the registered queries (see FIXTURES.md).
#: Dimension of the test vectors and of the hashed test embedder.
DIM = 64
METRICS_AS_OF = "2024-01-31 00:00:00"
TIMELINE_AS_OF = "2024-01-15 12:00:30"
RUN_GAP = "30 minutes"
CURRENT_AS_OF = "2024-01-30 23:59:00"
TAU = 0.62

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


def _r(col: str, places: int) -> F.Column:
    return F.round(F.col(col), places).alias(col)


# ---------------------------------------------------------------- telemetry
@register("metrics")
def q_metrics(spark, sf_dir):
    m = tel.metrics(src.gw_requests(spark, sf_dir), src.gw_pii(spark, sf_dir), as_of=METRICS_AS_OF)
    return m.select("total_requests", "cache_hits", "cache_misses", "pii_blocked",
                    _r("avg_latency_ms", 6), "tokens_saved", _r("estimated_cost_saved", 6),
                    _r("cache_hit_rate", 6), "active_tenants")


@register("traffic_by_minute")
def q_traffic_by_minute(spark, sf_dir):
    return tel.traffic_by_minute(src.gw_requests(spark, sf_dir))


@register("timeline")
def q_timeline(spark, sf_dir):
    return tel.timeline(src.gw_requests(spark, sf_dir), TIMELINE_AS_OF, 30)


@register("latency_by_run")
def q_latency_by_run(spark, sf_dir):
    runs = tel.latency_runs(src.gw_requests(spark, sf_dir), RUN_GAP)
    return runs.select("run_id", "run_start", "run_end", "n_requests", "sum_latency_ms",
                       _r("avg_latency_ms", 6))


@register("avg_latency_current")
def q_avg_latency_current(spark, sf_dir):
    cur = tel.current_latency(src.gw_requests(spark, sf_dir), CURRENT_AS_OF, RUN_GAP)
    return cur.select("as_of", "n_requests", _r("avg_latency_ms", 6))


def _feed_events(spark, sf_dir):
    return tel.all_events(tel.hit_events(src.gw_requests(spark, sf_dir)),
                          tel.pii_block_events(src.gw_pii(spark, sf_dir)))


@register("hit_events")
def q_hit_events(spark, sf_dir):
    return tel.flat_metadata(tel.hit_events(src.gw_requests(spark, sf_dir)))


@register("event_ring")
def q_event_ring(spark, sf_dir):
    return tel.flat_metadata(tel.event_ring(_feed_events(spark, sf_dir)))


@register("event_feed")
def q_event_feed(spark, sf_dir):
    return tel.flat_metadata(tel.event_feed(_feed_events(spark, sf_dir)))


@register("request_outcome")
def q_request_outcome(spark, sf_dir):
    return tel.request_outcome(src.gw_requests(spark, sf_dir))


# ---------------------------------------------------------------- vectors
def _nearest_other(spark, sf_dir):
    """Every embedding looked up against all the others (leave-one-out KNN-1)."""
    log = src.vec_log(spark, sf_dir)
    return vec.knn1(log, log, query_id="vec_id", query_vec="embedding", cache_key="vec_id",
                    cache_vec="embedding", exclude_self=True, dim=DIM)


@register("knn1")
def q_knn1(spark, sf_dir):
    nn = _nearest_other(spark, sf_dir)
    return nn.select("vec_id", F.col("match_key").alias("match_id"), _r("distance", 4))


@register("hit_decision")
def q_hit_decision(spark, sf_dir):
    d = vec.hit_decision(_nearest_other(spark, sf_dir), TAU)
    return d.select("vec_id", F.col("match_key").alias("match_id"), _r("distance", 4), "outcome")


@register("near_misses")
def q_near_misses(spark, sf_dir):
    d = vec.near_misses(_nearest_other(spark, sf_dir), TAU)
    return d.select("vec_id", F.col("match_key").alias("match_id"), _r("distance", 4))


@register("neighbor_pairs")
def q_neighbor_pairs(spark, sf_dir):
    log = src.vec_log(spark, sf_dir)
    p = vec.pairs_within(log, log, TAU, query_id="vec_id", query_vec="embedding",
                         cache_key="vec_id", cache_vec="embedding", order="vec_id", dim=DIM)
    return p.select(F.col("match_key").alias("src_id"), F.col("vec_id").alias("dst_id"),
                    _r("distance", 4))


def _indexed(spark, sf_dir):
    """All embeddings and their pivot index (blocks of 128 rows, to have some on small tables)."""
    log = src.vec_log(spark, sf_dir)
    index = pivots.build(log, "vec_id", "embedding", DIM, block_rows=128)
    names = dict(query_id="vec_id", query_vec="embedding", cache_key="vec_id", cache_vec="embedding", dim=DIM, index=index)
    return log, index.rows, names


@register("knn1_pivots")
def q_knn1_pivots(spark, sf_dir):
    """``knn1`` through the pivot index."""
    log, rows, names = _indexed(spark, sf_dir)
    nn = vec.knn1(log, rows, exclude_self=True, **names)
    return nn.select("vec_id", F.col("match_key").alias("match_id"), _r("distance", 4))


@register("neighbor_pairs_pivots")
def q_neighbor_pairs_pivots(spark, sf_dir):
    """``neighbor_pairs`` through the pivot index."""
    log, rows, names = _indexed(spark, sf_dir)
    p = vec.pairs_within(log, rows, TAU, order="vec_id", **names)
    return p.select(F.col("match_key").alias("src_id"), F.col("vec_id").alias("dst_id"), _r("distance", 4))


@register("neighbor_counts_pivots")
def q_neighbor_counts_pivots(spark, sf_dir):
    """Earlier neighbours within tau and the nearest of them, through the pivot index."""
    log, rows, names = _indexed(spark, sf_dir)
    c = vec.neighbor_counts(log, rows, TAU, order="vec_id", **names)
    return c.select("vec_id", "n_within", F.col("match_key").alias("nearest_id"), F.when(
        F.col("n_within") > 0, F.round("distance", 4)).alias("distance"))


@register("neighbor_pairs_lsh")
def q_neighbor_pairs_lsh(spark, sf_dir):
    """Pairs by hashed candidates: exact distances, a pair at tau found with the chance 0.99."""
    p = lsh.pairs_within_lsh(src.vec_log(spark, sf_dir), TAU, key="vec_id", dim=DIM)
    return p.select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), _r("distance", 4))


@register("cache_replay_keys")
def q_cache_replay_keys(spark, sf_dir):
    """The log with 40 cache keys: an entry lasts until its key is stored again."""
    log = src.vec_log(spark, sf_dir).withColumn("key", F.concat(F.lit("prompt:"), F.col("vec_id") % 40))
    r = replay.cache_replay(log, TAU, dim=DIM, id_col="vec_id", key_col="key")
    return r.select(F.col("id").alias("vec_id"), "outcome", "match_id", _r("distance", 4))


@register("cache_replay")
def q_cache_replay(spark, sf_dir):
    r = replay.cache_replay(src.vec_log(spark, sf_dir), TAU, dim=DIM, id_col="vec_id")
    return r.select(F.col("id").alias("vec_id"), "outcome", "match_id", _r("distance", 4))


@register("cache_replay_ties")
def q_cache_replay_ties(spark, sf_dir):
    """Five requests at a time arrive together: they are decided in the order of their ids."""
    log = src.vec_log(spark, sf_dir).withColumn("at", F.floor(F.col("vec_id") / 5))
    r = replay.cache_replay(log, TAU, dim=DIM, id_col="vec_id", order_col="at")
    return r.select(F.col("id").alias("vec_id"), "outcome", "match_id", _r("distance", 4))


@register("cache_replay_warm")
def q_cache_replay_warm(spark, sf_dir):
    """The odd embeddings replayed against a cache that holds the even ones from the start."""
    log = src.vec_log(spark, sf_dir)
    warm = log.where("vec_id % 2 = 0").select(F.col("vec_id").alias("key"), "embedding")
    r = replay.cache_replay(log.where("vec_id % 2 = 1"), TAU, dim=DIM, id_col="vec_id", initial=warm)
    return r.select(F.col("id").alias("vec_id"), "outcome", "match_id", _r("distance", 4))


# ---------------------------------------------------------------- prompts & sessions
@register("last_prompt")
def q_last_prompt(spark, sf_dir):
    return pr.last_prompt(src.gw_messages(spark, sf_dir)).select("conv_id", "prompt", "last_role")


@register("message_filter")
def q_message_filter(spark, sf_dir):
    return pr.message_filter(src.gw_messages(spark, sf_dir)).select("conv_id", "turn", "role", "content")


@register("prompt_key")
def q_prompt_key(spark, sf_dir):
    return src.gw_messages(spark, sf_dir).select("conv_id", "turn", prompt_key("content").alias("key"))


@register("session_clean")
def q_session_clean(spark, sf_dir):
    return pr.session_summary(src.gw_messages(spark, sf_dir))


@register("session_id_valid")
def q_session_id_valid(spark, sf_dir):
    ids = src.gw_session_ids(spark, sf_dir)
    return ids.select("conv_id", "turn", "session_id", session_id_valid("session_id").alias("valid"))


SESSION_AS_OF = "2024-01-09 12:00:00"


@register("session_load")
def q_session_load(spark, sf_dir):
    log = src.gw_session_log(spark, sf_dir)
    got = sess.load(log.select("session_id"), log, SESSION_AS_OF)
    last = F.element_at("messages", -1)
    return got.select("session_id", "found", "model", "updated_at", F.size("messages").cast("bigint").alias("n_messages"),
                      *[F.when(F.size("messages") > 0, last[c]).alias(c) for c in ("role", "content", "meta")])


@register("session_saved")
def q_session_saved(spark, sf_dir):
    """The messages that every save of the log keeps."""
    saves = src.gw_session_log(spark, sf_dir).where("op = 'save'")
    kept = saves.select("session_id", "updated_at", F.explode(sess.worth_saving(sess.messages_of(F.col("payload")))).alias("m"))
    return kept.select("session_id", "updated_at", "m.*")


@register("preview_chars")
def q_preview_chars(spark, sf_dir):
    d = src.documents(spark, sf_dir)
    return d.select("doc_id", preview_chars("text", 120).alias("preview"),
                    preview_chars("text", 80, ellipsis=False).alias("preview80"),
                    F.length("text").cast("bigint").alias("n_chars"))


@register("preview_bytes")
def q_preview_bytes(spark, sf_dir):
    d = src.documents(spark, sf_dir)
    return d.select("doc_id", preview_bytes("text", 60).alias("preview"),
                    F.octet_length("text").cast("bigint").alias("n_bytes"))


# ---------------------------------------------------------------- cache table
def _cache_table(spark, sf_dir):
    return cache.upsert(cache.entries_from_pairs(src.gw_pairs(spark, sf_dir)))


@register("cache_upsert")
def q_cache_upsert(spark, sf_dir):
    c = _cache_table(spark, sf_dir)
    return c.select("key", "original_text", "response_text", F.col("seq.conv_id").alias("conv_id"),
                    F.col("seq.turn").alias("turn"))


@register("cache_list")
def q_cache_list(spark, sf_dir):
    return cache.list_entries(_cache_table(spark, sf_dir))


@register("cache_stats")
def q_cache_stats(spark, sf_dir):
    return cache.stats(_cache_table(spark, sf_dir), dim=DIM, threshold=TAU)


# ---------------------------------------------------------------- bodies and events
def _request_bodies(spark, sf_dir):
    """A request body for every user turn: the message with up to two before it. Conversations
    0 to 5 of every seven differ: numeric model, text after the value, cut short, last content
    a number, last content a list of parts, or a message that is no object."""
    conv = src.table(spark, sf_dir, "conversations")
    near = conv.withColumn("at", F.explode(F.array(F.col("turn"), F.col("turn") + 1, F.col("turn") + 2)))
    said = near.groupBy("conv_id", "at").agg(  # three messages at most
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    users = said.where((F.element_at("m", -1)["turn"] == F.col("at")) & (F.element_at("m", -1)["role"] == "user"))
    msgs = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    body = reqs.request_body(F.lit(config.DEFAULT_CHAT_MODEL), msgs, F.col("at") == 0)
    last = F.element_at("m", -1)["content"]
    parts = F.to_json(F.named_struct(F.lit("messages"), F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(
        F.lit("text").alias("type"), last.alias("text"))).alias("content")))))
    way = F.pmod("conv_id", F.lit(7))
    return users.select("conv_id", F.col("at").alias("turn"), F.when(way == 0, F.concat(
        F.lit('{"model":5,'), F.substr(body, F.lit(2)))).when(way == 1, F.concat(body, F.lit(" junk"))).when(
        way == 2, F.left(body, F.length(body) - 1)).when(way == 3, F.lit('{"messages":[{"role":"user","content":7}]}')).when(
        way == 4, parts).when(way == 5, F.lit('{"messages":["text"]}')).otherwise(body).alias("body"))


@register("request_parse")
def q_request_parse(spark, sf_dir):
    ok = reqs.accepted(reqs.parse_requests(_request_bodies(spark, sf_dir)))
    return ok.select("conv_id", "turn", "model", F.size("messages").cast("bigint").alias("n_messages"),
                     "stream", "prompt")


@register("request_rejected")
def q_request_rejected(spark, sf_dir):
    return reqs.rejected(reqs.parse_requests(_request_bodies(spark, sf_dir))).select("conv_id", "turn")


def _replies(spark, sf_dir):
    return src.table(spark, sf_dir, "conversations").where("role = 'assistant'")


def _sse_bodies(spark, sf_dir):
    """Every assistant text as a stream of pieces, with lines in between that hold no text."""
    chunks = F.regexp_extract_all(F.col("text"), F.lit("(?s).{1,24}"), 0)
    noise = F.lit('data: {"choices":[{"delta":{"content":5}}]}\n\ndata: {"choices":[]} junk\n: note\n'
                  'data: {"choices":[{"message":{"role":"assistant"}}]}\n')
    return _replies(spark, sf_dir).select("conv_id", "turn", F.concat(noise, jt.sse_body(chunks)).alias("body"))


@register("sse_text")
def q_sse_text(spark, sf_dir):
    return _sse_bodies(spark, sf_dir).select("conv_id", "turn", jt.sse_text("body").alias("text"))


@register("sse_chunks")
def q_sse_chunks(spark, sf_dir):
    """The same streams as the reads that they arrive in, put together again by line."""
    reads = ck.chunked(_sse_bodies(spark, sf_dir), "body")
    return ck.stream_text(reads, keys=("conv_id", "turn"))


@register("json_text")
def q_json_text(spark, sf_dir):
    """Every assistant text as a JSON body; every third turn's content is a number instead."""
    body = F.when(F.pmod("turn", F.lit(3)) == 0, F.lit('{"choices":[{"message":{"content":5}}]}')).otherwise(
        jt.json_body(F.col("text")))
    bodies = _replies(spark, sf_dir).select("conv_id", "turn", body.alias("body"))
    return bodies.select("conv_id", "turn", jt.json_text("body").alias("text"))


@register("event_decode")
def q_event_decode(spark, sf_dir):
    """The events of both writers, each in its spelling of times; of every eleventh hit and
    block also a copy that is cut short, which does not decode."""
    raw = ev.encode_events(tel.hit_events(src.gw_requests(spark, sf_dir))).unionByName(
        ev.encode_events(tel.pii_block_events(src.gw_pii(spark, sf_dir)), ev.iso_offset))
    both = raw.withColumn("json", F.explode(F.when(F.pmod(F.crc32(F.col("json").cast("binary")), F.lit(11)) == 0, F.array(
        F.col("json"), F.left("json", F.length("json") - 1))).otherwise(F.array(F.col("json")))))
    return tel.flat_metadata(ev.decode_events(both)).select(
        "type", "message", "detail", "timestamp", "ts", "meta_distance", "meta_latency", "meta_entity")


# ---------------------------------------------------------------- stored vectors
def word_buckets(texts: list[str], task: str) -> list[list[float]]:
    """A test embedder that SQL can repeat: words counted in eight buckets by their md5."""
    out = []
    for t in texts:
        counts = [0.0] * 8
        for w in filter(None, re.split("[^a-z0-9]+", t.lower())):
            counts[int(hashlib.md5(w.encode()).hexdigest()[0], 16) % 8] += 1.0
        out.append(counts)
    return out


@register("embed_new")
def q_embed_new(spark, sf_dir):
    """Messages embedded in two runs, first the users' and then all of them, the replies as
    documents: stored vectors by text and task, and the run that made them."""
    said = src.gw_messages(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/embed-{uuid.uuid4().hex}"
    task = F.when(F.col("role") == "user", emb.TASK_TYPE).otherwise("RETRIEVAL_DOCUMENT")
    emb.embed_new(said.where("role = 'user'"), path, 0, word_buckets, text="content", task_type=task, dim=8)
    first = tables.read(spark, path, emb.STORED, before=1).select("text_key", "task_type", F.lit(0).alias("run"))
    emb.embed_new(said, path, 1, word_buckets, text="content", task_type=task, dim=8)
    rows = tables.read(spark, path, emb.STORED).join(first, ["text_key", "task_type"], "left")
    return rows.select("text_key", "task_type", F.coalesce("run", F.lit(1)).alias("run"),
                       F.array_join(F.col("embedding").cast("array<int>").cast("array<string>"), " ").alias("buckets"))


# ---------------------------------------------------------------- PII
def _redacted_docs(spark, sf_dir):
    return pii.redact(src.documents(spark, sf_dir), "text")


@register("pii_redact")
def q_pii_redact(spark, sf_dir):
    return _redacted_docs(spark, sf_dir).select("doc_id", "sanitized_text")


@register("pii_entities")
def q_pii_entities(spark, sf_dir):
    return _redacted_docs(spark, sf_dir).select(
        "doc_id", F.array_join("entities", ",").alias("entities"), "has_pii")


@register("pii_matches")
def q_pii_matches(spark, sf_dir):
    m = pii.match_counts(src.documents(spark, sf_dir), "text")
    return m.drop("text")


@register("pii_cards_valid")
def q_pii_cards_valid(spark, sf_dir):
    return pii.card_checks(src.documents(spark, sf_dir), "text").drop("text")


def _with_numbers(spark, sf_dir):
    """Every document with an IBAN and a social security number put before its text. The IBAN's
    country and digits follow from the id; its check digits are right for even ids (98 less the
    remainder), and a fixed pair for the others."""
    account = F.lpad(F.pmod(F.col("doc_id") * 7919, F.lit(10**9)).cast("string"), 18, "0")
    number = F.concat(account, F.lit("131400")).cast("decimal(38,0)")  # DE, check digits 00
    check = F.when(F.col("doc_id") % 2 == 0, F.lpad((98 - number % 97).cast("int").cast("string"), 2, "0")).otherwise(F.lit("42"))
    lead = F.concat(F.lit("Pay to "), F.when(F.col("doc_id") % 5 == 0, F.lit("GB")).otherwise(F.lit("DE")), check, account,
                    F.lit(", ssn 123-45-"), F.lpad(F.pmod("doc_id", F.lit(10000)).cast("string"), 4, "0"), F.lit(". "))
    return src.documents(spark, sf_dir).withColumn("text", F.concat(lead, F.coalesce("text", F.lit(""))))


@register("pii_iban_valid")
def q_pii_iban_valid(spark, sf_dir):
    return pii.iban_checks(_with_numbers(spark, sf_dir), "text").drop("text")


@register("pii_redact_numbers")
def q_pii_redact_numbers(spark, sf_dir):
    """Which entities the cascade finds where every text holds an IBAN and a social security
    number, IBANs only if they pass their checksum."""
    got = pii.redact(_with_numbers(spark, sf_dir), "text", validate_ibans=True)
    return got.select("doc_id", F.array_join("entities", ",").alias("entities"))


@register("pii_events")
def q_pii_events(spark, sf_dir):
    return pii.block_events(_redacted_docs(spark, sf_dir), key="doc_id")


@register("pii_counts")
def q_pii_counts(spark, sf_dir):
    return pii.block_counts(pii.block_events(_redacted_docs(spark, sf_dir), key="doc_id"))


@register("pii_last_message")
def q_pii_last_message(spark, sf_dir):
    out = pii.last_message_only(src.gw_messages(spark, sf_dir))
    return out.select("conv_id", "turn", "role", "scrubbed", "sanitized",
                      F.array_join("entities", ",").alias("entities"))


@register("pii_spans")
def q_pii_spans(spark, sf_dir):
    return pii.spans(_with_numbers(spark, sf_dir), key="doc_id", text="text")


def _names(spark, sf_dir):
    """A list of names: the first one, two or three words of every message."""
    conv = src.table(spark, sf_dir, "conversations")
    return conv.select(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}_]+"), 0), F.lit(1), F.pmod(
        F.col("conv_id") + F.col("turn"), F.lit(3)).cast("int") + 1), " ").alias("name"))


@register("pii_person")
def q_pii_person(spark, sf_dir):
    return gazetteer.person_spans(src.documents(spark, sf_dir), _names(spark, sf_dir)).select("doc_id", "entity", "start", "end", "value")


# ---------------------------------------------------------------- streaming forms, drained
def _request_stream(spark, sf_dir):
    return src.gw_requests(spark, sf_dir, src.stream(spark, sf_dir, "events"))


@register("stream_traffic")
def q_stream_traffic(spark, sf_dir):
    return sq.drained(sq.traffic_by_minute(_request_stream(spark, sf_dir)), "complete")


@register("stream_runs")
def q_stream_runs(spark, sf_dir):
    runs = sq.drained(sq.latency_runs(_request_stream(spark, sf_dir), RUN_GAP), "complete")
    return runs.select("run_start", "n_requests", "sum_latency_ms", _r("avg_latency_ms", 6))


@register("stream_counters")
def q_stream_counters(spark, sf_dir):
    return sq.drained(sq.counters(_request_stream(spark, sf_dir)), "complete").select(
        "total_requests", "cache_hits", "cache_misses", "tokens_saved", _r("estimated_cost_saved", 6),
        _r("cache_hit_rate", 6))


@register("stream_redaction")
def q_stream_redaction(spark, sf_dir):
    docs = src.stream(spark, sf_dir, "documents").select("doc_id", "text")
    return sq.drained(sq.redaction(docs, "text").select("doc_id", "sanitized_text"))


# ---------------------------------------------------------------- composite flows
@register("replay_metrics")
def q_replay_metrics(spark, sf_dir):
    r = replay.cache_replay(src.vec_log(spark, sf_dir), TAU, dim=DIM, id_col="vec_id")
    m = gw.replay_metrics(r)
    return m.select("total_requests", "cache_hits", "cache_misses", "entries_stored", "tokens_saved",
                    _r("estimated_cost_saved", 6), _r("cache_hit_rate", 6))


def _request_id():
    """Conversation and turn as one id, whatever their lengths."""
    return F.concat_ws("-", "conv_id", "turn")


GATEWAY_TAU = config.DISTANCE_THRESHOLD


def gateway_requests(spark, sf_dir):
    """Requests of the gateway flow: every (prompt, reply) pair in conversation
    order, prompts embedded by the deterministic hashed test embedder."""
    pairs = src.gw_pairs(spark, sf_dir).select("*", _request_id().alias("request_id"),
                                                        F.struct("conv_id", "turn").alias("seq"))
    return emb.hashed_embedder(pairs, "prompt", "embedding", dim=DIM)


@register("gateway_flow")
def q_gateway_flow(spark, sf_dir):
    res = gw.gateway_flow(gateway_requests(spark, sf_dir), GATEWAY_TAU, dim=DIM)
    return res.outcomes.select("request_id", "cache", "match_id", _r("similarity", 4), "pii_detected",
                               "pii_entities", "stored")


@register("neighbor_counts")
def q_neighbor_counts(spark, sf_dir):
    log = src.vec_log(spark, sf_dir)
    c = vec.neighbor_counts(log, log, TAU, query_id="vec_id", query_vec="embedding",
                            cache_key="vec_id", cache_vec="embedding", order="vec_id", dim=DIM)
    return c.select("vec_id", "n_within", F.col("match_key").alias("nearest_id"), _r("distance", 4))


@register("cache_lookup")
def q_cache_lookup(spark, sf_dir):
    """Every user message looked up against the cache built from the prompt/reply
    pairs (hashed test embedder, gateway threshold)."""
    entries = cache.upsert(cache.entries_from_pairs(src.gw_pairs(spark, sf_dir)))
    entries = emb.hashed_embedder(entries, "original_text", "embedding", dim=DIM)
    users = src.gw_messages(spark, sf_dir).where(F.col("role") == "user").select(
        _request_id().alias("request_id"), F.col("content"))
    users = emb.hashed_embedder(users, "content", "embedding", dim=DIM)
    out = vec.cache_lookup(users, entries, GATEWAY_TAU, request_id="request_id", cache_key="key", dim=DIM)
    return out.select("request_id", "outcome", _r("distance", 4), "match_key", "matched_prompt",
                      F.length("response").cast("bigint").alias("response_chars"))
