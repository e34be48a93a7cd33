"""Composite flows: a whole request log through the gateway, as DataFrames.

``replay_metrics`` (counters of a replayed log) and ``gateway_flow``
(extract -> key -> embed -> replay the cache -> scrub misses -> outcome,
events and the new cache table). No upstream model is called: responses are
an input column. PII is scrubbed after the lookup and the cache keeps the raw
prompt (the gateway's order); ``redact_before_cache=True`` stores the
scrubbed prompt instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import GatewayParams
from ..functions.text import prompt_key, ws_trim
from ..operators import cache as cache_ops
from ..operators import pii as pii_ops
from ..operators import telemetry as tel
from ..operators.replay import cache_replay
from ..session import materialise


def replay_metrics(replayed: DataFrame, *, tokens_per_hit: int = config.TOKENS_PER_HIT,
                   cost_per_token: float = config.COST_PER_TOKEN) -> DataFrame:
    """Counters, tokens/cost saved and hit rate of a replayed log (one row)."""
    hit = F.col("outcome") == "HIT"
    stored = F.col("stored") if "stored" in replayed.columns else ~hit
    agg = replayed.agg(F.count(F.lit(1)).alias("total_requests"), F.count_if(hit).alias("cache_hits"),
                       F.count_if(~hit).alias("cache_misses"), F.count_if(stored).alias("stored"))
    total = F.col("total_requests")
    return agg.select(
        total.cast("bigint").alias("total_requests"), F.col("cache_hits").cast("bigint").alias("cache_hits"),
        F.col("cache_misses").cast("bigint").alias("cache_misses"),
        F.col("stored").cast("bigint").alias("entries_stored"),
        (F.col("cache_hits") * F.lit(tokens_per_hit)).cast("bigint").alias("tokens_saved"),
        (F.col("cache_hits") * F.lit(tokens_per_hit) * F.lit(cost_per_token)).alias("estimated_cost_saved"),
        F.when(total > 0, F.col("cache_hits") / total * F.lit(100.0)).otherwise(F.lit(0.0))
        .alias("cache_hit_rate"))


@dataclass
class GatewayResult:
    outcomes: DataFrame   # one row per request: cache label, match, PII flags
    events: DataFrame     # hit and PII-block events (M8 columns)
    cache: DataFrame      # the cache table after the log


def gateway_flow(requests: DataFrame, threshold: float, *, id_col: str = "request_id",
                 order_col: str = "seq", prompt: str = "prompt", response: str = "response",
                 dim: int, embedding: str = "embedding", initial: DataFrame | None = None,
                 latency: str | None = None, available: str | None = None, ts: str | None = None, status: str | None = None,
                 cache_errors: bool = False, redact_before_cache: bool = False,
                 validate_cards: bool = False) -> GatewayResult:
    """Run a request log through the cache, in arrival order.

    ``requests``: ``id_col, order_col, prompt, response, embedding`` (+ ``ts``,
    + ``status`` of the upstream reply). Empty prompts are never looked up or
    stored (always a MISS). With ``status`` given, only 200 replies are cached
    unless ``cache_errors=True`` (the gateway also caches error bodies).
    ``initial`` (``key, embedding, original_text``) is the cache left by an earlier
    log; its keys have the type of the request ids. ``latency`` names the
    milliseconds of a request, ``available`` when its entry becomes visible (in
    units of the order). ``dim`` is the dimension of the vectors.
    """
    base = requests.select(
        F.col(id_col).alias("request_id"), F.col(order_col).alias("seq"),
        F.coalesce(F.col(prompt), F.lit("")).alias("prompt"), F.col(response).alias("response"),
        F.col(embedding).alias("embedding"),
        (F.col(ts) if ts else F.lit(None).cast("timestamp_ntz")).alias("ts"),
        (F.col(latency).cast("bigint") if latency else F.lit(0).cast("bigint")).alias("latency_ms"),
        *([F.col(available).alias("available")] if available else []),
        (F.col(status).cast("int") if status else F.lit(200)).alias("status"))
    # The request frame feeds the replay, the decision join and the matched-prompt
    # join; write it once instead of recomputing its lineage (parsing, embedding)
    # three times.
    base = materialise(base, "gateway-requests")
    # Only non-empty prompts with a vector are looked up; only those with a
    # non-blank response can be stored.
    lookable = base.where((F.col("prompt") != "") & (F.coalesce(F.size("embedding"), F.lit(0)) > 0))
    storable = F.length(ws_trim(F.coalesce("response", F.lit("")))) > 0
    if not cache_errors:
        storable &= F.coalesce(F.col("status") == 200, F.lit(False))
    lookable = lookable.withColumn("storable", storable)
    replayed = cache_replay(lookable, threshold, id_col="request_id", vec_col="embedding",
                            order_col="seq", storable_col="storable", dim=dim,
                            available_col="available" if available else None,
                            initial=None if initial is None else initial.select("key", "embedding"))
    replayed = materialise(replayed, "gateway-replay")  # read by every result below
    decided = base.join(replayed.withColumnRenamed("id", "request_id"), "request_id", "left").select(
        "request_id", "seq", "ts", "latency_ms", "prompt", "response", "embedding",
        F.coalesce("outcome", F.lit("MISS")).alias("outcome"),
        F.coalesce("stored", F.lit(False)).alias("stored"), "match_id", "distance")
    matched = base.select(F.col("request_id").alias("match_id"), F.col("prompt").alias("matched_prompt"))
    if initial is not None:
        matched = matched.unionByName(initial.select(F.col("key").alias("match_id"),
                                                     F.col("original_text").alias("matched_prompt")))
    # Hits are answered from the cache; only misses reach the worker, which scrubs
    # their prompt (the last message).
    hits = (decided.where(F.col("outcome") == "HIT").join(matched, "match_id", "left")
            .withColumn("sanitized_text", F.col("prompt")).withColumn("has_pii", F.lit(False))
            .withColumn("entities", F.array().cast("array<string>")))
    scrubbed = pii_ops.redact(decided.where(F.col("outcome") == "MISS"), "prompt", validate_cards=validate_cards)
    both = hits.unionByName(scrubbed, allowMissingColumns=True)
    outcomes = both.select(
        "request_id", "seq", "ts", F.col("outcome").alias("cache"), "match_id", "matched_prompt",
        F.when(F.col("outcome") == "HIT", F.col("distance")).alias("similarity"),
        F.col("has_pii").alias("pii_detected"), F.concat_ws(",", "entities").alias("pii_entities"),
        F.col("sanitized_text").alias("forwarded_prompt"), "latency_ms", "stored", "prompt", "response", "embedding")
    hit_rows = hits.select("request_id", "ts", F.lit("HIT").alias("outcome"), "latency_ms", "distance", "matched_prompt")
    pii_ev = pii_ops.block_events(scrubbed, key="request_id", carry=("ts",)).select(
        F.col("request_id").alias("event_id"), "ts", "entity", "message")
    events = tel.all_events(tel.hit_events(hit_rows, matched_prompt="matched_prompt"),
                            tel.pii_block_events(pii_ev))
    stored_prompt = F.col("forwarded_prompt") if redact_before_cache else F.col("prompt")
    writes = outcomes.where("stored").select(
        prompt_key(stored_prompt).alias("key"), stored_prompt.alias("original_text"),
        ws_trim("response").alias("response_text"), "embedding", F.col("seq").alias("seq"))
    return GatewayResult(outcomes=outcomes, events=events, cache=cache_ops.upsert(writes))


def dashboard_tables(requests: DataFrame, pii_blocks: DataFrame, cache: DataFrame, *, as_of: str,
                     params: GatewayParams | None = None) -> dict[str, DataFrame]:
    """The dashboard snapshot as one result table per panel (no nested document):
    metrics, event feed (hit and PII-block events), timeline, cache stats and
    cache listing. Every panel is lazy; each is its own plan over the inputs."""
    p = params or GatewayParams()
    events = tel.all_events(tel.hit_events(requests), tel.pii_block_events(pii_blocks))
    return {
        "metrics": tel.metrics(requests, pii_blocks, as_of=as_of, gap=p.latency_gap,
                               tokens_per_hit=p.tokens_per_hit, cost_per_token=p.cost_per_token),
        "events": tel.event_feed(events.where(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz")),
                                 p.feed_limit, p.ring_size),
        "timeline": tel.timeline(requests, as_of, p.timeline_minutes),
        "cache_stats": cache_ops.stats(cache, dim=p.dim, threshold=p.threshold, model=p.model),
        "cache_entries": cache_ops.list_entries(cache, p.list_limit, p.preview_chars),
    }
