"""Request telemetry over a request log.

The gateway keeps running counters, minute buckets with a TTL, a latency
sum/count with an idle expiry and a bounded event list. Here all of them are
derived from the log itself with aggregations, so there is no mutable state to
keep consistent: counters are one partial+final aggregation, the activity runs
are a gap sessionisation, the feed is a top-k.

Request log columns: ``request_id, ts, outcome ('HIT'|'MISS'), latency_ms,
distance`` (+ optional tenant). PII-block log: ``event_id, ts, entity, message``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import go_quote, preview_bytes
from ..functions.timefmt import epoch_micros, interval_seconds, minute_bucket, ts_literal
from ..session import ensure_checkpoint_dir


def _is_hit(outcome: str = "outcome") -> Column:
    return F.col(outcome) == F.lit("HIT")


# ---------------------------------------------------------------- activity runs
SEGMENT_BUCKETS = 100_000


def _materialize(small: DataFrame) -> DataFrame:
    """Write a small shared intermediate (the per-bucket aggregate, at most
    time span / gap rows) to the reliable checkpoint directory, so its several
    consumers read it instead of re-scanning the log; also cuts the lineage."""
    ensure_checkpoint_dir(small.sparkSession)
    return small.checkpoint(eager=True)


def bucket_of(ts: Column | str, gap_us: int) -> Column:
    """Start (epoch microseconds) of the gap-sized bucket holding ``ts``."""
    micros = epoch_micros(ts)
    return micros - F.pmod(micros, F.lit(gap_us))


def runs_from_buckets(buckets: DataFrame, gap: str | int, *, keys: tuple[str, ...] = (),
                      segment_buckets: int = SEGMENT_BUCKETS, stored: bool = False) -> DataFrame:
    """Activity runs from per-bucket aggregates ``_bucket, _n, _sum, _first, _last``.

    Ordered windows run per time segment of buckets (per key) in parallel; a
    one-row-per-segment summary gives each segment the boundary flag of its
    first bucket and its run-number offset (a prefix sum over segments).
    ``stored``: the buckets are materialised already.
    """
    gap_us = interval_seconds(gap) * 1_000_000
    seg_us = gap_us * segment_buckets
    b = (buckets if stored else _materialize(buckets)).withColumn(
        "_seg", F.col("_bucket") - F.pmod(F.col("_bucket"), F.lit(seg_us)))
    w = Window.partitionBy(*keys, "_seg").orderBy("_bucket")
    prev_last = F.lag("_last").over(w)
    boundary = F.timestamp_diff("MICROSECOND", prev_last, F.col("_first")) >= F.lit(gap_us)
    local = (b.withColumn("_new", F.when(prev_last.isNotNull() & boundary, 1).otherwise(0))
             .withColumn("_local", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    seg = local.groupBy(*keys, "_seg").agg(
        F.min("_first").alias("_seg_first"), F.max("_last").alias("_seg_last"),
        F.sum("_new").alias("_seg_new"))
    ws = Window.partitionBy(*keys).orderBy("_seg")
    prev_seg_last = F.lag("_seg_last").over(ws)
    seg = (seg
           .withColumn("_head_new", F.when(
               prev_seg_last.isNull()
               | (F.timestamp_diff("MICROSECOND", prev_seg_last, F.col("_seg_first")) >= F.lit(gap_us)), 1)
               .otherwise(0))
           .withColumn("_offset", F.sum(F.col("_head_new") + F.col("_seg_new")).over(
               ws.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_seg_new"))
           .select(*keys, "_seg", "_offset"))
    numbered = local.join(seg, [*keys, "_seg"]).withColumn(
        "run_id", (F.col("_offset") + F.col("_local")).cast("bigint"))
    return numbered.groupBy(*keys, "run_id").agg(
        F.min("_first").alias("run_start"),
        F.max("_last").alias("run_end"),
        F.sum("_n").cast("bigint").alias("n_requests"),
        F.sum("_sum").cast("bigint").alias("sum_latency_ms"),
    ).withColumn("avg_latency_ms", F.col("sum_latency_ms") / F.col("n_requests"))


def latency_runs(requests: DataFrame, gap: str | int = config.LATENCY_IDLE_GAP, *,
                 ts: str = "ts", latency: str = "latency_ms",
                 keys: tuple[str, ...] = (), segment_buckets: int = SEGMENT_BUCKETS) -> DataFrame:
    """Split the log into activity runs separated by idle gaps >= ``gap``.

    Exact, and without any single-partition step over requests: rows are
    pre-aggregated into gap-sized time buckets (two events in one bucket are
    always < gap apart, so a run boundary can only fall between the last event
    of a non-empty bucket and the first of the next), then
    :func:`runs_from_buckets` numbers runs segment by segment.
    """
    gap_us = interval_seconds(gap) * 1_000_000
    buckets = (
        requests.select(*keys, F.col(ts).alias("_ts"), F.col(latency).alias("_lat"),
                        bucket_of(ts, gap_us).alias("_bucket"))
        .groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_lat").alias("_sum"),
             F.min("_ts").alias("_first"), F.max("_ts").alias("_last")))
    return runs_from_buckets(buckets, gap, keys=keys, segment_buckets=segment_buckets)


def _open_run(runs: DataFrame, as_of: str, gap_us: int) -> DataFrame:
    """One row: size and mean latency of the run still open at ``as_of`` (zeros if none)."""
    last = runs.agg(F.max_by(F.struct("run_end", "n_requests", "sum_latency_ms"), "run_end").alias("r"))
    open_run = F.timestamp_diff("MICROSECOND", F.col("r.run_end"), ts_literal(as_of)) < F.lit(gap_us)
    return last.select(
        ts_literal(as_of).alias("as_of"),
        F.coalesce(F.when(open_run, F.col("r.n_requests")), F.lit(0)).cast("bigint").alias("n_requests"),
        F.coalesce(F.when(open_run, F.col("r.sum_latency_ms") / F.col("r.n_requests")),
                   F.lit(0.0)).alias("avg_latency_ms"))


def current_latency(requests: DataFrame, as_of: str, gap: str | int = config.LATENCY_IDLE_GAP,
                    *, ts: str = "ts", latency: str = "latency_ms") -> DataFrame:
    """Mean latency of the run still open at ``as_of`` (0 when idle >= gap or empty).

    Always one row: the latency counters expire ``gap`` after the last write.
    """
    gap_us = interval_seconds(gap) * 1_000_000
    runs = latency_runs(requests.where(F.col(ts) <= ts_literal(as_of)), gap, ts=ts, latency=latency)
    return _open_run(runs, as_of, gap_us)


# ---------------------------------------------------------------- counters
def metrics(requests: DataFrame, pii_blocks: DataFrame | None = None, *, as_of: str,
            gap: str | int = config.LATENCY_IDLE_GAP,
            tokens_per_hit: int = config.TOKENS_PER_HIT,
            cost_per_token: float = config.COST_PER_TOKEN) -> DataFrame:
    """Dashboard metrics as one row (counters, hit rate, tokens/cost saved, latency).

    One scan per input: requests and PII blocks are stacked and reduced to
    gap-sized time buckets once (materialised: at most span / gap rows); the
    counters are the sum over buckets and the open-run latency comes from the
    same buckets. The counter row and the latency row are stacked again and reduced
    by one conditional aggregation (no join of one-row frames). Empty input
    gives zeros, never nulls.
    """
    gap_us = interval_seconds(gap) * 1_000_000
    upto = ts_literal(as_of)
    rows = requests.where(F.col("ts") <= upto).select(
        F.lit(True).alias("_req"), F.col("outcome"), F.col("latency_ms"), F.col("ts"))
    if pii_blocks is not None:
        rows = rows.unionByName(pii_blocks.where(F.col("ts") <= upto).select(
            F.lit(False).alias("_req"), F.lit(None).cast("string").alias("outcome"),
            F.lit(None).cast("bigint").alias("latency_ms"), F.col("ts")))
    req = F.col("_req")
    buckets = _materialize(rows.groupBy(bucket_of("ts", gap_us).alias("_bucket")).agg(
        F.count_if(req).alias("_n"),
        F.count_if(req & _is_hit()).alias("_hits"),
        F.count_if(req & (F.col("outcome") == "MISS")).alias("_misses"),
        F.count_if(~req).alias("_pii"),
        F.sum(F.when(req, F.col("latency_ms"))).alias("_sum"),
        F.min(F.when(req, F.col("ts"))).alias("_first"),
        F.max(F.when(req, F.col("ts"))).alias("_last")))
    totals = buckets.select(
        F.col("_n").alias("total"), F.col("_hits").alias("hits"), F.col("_misses").alias("misses"),
        F.col("_pii").alias("pii"), F.lit(None).cast("double").alias("avg"))
    latency = _open_run(runs_from_buckets(buckets.where(F.col("_n") > 0), gap, stored=True), as_of, gap_us).select(
        *[F.lit(0).cast("bigint").alias(c) for c in ("total", "hits", "misses", "pii")],
        F.col("avg_latency_ms").alias("avg"))
    agg = totals.unionByName(latency).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_requests"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("cache_hits"),
        F.coalesce(F.sum("misses"), F.lit(0)).alias("cache_misses"),
        F.coalesce(F.sum("pii"), F.lit(0)).alias("pii_blocked"),
        F.coalesce(F.max("avg"), F.lit(0.0)).alias("avg_latency_ms"))
    total = F.col("total_requests")
    return agg.select(
        total.cast("bigint").alias("total_requests"),
        F.col("cache_hits").cast("bigint").alias("cache_hits"),
        F.col("cache_misses").cast("bigint").alias("cache_misses"),
        F.col("pii_blocked").cast("bigint").alias("pii_blocked"),
        "avg_latency_ms",
        (F.col("cache_hits") * F.lit(tokens_per_hit)).cast("bigint").alias("tokens_saved"),
        (F.col("cache_hits") * F.lit(tokens_per_hit) * F.lit(cost_per_token)).alias("estimated_cost_saved"),
        F.when(total > 0, F.col("cache_hits") / total * F.lit(100.0)).otherwise(F.lit(0.0))
        .alias("cache_hit_rate"),
        F.lit(1).alias("active_tenants"),
    )


def traffic_by_minute(requests: DataFrame) -> DataFrame:
    """Per-minute total requests and hits (minute key yyyyMMddHHmm)."""
    return requests.groupBy(minute_bucket("ts").alias("bucket")).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_requests"),
        F.count_if(_is_hit()).cast("bigint").alias("cache_hits"))


def timeline(requests: DataFrame, as_of: str, minutes: int = config.TIMELINE_MINUTES) -> DataFrame:
    """The last ``minutes`` one-minute points up to ``as_of``, zero-filled.

    Only rows inside the window are scanned (the range filter reaches the
    Parquet reader); the per-minute aggregate has at most ``minutes`` rows, so
    broadcasting it to the spine is size-bounded by the parameter.
    """
    if minutes <= 0:
        minutes = config.TIMELINE_MINUTES
    spark = requests.sparkSession
    end = ts_literal(as_of)
    first_minute = F.date_trunc("minute", F.timestamp_add("MINUTE", F.lit(-(minutes - 1)), end))
    window_end = F.timestamp_add("MINUTE", F.lit(1), F.date_trunc("minute", end))
    counts = traffic_by_minute(
        requests.where((F.col("ts") >= first_minute.cast("timestamp_ntz"))
                       & (F.col("ts") < window_end.cast("timestamp_ntz"))))
    spine = spark.range(minutes).select(
        F.col("id").alias("point"),
        F.timestamp_add("MINUTE", F.col("id") - F.lit(minutes - 1), end).alias("_t"))
    spine = spine.select("point", F.date_format("_t", "HH:mm").alias("time"),
                         minute_bucket("_t").alias("bucket"))
    return spine.join(F.broadcast(counts), "bucket", "left").select(
        "point", "time", "bucket",
        F.coalesce("total_requests", F.lit(0)).cast("bigint").alias("total_requests"),
        F.coalesce("cache_hits", F.lit(0)).cast("bigint").alias("cache_hits"))


# ---------------------------------------------------------------- events
EVENT_COLUMNS = ["event_id", "ts", "type", "message", "detail", "metadata"]


def hit_events(requests: DataFrame, matched_prompt: str | None = None) -> DataFrame:
    """One 'cache_hit' event per hit: distance to 4 decimals, latency, matched prompt preview."""
    hits = requests.where(_is_hit())
    dist = F.format_string("%.4f", F.col("distance"))
    lat = F.col("latency_ms").cast("string")
    if matched_prompt is not None:
        detail = F.concat(F.lit("Matched: "), go_quote(preview_bytes(F.col(matched_prompt),
                                                                      config.HIT_PREVIEW_BYTES)),
                          F.lit(" · "), lat, F.lit("ms"))
    else:
        detail = F.concat(F.lit("Latency: "), lat, F.lit("ms"))
    return hits.select(
        F.col("request_id").alias("event_id"), "ts", F.lit("cache_hit").alias("type"),
        F.concat(F.lit("Cache HIT · distance "), dist).alias("message"),
        detail.alias("detail"),
        F.create_map(F.lit("distance"), dist, F.lit("latency"), lat).alias("metadata"))


def pii_block_events(pii_blocks: DataFrame) -> DataFrame:
    """One 'pii_blocked' event per (request, entity)."""
    return pii_blocks.select(
        "event_id", "ts", F.lit("pii_blocked").alias("type"), "message",
        F.concat(F.lit("Entity: "), F.col("entity")).alias("detail"),
        F.create_map(F.lit("entity"), F.col("entity")).alias("metadata"))


def all_events(*writers: DataFrame) -> DataFrame:
    """Events from several writers into one log (UNION ALL by name)."""
    out = writers[0].select(*EVENT_COLUMNS)
    for w in writers[1:]:
        out = out.unionByName(w.select(*EVENT_COLUMNS), allowMissingColumns=True)
    return out


def newest_events(events: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` events, newest first. A per-partition top-n then one merge of
    at most n rows per partition (TakeOrderedAndProject); n <= 0 gives none."""
    if n <= 0:
        return events.limit(0)
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def event_ring(events: DataFrame, size: int = config.EVENT_RING_SIZE) -> DataFrame:
    return newest_events(events, size)


def event_feed(events: DataFrame, limit: int = config.EVENT_FEED_LIMIT,
               ring_size: int = config.EVENT_RING_SIZE) -> DataFrame:
    """What the dashboard reads: the first ``limit`` entries of the ring."""
    return newest_events(events, min(limit, ring_size))


def flat_metadata(events: DataFrame) -> DataFrame:
    """Metadata map as plain columns (for tables that cannot hold maps)."""
    return events.select(
        *[c for c in events.columns if c != "metadata"],
        F.element_at("metadata", F.lit("distance")).alias("meta_distance"),
        F.element_at("metadata", F.lit("latency")).alias("meta_latency"),
        F.element_at("metadata", F.lit("entity")).alias("meta_entity"))


def request_outcome(requests: DataFrame, entities: str | None = None) -> DataFrame:
    """Per-request outcome record: cache label, latency, similarity on hits, PII flags."""
    ents = F.col(entities) if entities else F.array().cast("array<string>")
    return requests.select(
        "request_id", "ts", F.col("outcome").alias("cache"), "latency_ms",
        F.when(_is_hit(), F.col("distance")).alias("similarity"),
        (F.size(ents) > 0).alias("pii_detected"),
        F.concat_ws(",", ents).alias("pii_entities"))
