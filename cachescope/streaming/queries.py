"""Structured Streaming forms of the operators.

Stateless operators (redaction, outcome labelling, event formatting) are the
batch functions applied to a streaming DataFrame. Stateful ones use Spark's
own state: tumbling windows with a watermark (the minute buckets and their
2-hour TTL), session windows (activity runs), a global streaming aggregation
(counters). Order-dependent or table-rewriting ones (cache lookup + store,
event ring, session state) run in ``foreachBatch`` against per-batch tables
(:mod:`cachescope.streaming.tables`), reusing the batch operators on each
micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.timefmt import interval_seconds, minute_bucket
from ..operators import cache as cache_ops
from ..operators import pii as pii_ops
from ..operators import sessions as sess
from ..operators import telemetry as tel
from ..operators.replay import cache_replay
from ..session import materialise, new_folder
from . import tables


# ------------------------------------------------------------ sources / triggers
def file_stream(spark, path: str, schema, fmt: str = "parquet", max_files: int | None = None
                ) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def start(df: DataFrame, checkpoint: str, *, sink: Callable | None = None, fmt: str = "memory",
          name: str | None = None, mode: str = "append", trigger: str | None = None,
          available_now: bool = False, path: str | None = None):
    """Start a query: ``sink`` -> foreachBatch, else the given format.
    ``trigger='5 seconds'`` is the dashboard refresh rate; ``available_now``
    drains what is there and stops (backfills, tests)."""
    w = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger:
        w = w.trigger(processingTime=trigger)
    if sink is not None:
        w = w.foreachBatch(sink)
    else:
        w = w.format(fmt)
        if name:
            w = w.queryName(name)
        if path:
            w = w.option("path", path)
    return w.start()


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over all that is there (available-now), into tables of the
    session's checkpoint folder, and return what it has written: all rows in append
    mode, the newest state in complete mode."""
    spark = df.sparkSession
    path = new_folder(spark, "stream")
    start(df, f"{path}/state", sink=lambda batch, batch_id: tables.append(batch, f"{path}/rows", batch_id),
          mode=mode, available_now=True).awaitTermination()
    return (tables.read if mode == "append" else tables.read_newest)(spark, f"{path}/rows", df.schema)


# ------------------------------------------------------------ T1 / T2 / T8 / T7
def _event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; naive UTC event times are cast (the session
    zone is UTC, so the instant is unchanged)."""
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


def traffic_by_minute(requests: DataFrame, retention: str = config.BUCKET_TTL) -> DataFrame:
    """Per-minute total/hits; a bucket's state is dropped ``retention`` after
    its end (the bucket TTL). Rows later than the watermark are dropped."""
    hit = F.col("outcome") == "HIT"
    agg = (_event_time(requests).withWatermark("ts", retention)
           .groupBy(F.window("ts", "1 minute").alias("w"))
           .agg(F.count(F.lit(1)).alias("total_requests"), F.count_if(hit).alias("cache_hits")))
    return agg.select(minute_bucket(F.col("w.start")).alias("bucket"),
                      F.col("total_requests").cast("bigint").alias("total_requests"),
                      F.col("cache_hits").cast("bigint").alias("cache_hits"))


def latency_runs(requests: DataFrame, gap: str = config.LATENCY_IDLE_GAP,
                 keys: tuple[str, ...] = ()) -> DataFrame:
    """Activity runs as session windows, kept until the watermark passes the
    gap. The state per run is two numbers (count, sum), not rows. Without
    ``keys`` (the gateway's single global counter) every event meets in one
    state partition; pass tenant keys to spread the stream."""
    # Spark merges sessions that touch; a request exactly one gap later starts a new run.
    short = f"{interval_seconds(gap) * 1_000_000 - 1} microseconds"
    grouping = [F.col(k) for k in keys] or [F.col("ts").isNotNull().alias("_all")]
    agg = (_event_time(requests).withWatermark("ts", gap)
           .groupBy(*grouping, F.session_window("ts", short).alias("s"))
           .agg(F.count(F.lit(1)).alias("n_requests"), F.sum("latency_ms").alias("sum_latency_ms")))
    return agg.select(*keys, F.col("s.start").cast("timestamp_ntz").alias("run_start"),
                      (F.col("s.end") + F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp_ntz").alias("window_end"),
                      F.col("n_requests").cast("bigint").alias("n_requests"),
                      F.col("sum_latency_ms").cast("bigint").alias("sum_latency_ms"),
                      (F.col("sum_latency_ms") / F.col("n_requests")).alias("avg_latency_ms"))


def counters(requests: DataFrame, *, tokens_per_hit: int = config.TOKENS_PER_HIT,
             cost_per_token: float = config.COST_PER_TOKEN) -> DataFrame:
    """Running counters (complete or update mode)."""
    hit = F.col("outcome") == "HIT"
    agg = requests.agg(F.count(F.lit(1)).alias("total_requests"), F.count_if(hit).alias("cache_hits"),
                       F.count_if(F.col("outcome") == "MISS").alias("cache_misses"))
    total = F.col("total_requests")
    return agg.select(
        total.cast("bigint").alias("total_requests"), F.col("cache_hits").cast("bigint").alias("cache_hits"),
        F.col("cache_misses").cast("bigint").alias("cache_misses"),
        (F.col("cache_hits") * F.lit(tokens_per_hit)).cast("bigint").alias("tokens_saved"),
        (F.col("cache_hits") * F.lit(tokens_per_hit) * F.lit(cost_per_token)).alias("estimated_cost_saved"),
        F.when(total > 0, F.col("cache_hits") / total * F.lit(100.0)).otherwise(F.lit(0.0))
        .alias("cache_hit_rate"))


def redaction(messages: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The batch redaction, stateless on the stream."""
    return pii_ops.redact(messages, text, **kw)


# ------------------------------------------------------------ T4 event ring
def event_ring_sink(ring_path: str, size: int = config.EVENT_RING_SIZE) -> Callable:
    """T4: keep the newest ``size`` events: the ring before this batch and the batch
    make the ring of this batch, a small table of its own."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        events = batch.select(*tel.EVENT_COLUMNS)
        old = tables.read_newest(batch.sparkSession, ring_path, events.schema, before=batch_id)
        tables.append(tel.newest_events(old.unionByName(events), size), ring_path, batch_id)

    return sink


def read_ring(spark, ring_path: str, schema) -> DataFrame:
    return tables.read_newest(spark, ring_path, schema)


# ------------------------------------------------------------ T5 / T6 cache lookup + store
def cache_lookup_sink(cache_path: str, out_path: str, threshold: float, *, dim: int,
                      id_col: str = "request_id", vec_col: str = "embedding",
                      order_col: str | None = None, compact_every: int = 50) -> Callable:
    """T5+T6: each micro-batch is replayed in arrival order against the cache as the
    batches before it left it (R1 with a warm cache), and its new entries are stored.

    The cache table holds ``key, embedding``; outcomes go to ``out_path``. Both are
    keyed by the batch, and the snapshot ends before it, so a retried batch repeats
    its result whatever its first attempt had written. Every ``compact_every`` batches
    the cache is written as one copy, so that lookups don't read ever more tiny files.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        reqs = batch.select(F.col(id_col).alias("key"), F.col(vec_col).alias("embedding"))
        snapshot = tables.read(spark, cache_path, reqs.schema, before=batch_id)
        done = materialise(cache_replay(batch, threshold, dim=dim, id_col=id_col, vec_col=vec_col, order_col=order_col,
                                        initial=snapshot), "lookup")
        tables.append(done.select(F.col("id").alias(id_col), "outcome", "match_id", "distance"), out_path, batch_id)
        new = done.where("stored").select(F.col("id").alias("key"))
        tables.append(reqs.join(new, "key", "left_semi"), cache_path, batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            tables.compact(spark, cache_path, reqs.schema, batch_id)

    return sink


# ------------------------------------------------------------ T3 session state
SESSION_LOG_SCHEMA = ("session_id string, updated_at timestamp_ntz, op string, payload string, "
                      "model string")


def session_log_sink(log_path: str) -> Callable:
    """Append saves/deletes to the session log; a session's state is its
    latest row, TTL applied at read time (:func:`load_sessions`)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        tables.append(batch.select("session_id", "updated_at", "op", "payload", "model"), log_path, batch_id)

    return sink


def load_sessions(spark, log_path: str, requested: DataFrame, as_of: str, **kw) -> DataFrame:
    return sess.load(requested, tables.read(spark, log_path, SESSION_LOG_SCHEMA), as_of, **kw)


def cache_upsert_sink(log_path: str) -> Callable:
    """T6 for keyed text entries: append the batch's writes (``key, ...,
    seq``) to the cache write log. Nothing is rewritten per batch; the cache
    table is the latest write per key, resolved when read (:func:`read_cache`)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        tables.append(batch, log_path, batch_id)

    return sink


def read_cache(spark, log_path: str, schema) -> DataFrame:
    """The cache table behind :func:`cache_upsert_sink`: latest write per key
    (``max_by``, combinable, so a hot key is reduced map-side)."""
    return cache_ops.upsert(tables.read(spark, log_path, schema))
