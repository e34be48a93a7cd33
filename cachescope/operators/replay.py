"""Order-dependent replay of a semantic cache over a whole request log.

Requests are processed in arrival order: a request is a HIT when some entry
already stored is within tau (matched to the nearest stored entry); otherwise
it is a MISS and its prompt is stored. The stored set is exactly the greedy
("leader") independent set of the tau-graph in arrival order, i.e. the
lexicographically-first maximal independent set of the DAG of edges
earlier -> later.

It is computed in synchronous rounds (parallel greedy MIS; Blelloch, Fineman
& Shun, SPAA 2012) without ever materialising the tau-graph. Each round runs
order-masked nearest-neighbour searches on the exact grid join of
:mod:`cachescope.operators.vectors`, each returning one row per request:

(a) a stored entry visible and within tau -> HIT;
(b) of the rest, no other undecided earlier request within tau -> decided
    MISS (stored); else it waits for the next round.

Every round decides at least the earliest open request, so the rounds end by
themselves. A round reads Parquet and writes Parquet (in the shared checkpoint
folder): its plan is the same size in every round, however long a chain of
requests is, and a lost executor costs at most the round.

Arrival order is (order, id), so requests that arrive together are decided in
the order of their ids; both may be of any orderable type, since the order is
turned into a rank by a range partitioning. Exact copies are collapsed first
(one representative per distinct vector, a combinable aggregation), and
requests that cannot be stored do not take part: both are decided by one final
order-masked lookup of every request against the stored set, the gateway's own
per-request cost. The log is processed in arrival-order slices of at most
``slice_rows`` requests; later slices meet earlier entries as a fixed cache, so
the search among undecided requests stays within a slice.

Where entries have keys of their own (``key_col``) and a key comes with several vectors, a
stored request ends the entry that its key had before: an entry is visible to the requests
after it up to and including the one that overwrites it. There the rounds guess and verify.
The first guess is that every request is stored; a round looks up every request among the
entries that live at its place by the guess (one search; a request meets only the entries of
its stretch of the log, see :class:`cachescope.operators.vectors.Stretches`), and those that
miss are the next guess. A guess that a round leaves as it is is the replay: the outcome of a
request follows from those before it, so by induction along the log there is only one such
guess. What a request depends on is right a round before it at the latest, so the rounds
follow the longest chain of outcomes that really turn on each other, and every round settles
at least the earliest request that was wrong. Copies are not collapsed then: a copy can come
after the entry that answered its twin was overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, new_folder, written_to
from .vectors import DEFAULT_BLOCK_ROWS, Stretches, knn1

#: Bits of a rank that number the rows of one range partition.
_ROW_BITS = 33
#: Bits of a rank inside a stretch of the log; a key's rows are ordered stretch by stretch.
_STRETCH_BITS = 16
#: After every rank.
_NEVER = 2**62


def _moment(df: DataFrame, name: str):
    """A column as a number that compares exactly: integers and times as bigint."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("bigint")
    return F.col(name).cast("double")


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``ord, id``) with ``rank``, a bigint in the order of (ord, id).

    Range partitions are in order and rows are numbered inside each, so the
    number of a row follows its place; it is fixed by writing the result.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.repartitionByRange(parts, "ord", "id").sortWithinPartitions("ord", "id")
                       .drop("ord").withColumn("rank", F.monotonically_increasing_id()), "replay-log")


def slice_bounds(sizes: dict[int, int], slice_rows: int) -> list[tuple[int, int]]:
    """Rank intervals [lo, hi) of at most ``slice_rows`` rows, from the rows of each
    range partition; whole partitions share a slice, a larger one is cut inside."""
    out: list[tuple[int, int]] = []
    lo, held = None, 0
    for part in sorted(sizes):
        start, n = part << _ROW_BITS, sizes[part]
        if lo is not None and held + n > slice_rows:
            out.append((lo, start))
            lo, held = None, 0
        if n > slice_rows:
            out += [(start + k, start + min(k + slice_rows, n)) for k in range(0, n, slice_rows)]
            continue
        lo, held = (start if lo is None else lo), held + n
        end = start + n
    if lo is not None:
        out.append((lo, end))
    return out


def with_next(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (with ``key, rank``) with the rank of the key's next row in ``name`` (``_NEVER`` for none).

    A key that holds a large share of the log is ordered in stretches of ranks, and the
    stretches are joined up through the first rank of each, so no task orders a key.
    """
    at = F.shiftright("rank", _STRETCH_BITS)
    inside = rows.withColumn("_s", at).withColumn(
        name, F.lead("rank").over(Window.partitionBy("key", "_s").orderBy("rank")))
    first = rows.groupBy("key", at.alias("_s")).agg(F.min("rank").alias("_f"))
    later = first.select(F.col("key").alias("_k"), F.col("_s").alias("_t"), F.coalesce(
        F.lead("_f").over(Window.partitionBy("key").orderBy("_s")), F.lit(_NEVER)).alias("_f"))
    return (inside.join(later, F.col("key").eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_t")))
            # a row without key ends nothing and is not ended
            .withColumn(name, F.when(F.col("key").isNull(), F.lit(_NEVER)).otherwise(F.coalesce(name, "_f")))
            .drop("_s", "_k", "_t", "_f"))


def cache_replay(log: DataFrame, threshold: float, *, dim: int, id_col: str = "request_id",
                 vec_col: str = "embedding", order_col: str | None = None,
                 available_col: str | None = None, storable_col: str | None = None,
                 key_col: str | None = None, initial: DataFrame | None = None,
                 block_rows: int | None = DEFAULT_BLOCK_ROWS,
                 slice_rows: int = 1_000_000) -> DataFrame:
    """Replay the cache over ``log``.

    ``order_col`` (default ``id_col``) is the arrival order, ties broken by the
    id; ``available_col`` (optional, comparable with the order) is when a stored
    entry becomes visible, so a request only sees entries with ``available <=``
    its own order value. ``storable_col`` (optional boolean) marks requests whose
    response can be cached. ``initial`` (``key, embedding``; keys of the type of
    the ids) is a cache that is warm from the start. With ``key_col`` an entry that is
    stored under a key ends the key's entry before it (entries of ``initial`` have the
    key of its column ``key_col``, if it has one); a null key ends nothing. Together with
    ``available_col`` a key must not come with two vectors. Vectors of another dimension
    than ``dim`` never match.

    Returns ``id, outcome ('HIT'|'MISS'), stored, match_id, distance, round``;
    match and distance are set on hits only, ``round`` on requests that took
    part in the rounds (0 on all others).
    """
    spark = log.sparkSession
    order_col = order_col or id_col
    rows = log.select(
        F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(order_col).alias("ord"),
        *([_moment(log, order_col).alias("at"), _moment(log, available_col).alias("avail")] if available_col else []),
        *([F.col(key_col).alias("key")] if key_col else []),
        (F.coalesce(F.col(storable_col), F.lit(False)) if storable_col else F.lit(True)).alias("storable"))
    base = _ranked(rows)
    if key_col:
        twice = (base.where("storable").groupBy("key").agg(F.min("vec").alias("a"), F.max("vec").alias("b"))
                 .where("a <> b").select("key").first())
        if twice and available_col:
            raise ValueError(f"key {twice['key']!r} comes with two vectors, which a store delay does not allow")
        if not twice and (initial is None or key_col not in initial.columns):
            base, key_col = base.drop("key"), None  # no entry can be overwritten by another one
    timed = ["at", "avail"] if available_col else []
    fields = ["id", "vec", "rank", *timed, *(["key"] if key_col else [])]

    # Of several storable requests with one vector only the first can be stored: a later
    # copy finds it, or the entry that made it a hit, at least as close. With a store
    # delay a copy can arrive before its twin is visible, so there all take part.
    reps = base.where("storable").select(*fields)
    if not available_col and not key_col:
        reps = materialise(reps.groupBy("vec").agg(F.min_by("id", "rank").alias("id"), F.min("rank").alias("rank"))
                           .select(*fields), "replay-reps")

    def search(queries: DataFrame, cands: DataFrame, n_q: int, n_c: int) -> DataFrame:
        """Nearest earlier visible candidate, one row per query."""
        return knn1(queries, cands, query_id="id", query_vec="vec", cache_key="id", cache_vec="vec",
                    order="rank", arrival="at" if timed else None, available="avail" if timed else None,
                    dim=dim, block_rows=block_rows, counts=(n_q, n_c))

    known, n_stored = None, 0  # entries of earlier slices and of the warm cache
    if initial is not None:
        want, have = base.schema["id"].dataType, initial.schema["key"].dataType
        if want != have:
            raise ValueError(f"keys of the initial cache are {have.simpleString()}, ids are {want.simpleString()}")
        least = {"at": _least(base, "at"), "avail": _least(base, "avail")} if timed else {}
        known = materialise(initial.select(F.col("key").alias("id"), F.col("embedding").alias("vec"),
                                           F.lit(-1).cast("bigint").alias("rank"),
                                           *[least[c].alias(c) for c in timed],
                                           *([(F.col(key_col) if key_col in initial.columns else F.lit(None))
                                              .cast(base.schema["key"].dataType).alias("key")] if key_col else [])),
                            "replay-cache")
        n_stored = known.count()

    sizes = {r["p"]: r["count"] for r in base.groupBy(F.shiftright("rank", _ROW_BITS).alias("p")).count().collect()}
    if key_col:
        return _replay_keys(base, sizes, known, threshold, dim=dim, fields=fields, timed=bool(timed),
                            block_rows=block_rows, slice_rows=slice_rows)

    step_schema = T.StructType([*reps.schema.fields, T.StructField("outcome", T.StringType()),
                                T.StructField("round", T.IntegerType())])
    steps: list[str] = []
    rnd = 0
    for lo, hi in slice_bounds(sizes, slice_rows):
        open_ = reps.where((F.col("rank") >= lo) & (F.col("rank") < hi))
        n_open, done = open_.count(), []
        while n_open:
            rnd += 1
            stored = _stored(spark, done, step_schema, fields, known)
            if n_stored:
                near = search(open_, stored, n_open, n_stored)
                hits = near.where(F.col("distance") <= F.lit(threshold)).select("id", F.lit(True).alias("_h"))
                tested = materialise(open_.join(hits, "id", "left"), "replay-open")
                rest = tested.where("_h is null").select(*fields)
            else:
                tested, rest = open_.withColumn("_h", F.lit(None).cast("boolean")), open_
            # an upper bound sizes the search: no count of its own
            blocked = (search(rest, rest, n_open, n_open)
                       .where(F.col("distance") <= F.lit(threshold)).select("id", F.lit(True).alias("_b")))
            path = new_folder(spark, "replay-step")
            step = written_to(tested.join(blocked, "id", "left").select(
                *fields, F.when(F.col("_h"), F.lit("HIT")).when(F.col("_b").isNull(), F.lit("MISS")).alias("outcome"),
                F.lit(rnd).alias("round")), path)
            done.append(path)
            tally = step.agg(F.count_if(F.col("outcome").isNull()).alias("open"),
                             F.count_if(F.col("outcome") == "MISS").alias("new")).first()
            n_stored += tally["new"]
            n_open = tally["open"]
            open_ = step.where("outcome is null").select(*fields)
        steps += done
        if done:  # one table of entries for the next slices
            known = materialise(_stored(spark, done, step_schema, fields, known), "replay-cache")

    decided = (spark.read.schema(step_schema).parquet(*steps) if steps
               else spark.createDataFrame([], step_schema)).where("outcome is not null")
    if n_stored:
        best = search(base.select(*fields), known, base.count(), n_stored).select(
            "id", F.col("match_key").alias("match_id"), "distance")
    else:
        id_type = base.schema["id"].dataType
        best = spark.createDataFrame([], T.StructType([
            T.StructField("id", id_type), T.StructField("match_id", id_type), T.StructField("distance", T.DoubleType())]))
    flags = decided.select("id", (F.col("outcome") == "MISS").alias("stored"), "round")
    is_hit = (F.coalesce(F.col("distance") <= F.lit(threshold), F.lit(False))
              & ~F.coalesce(F.col("stored"), F.lit(False)))
    return (base.select("id").join(best, "id", "left").join(flags, "id", "left")
            .select("id",
                    F.when(is_hit, F.lit("HIT")).otherwise(F.lit("MISS")).alias("outcome"),
                    F.coalesce(F.col("stored"), F.lit(False)).alias("stored"),
                    F.when(is_hit, F.col("match_id")).alias("match_id"),
                    F.when(is_hit, F.col("distance")).alias("distance"),
                    F.coalesce(F.col("round"), F.lit(0)).alias("round")))


def _replay_keys(base: DataFrame, sizes: dict[int, int], known: DataFrame | None, threshold: float, *, dim: int,
                 fields: list[str], timed: bool, block_rows: int | None, slice_rows: int) -> DataFrame:
    """The replay where stored requests end the entries of their keys: guesses until one holds."""
    spark = base.sparkSession
    starts, n = [0] * (max(sizes, default=0) + 1), 0
    for part in sorted(sizes):
        starts[part], n = n, n + sizes[part]
    # places of the log without gaps, so that a stretch of places is one of requests
    place = (F.element_at(F.array(*[F.lit(x).cast("bigint") for x in starts]), (F.shiftright("rank", _ROW_BITS) + 1).cast("int"))
             + F.col("rank").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    base = base.withColumn("rank", place).select(*fields, F.col("storable").alias("stored"), "storable")
    schema = T.StructType([*base.schema.fields, T.StructField("match_id", base.schema["id"].dataType),
                           T.StructField("distance", T.DoubleType()), T.StructField("round", T.IntegerType())])
    out: list[str] = []
    for lo in range(0, n, slice_rows):
        hi, rnd, changed = min(lo + slice_rows, n), 0, True
        step = base.where((F.col("rank") >= lo) & (F.col("rank") < hi)).withColumn("round", F.lit(0))
        while changed:
            rnd += 1
            stored = step.where("stored").select(*fields)
            entries = materialise(with_next(stored if known is None else known.unionByName(stored), "until"), "replay-entries")
            best = knn1(step, entries, query_id="rank", query_vec="vec", cache_key="id", cache_vec="vec", order="rank",
                        arrival="at" if timed else None, available="avail" if timed else None, until="until", dim=dim,
                        stretches=Stretches(entries, lo, hi, "rank", "until", dim, block_rows))
            hit = F.coalesce(F.col("_d") <= F.lit(threshold), F.lit(False))
            new = F.col("storable") & ~hit
            path = new_folder(spark, "replay-guess")
            found = best.select(F.col("rank").alias("_r"), F.col("match_key").alias("_m"), F.col("distance").alias("_d"))
            step = written_to(step.join(found, F.col("rank") == F.col("_r"), "left").select(
                *fields, new.alias("stored"), "storable", F.when(hit, F.col("_m")).alias("match_id"),
                F.when(hit, F.col("_d")).alias("distance"),
                F.when(~F.col("storable"), F.lit(0)).when((F.col("round") == 0) | (new != F.col("stored")), F.lit(rnd))
                .otherwise(F.col("round")).alias("round")), path)
            # a request that this round changed carries its number
            changed = not step.where((F.col("round") == rnd) & (~F.col("stored") if rnd == 1 else F.lit(True))).isEmpty()
        out.append(path)
        known = materialise(entries.where(F.col("until") == _NEVER).select(*fields), "replay-cache")
    rows = spark.read.schema(schema).parquet(*out) if out else spark.createDataFrame([], schema)
    return rows.select("id", F.when(F.col("distance").isNotNull(), F.lit("HIT")).otherwise(F.lit("MISS")).alias("outcome"),
                       "stored", "match_id", "distance", "round")


def _least(df: DataFrame, name: str):
    """A value no greater than any of a numeric column: visible from the start."""
    kind = df.schema[name].dataType
    return F.lit(float("-inf")) if isinstance(kind, T.DoubleType) else F.lit(-2**62).cast(kind)


def _stored(spark, steps: list[str], schema: T.StructType, fields: list[str], known: DataFrame | None) -> DataFrame:
    """Entries stored so far: those known at the start of the slice and the misses of its
    rounds, which are one scan however many rounds there were."""
    new = spark.read.schema(schema).parquet(*steps).where("outcome = 'MISS'").select(*fields) if steps else None
    if new is None:
        return known if known is not None else spark.createDataFrame(
            [], T.StructType([f for f in schema.fields if f.name in fields]))
    return new if known is None else known.select(*fields).unionByName(new)
