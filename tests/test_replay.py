"""Cache replay equals the sequential gateway loop (property test on random logs)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cachescope.operators.replay import cache_replay, slice_bounds
from cachescope.plans.gateway import gateway_flow, replay_metrics


def sequential(vecs, tau, avail=None, order=None, storable=None):
    """The gateway, one request at a time: nearest stored entry, hit if <= tau."""
    n = len(vecs)
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    order = np.arange(n) if order is None else order
    avail = order if avail is None else avail
    storable = np.ones(n, bool) if storable is None else storable
    stored, out = [], {}
    for i in np.argsort(order, kind="stable"):
        cand = [j for j in stored if avail[j] <= order[i] and order[j] < order[i]]
        if cand:
            d = 1 - unit[cand] @ unit[i]
            k = int(np.argmin(d))
            if d[k] <= tau:
                out[i] = ("HIT", cand[k])
                continue
        out[i] = ("MISS", None)
        if storable[i]:
            stored.append(i)
    return out


def _clustered(rng, n, d, centers, noise):
    base = rng.normal(size=(centers, d))
    return base[rng.integers(0, centers, n)] + noise * rng.normal(size=(n, d))


@pytest.mark.parametrize("seed,tau", [(1, 0.2), (2, 0.35), (3, 0.5)])
def test_replay_equals_sequential(spark, seed, tau):
    rng = np.random.default_rng(seed)
    vecs = _clustered(rng, 150, 6, 10, 0.4)
    perm = rng.permutation(150)        # arrival order unrelated to ids
    df = spark.createDataFrame([(int(i), int(perm[i]), vecs[i].tolist()) for i in range(150)],
                               "request_id long, arrival long, embedding array<double>")
    got = {r.id: (r.outcome, r.match_id)
           for r in cache_replay(df, tau, dim=6, order_col="arrival", block_rows=64).collect()}
    want = sequential(vecs, tau, order=perm)
    assert got == {int(k): v for k, v in want.items()}


def test_replay_store_delay(spark):
    rng = np.random.default_rng(11)
    n = 120
    vecs = _clustered(rng, n, 5, 6, 0.3)
    order = np.arange(n) * 10
    avail = order + rng.integers(0, 40, n)          # response time before the entry is visible
    df = spark.createDataFrame([(i, int(order[i]), int(avail[i]), vecs[i].tolist()) for i in range(n)],
                               "request_id long, t long, visible long, embedding array<double>")
    got = {r.id: (r.outcome, r.match_id)
           for r in cache_replay(df, 0.3, dim=5, order_col="t", available_col="visible").collect()}
    assert got == {int(k): v for k, v in sequential(vecs, 0.3, avail=avail, order=order).items()}


def test_replay_not_storable(spark):
    rng = np.random.default_rng(5)
    n = 100
    vecs = _clustered(rng, n, 5, 5, 0.3)
    storable = rng.random(n) > 0.3
    df = spark.createDataFrame([(i, bool(storable[i]), vecs[i].tolist()) for i in range(n)],
                               "request_id long, ok boolean, embedding array<double>")
    got = {r.id: (r.outcome, r.match_id) for r in cache_replay(df, 0.3, dim=5, storable_col="ok").collect()}
    assert got == {int(k): v for k, v in sequential(vecs, 0.3, storable=storable).items()}


def test_replay_edge_cases(spark):
    same = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, same), (2, same), (3, [3.0, -2.0, 0.0])],
                               "request_id long, embedding array<double>")
    got = {r.id: (r.outcome, r.match_id, r.distance) for r in cache_replay(df, 0.15, dim=3).collect()}
    assert got[1] == ("MISS", None, None)
    assert got[2][:2] == ("HIT", 1) and abs(got[2][2]) < 1e-12   # same prompt again: hit at 0
    assert got[3][0] == "MISS"
    m = replay_metrics(cache_replay(df, 0.15, dim=3)).first()
    assert (m.total_requests, m.cache_hits, m.entries_stored, m.tokens_saved) == (3, 1, 2, 1500)


def test_gateway_flow_small(spark):
    rows = [(1, "How do tides work?", "The moon pulls the sea.", [1.0, 0.0, 0.0]),
            (2, "how do tides work? ", "dup", [0.99, 0.05, 0.0]),
            (3, "My email is mira.solano@post.example — sum up the tax form.", "It asks ...", [0.0, 1.0, 0.0]),
            (4, "", "empty prompt", [0.0, 0.0, 1.0]),
            (5, "blank reply", "   ", [0.0, 0.0, 1.0]),
            (6, "after blank", "r", [0.0, 0.01, 1.0])]
    df = spark.createDataFrame(rows, "seq long, prompt string, response string, embedding array<float>")
    res = gateway_flow(df, 0.15, dim=3, id_col="seq", order_col="seq")
    out = {r.request_id: r for r in res.outcomes.collect()}
    assert out[1].cache == "MISS" and out[1].stored
    assert out[2].cache == "HIT" and out[2].match_id == 1 and not out[2].pii_detected
    assert out[3].cache == "MISS" and out[3].pii_detected and out[3].pii_entities == "EMAIL_ADDRESS"
    assert out[3].forwarded_prompt == "My email is <EMAIL_ADDRESS> — sum up the tax form."
    assert out[4].cache == "MISS" and not out[4].stored
    assert out[5].cache == "MISS" and not out[5].stored          # blank response is not cached
    assert out[6].cache == "MISS" and out[6].stored              # so 6 cannot hit 5
    cache_rows = {r.original_text for r in res.cache.collect()}
    assert cache_rows == {"How do tides work?", "My email is mira.solano@post.example — sum up the tax form.",
                          "after blank"}
    types = sorted(r.type for r in res.events.collect())
    assert types == ["cache_hit", "pii_blocked"]
    hit_ev = res.events.where(F.col("type") == "cache_hit").first()
    assert hit_ev.detail.startswith('Matched: "How do tides work?"')


def test_replay_hot_clique_resolves_fast(spark):
    """A third of the log is the same prompt: no pair list, two rounds for the clique."""
    rng = np.random.default_rng(4)
    n = 300
    vecs = rng.normal(size=(n, 8))
    hot = rng.permutation(n)[: n // 3]
    vecs[hot] = vecs[hot[0]]
    df = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(n)],
                               "request_id long, embedding array<double>")
    res = cache_replay(df, 0.05, dim=8).collect()
    got = {r.id: (r.outcome, r.match_id) for r in res}
    assert got == {int(k): v for k, v in sequential(vecs, 0.05).items()}
    first = int(min(hot))
    assert all(got[int(h)] == ("HIT", first) for h in hot if h != first)
    assert max(r["round"] for r in res) <= 3


def _links(n):
    """Vectors of which each is within tau of its neighbours only, and that tau."""
    vecs = np.zeros((n, n + 1))
    for k in range(n):  # neighbours share one axis: cosine 1/2
        vecs[k, k:k + 2] = 1.0
    return vecs, 0.5 + 1e-9


def test_long_chain_in_one_slice(spark):
    """A chain settles a few requests per round; the plan of a round does not grow with it."""
    vecs, tau = _links(60)
    df = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(60)],
                               "request_id long, embedding array<double>")
    res = cache_replay(df, tau, dim=vecs.shape[1]).collect()
    assert {r.id: r.outcome for r in res} == {int(k): v[0] for k, v in sequential(vecs, tau).items()}
    assert max(r["round"] for r in res) >= 20


def test_slices_equal_one_pass(spark):
    rng = np.random.default_rng(13)
    vecs = _clustered(rng, 140, 6, 9, 0.4)
    df = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(140)],
                               "request_id long, embedding array<double>")
    got = {r.id: (r.outcome, r.match_id) for r in cache_replay(df, 0.3, dim=6, slice_rows=25).collect()}
    assert got == {int(k): v for k, v in sequential(vecs, 0.3).items()}


def test_slice_bounds():
    sizes = {0: 3, 2: 4, 5: 25, 6: 1}
    bounds = slice_bounds(sizes, 10)
    ranks = [(p << 33) + k for p in sizes for k in range(sizes[p])]
    held = [[r for r in ranks if lo <= r < hi] for lo, hi in bounds]
    assert sum(held, []) == ranks and max(map(len, held)) <= 10


def test_equal_arrival_is_decided_by_id(spark):
    rng = np.random.default_rng(7)
    vecs = _clustered(rng, 80, 5, 6, 0.3)
    when = np.arange(80) // 8
    df = spark.createDataFrame([(i, int(when[i]), vecs[i].tolist()) for i in range(80)],
                               "request_id long, t long, embedding array<double>")
    got = {r.id: (r.outcome, r.match_id) for r in cache_replay(df, 0.3, dim=5, order_col="t").collect()}
    assert got == {int(k): v for k, v in sequential(vecs, 0.3, order=np.arange(80)).items()}


def test_large_and_other_orders(spark):
    """Orders beyond 2^53, times and structs; string ids."""
    vecs = [[1.0, 0.0], [1.0, 0.001], [0.0, 1.0]]
    big = 2**53
    df = spark.createDataFrame([(f"r{i}", big + i, v) for i, v in enumerate(vecs)], "request_id string, o long, embedding array<double>")
    df = df.withColumn("ts", F.timestamp_micros(F.col("o") - big).cast("timestamp_ntz")).withColumn("st", F.struct(F.lit(1), "o"))
    for order in ("o", "ts", "st"):
        got = {r.id: (r.outcome, r.match_id) for r in cache_replay(df, 0.1, dim=2, order_col=order).collect()}
        assert got == {"r0": ("MISS", None), "r1": ("HIT", "r0"), "r2": ("MISS", None)}


def test_warm_cache(spark):
    rng = np.random.default_rng(31)
    vecs = _clustered(rng, 120, 6, 9, 0.4)
    df = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(120)], "request_id long, embedding array<double>")
    whole = {r.id: (r.outcome, r.match_id) for r in cache_replay(df, 0.3, dim=6).collect()}
    first = cache_replay(df.where("request_id < 60"), 0.3, dim=6)
    warm = df.join(first.where("stored").select(F.col("id").alias("request_id")), "request_id").select(
        F.col("request_id").alias("key"), "embedding")
    rest = {r.id: (r.outcome, r.match_id) for r in cache_replay(
        df.where("request_id >= 60"), 0.3, dim=6, initial=warm).collect()}
    assert rest == {k: v for k, v in whole.items() if k >= 60}
    with pytest.raises(ValueError):
        cache_replay(df, 0.3, dim=6, initial=warm.withColumn("key", F.col("key").cast("string")))


def overwriting(vecs, keys, tau, storable, warm=()):
    """The gateway with a keyed cache, one request at a time: a store under a key ends its entry."""
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    cache = [(name, key, unit(v)) for name, key, v in warm]
    out = {}
    for i, v in enumerate(vecs):
        near = sorted((round(float(1 - e @ unit(v)), 12), name) for name, _, e in cache)
        if near and near[0][0] <= tau:
            out[i] = ("HIT", near[0][1])
            continue
        out[i] = ("MISS", None)
        if storable[i]:
            cache = [e for e in cache if keys[i] is None or e[1] != keys[i]] + [(i, keys[i], unit(v))]
    return out


@pytest.mark.parametrize("seed,n_keys,slice_rows", [(1, 4, 1_000_000), (2, 12, 35), (3, 1, 50), (4, 60, 1_000_000)])
def test_overwritten_keys_equal_the_sequential_loop(spark, seed, n_keys, slice_rows):
    rng = np.random.default_rng(seed)
    n = 130
    vecs = _clustered(rng, n, 4, 8, 0.5)
    keys = [None if k == n_keys else f"k{k}" for k in rng.integers(0, n_keys + 1, n)]
    ok = rng.random(n) > 0.15
    df = spark.createDataFrame([(i, keys[i], bool(ok[i]), vecs[i].tolist()) for i in range(n)],
                               "request_id long, key string, ok boolean, embedding array<double>").repartition(5)
    got = {r.id: (r.outcome, r.match_id) for r in cache_replay(
        df, 0.25, dim=4, key_col="key", storable_col="ok", slice_rows=slice_rows, block_rows=64).collect()}
    assert got == overwriting(vecs, keys, 0.25, ok)


def test_overwritten_entries_of_a_warm_cache(spark):
    rng = np.random.default_rng(9)
    vecs = _clustered(rng, 60, 4, 5, 0.5)
    keys = [f"k{k}" for k in rng.integers(0, 6, 60)]
    warm = [(-1 - i, f"k{i}", v.tolist()) for i, v in enumerate(_clustered(np.random.default_rng(9), 6, 4, 5, 0.4))]
    df = spark.createDataFrame([(i, keys[i], vecs[i].tolist()) for i in range(60)], "request_id long, pk string, embedding array<double>")
    initial = spark.createDataFrame([(k, p, v) for k, p, v in warm], "key long, pk string, embedding array<double>")
    got = {r.id: (r.outcome, r.match_id) for r in cache_replay(df, 0.25, dim=4, key_col="pk", initial=initial).collect()}
    assert got == overwriting(vecs, keys, 0.25, np.ones(60, bool), warm)


def test_case_variants_of_a_prompt_overwrite_each_other(spark):
    """One key, two vectors: the second ends the first, whose prompt is then a miss again."""
    x, y = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(1, "k", x), (2, "k", x), (3, "k", y), (4, "k", x), (5, "k", y)],
                               "request_id long, key string, embedding array<double>")
    got = {r.id: (r.outcome, r.match_id) for r in cache_replay(df, 0.1, dim=2, key_col="key").collect()}
    assert got == {1: ("MISS", None), 2: ("HIT", 1), 3: ("MISS", None), 4: ("MISS", None), 5: ("MISS", None)}
    with pytest.raises(ValueError, match="store delay"):
        cache_replay(df.withColumn("a", F.col("request_id")), 0.1, dim=2, key_col="key", available_col="a")


@pytest.mark.parametrize("block_rows", [None, 7])
def test_rounds_follow_what_outcomes_turn_on(spark, block_rows):
    """Each request has many earlier neighbours, all overwritten: nothing waits for them."""
    rows = [(i, "k", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)] + [(40, "k", [0.0, 1.0]), (41, "k", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "request_id long, key string, embedding array<double>")
    got = sorted(cache_replay(df, 0.1, dim=2, key_col="key", block_rows=block_rows).collect())
    assert [(r.outcome, r.stored, r.match_id) for r in got] == [("MISS", True, None)] * 42
    assert {r["round"] for r in got} == {1}


def test_repeated_ids_of_an_overwritten_key_are_requests_of_their_own(spark):
    rows = [(1, "k", [1.0, 0.0]), (1, "k", [1.0, 0.0]), (2, "k", [0.0, 1.0]), (2, "k", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "request_id long, key string, embedding array<double>")
    got = [(r.id, r.outcome, r.stored, r.match_id) for r in cache_replay(df, 0.1, dim=2, key_col="key").collect()]
    assert sorted(got, key=repr) == [(i, *o) for i in (1, 2) for o in (("HIT", False, i), ("MISS", True, None))]


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_next_rank_of_a_key_across_stretches(spark, monkeypatch, bits):
    from cachescope.operators import replay

    monkeypatch.setattr(replay, "_STRETCH_BITS", bits)
    rows = [("a", r) for r in (0, 1, 3, 4, 17, 40)] + [("b", 2), (None, 5), (None, 6)]
    df = spark.createDataFrame(rows, "key string, rank long")
    got = {(r.key, r.rank): r.nxt for r in replay.with_next(df, "nxt").collect()}
    end = replay._NEVER
    assert got == {("a", 0): 1, ("a", 1): 3, ("a", 3): 4, ("a", 4): 17, ("a", 17): 40, ("a", 40): end, ("b", 2): end,
                   (None, 5): end, (None, 6): end}


def test_empty_log_and_vectors_of_another_dimension(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "request_id long, embedding array<double>")
    got = {r.id: (r.outcome, r.match_id) for r in cache_replay(df, 0.1, dim=2).collect()}
    assert got[3] == ("HIT", 2) and got[1] == ("MISS", None)
    assert cache_replay(df.limit(0), 0.1, dim=2).collect() == []
