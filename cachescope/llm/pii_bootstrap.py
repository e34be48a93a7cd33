"""Operator 5: personal data by bootstrapped contextual extraction.

1. Seeds. E-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers are
   found by fixed patterns over every whole text; they are the base spans.
2. Graph. Identifier-like tokens (those with a digit or an @) and the base spans are
   instances; the two words to the left and the two to the right of an occurrence induce
   a lexical pattern each. An edge says how often an instance occurred in a pattern. For
   every pattern with enough different seeds a second scan counts all occurrences of its
   words, whatever stands beside them.
3. Scores, iterated in Spark. A pattern's confidence is the share of its occurrences that
   hold an instance, each weighted by the belief in it. Seeds are believed fully, any other
   instance ``TRUST`` per cent as much as its most confident pattern. Both are whole per
   cents, rounded down, and only rise, so the rounds end where nothing changes any more.
4. Bootstrapping. Instances in a pattern of at least ``MIN_CONFIDENCE`` join the seeds; patterns
   that now have enough of them are induced, totalled over the texts and scored with the
   others, until no pattern joins. Trust falls from one generation to the next, which
   ends chains of discoveries that lead away from the seeds.
5. Extraction. A token that is no base span, in a pattern whose confidence ends at
   ``MIN_CONFIDENCE`` or more, becomes a span of kind ``context``. Base spans always stay.

The edges are aggregated by (pattern, instance) before any join, so a pattern or an
instance that a third of all texts share is combined map-side.

Defined cases: null text is empty; texts without identifiers have no spans; spans are in
code points with the end exclusive; a null or repeated document id changes nothing, each
row has its own spans; an empty table gives an empty result; input columns named like an
output column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_apart, filter_of, passes, written

#: Base kinds in the order in which spans with one start are listed; ``context`` follows.
KINDS = ("email", "ip", "card", "phone")
#: Different seeds that a pattern needs.
MIN_SEEDS = 5
#: Confidence, in per cent, from which a pattern extracts, and the part of it, in per cent, that its instances get.
MIN_CONFIDENCE, TRUST = 80, 90
#: Least characters of an identifier-like token.
MIN_TOKEN = 6
#: Words whose hash a task remembers.
CACHE_WORDS = 500_000

# fixed values: the base patterns
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HINT = re.compile(r"[0-9@]")
_REST = re.compile(r"\S*")
_TRIM = "\"'`.,;:!?()[]{}<>|*#$%&="


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order of start, then kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(out)


class WordHashes(dict):
    """Hash of a word as patterns see it: lower-case, without outer marks, digits alike."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        plain = re.sub(r"\d", "9", word.strip(_TRIM).lower() or word)
        h = int.from_bytes(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = h
        return h


def pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of all neighbouring pairs of word hashes."""
    x = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xBF58476D1CE4E5B9)).view("i8")


def _pair(words: list[str], hashes: dict) -> int | None:
    if len(words) < 2:
        return None
    return int(pairs(np.array([hashes[w] for w in words], dtype="u8"))[0])


def instances(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind number or -1): base spans, and identifier-like tokens outside them."""
    found, p, at = [(s, e, k) for s, k, e in spans], 0, 0
    covered: list[list[int]] = []  # the base spans as stretches that do not meet
    for s, _, e in spans:
        if covered and s < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    for m in _HINT.finditer(text):
        if m.start() < at:
            continue
        s, at = m.start(), _REST.match(text, m.start()).end()
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        e = at
        while s < e and text[s] in _TRIM:
            s += 1
        while e > s and text[e - 1] in _TRIM:
            e -= 1
        while p < len(covered) and covered[p][1] <= s:
            p += 1
        if e - s >= MIN_TOKEN and (p == len(covered) or covered[p][0] >= e):
            found.append((s, e, -1))
    return found


def _words_before(text: str, s: int) -> list[str]:
    """The last two words before ``s``, whatever their length."""
    reach = 32
    while True:
        words = text[max(0, s - reach):s].split()
        if len(words) > 2 or reach >= s:  # of three words the first may be cut
            return words[-2:]
        reach *= 2


def _words_after(text: str, e: int) -> list[str]:
    reach = 32
    while True:
        words = text[e:e + reach].split()
        if len(words) > 2 or e + reach >= len(text):
            return words[:2]
        reach *= 2


def around(text: str, s: int, e: int, hashes: dict) -> tuple[int | None, int | None]:
    """Hashes of the two words before the token at ``s`` and the two after the one before ``e``."""
    while s > 0 and not text[s - 1].isspace():
        s -= 1
    return _pair(_words_before(text, s), hashes), _pair(_words_after(text, _REST.match(text, e).end()), hashes)


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        base, seen = [], []
        for t in batch:
            spans = base_spans(t)
            base.append([{"s": s, "k": k, "e": e} for s, k, e in spans])
            seen.append([{"s": s, "e": e, "kind": k, "left": x[0], "right": x[1],
                          "inst": hashlib.blake2b(t[s:e].lower().encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()}
                         for s, e, k in instances(t, spans) for x in [around(t, s, e, hashes)]])
        yield pd.DataFrame({"base": base, "seen": seen})


_SPAN = "struct<s: int, k: int, e: int>"
_SCAN_TYPE = (f"struct<base: array<{_SPAN}>, seen: array<struct<s: int, e: int, kind: int, left: bigint, "
              "right: bigint, inst: string>>>")


def count_pairs(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pair, total): occurrences of the word pairs in ``wanted`` over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(filter_of(wanted, "pair"))  # of a fixed size

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            hit = []
            for t in batch["t"]:
                words = t.split()
                if len(words) > 1:
                    x = pairs(np.fromiter(map(hashes.__getitem__, words), dtype="u8", count=len(words)))
                    hit.append(x[passes(shared.value, x)])
            if hit:
                pair, n = np.unique(np.concatenate(hit), return_counts=True)
                yield pd.DataFrame({"pair": pair, "n": n})

    return (texts.mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("total"))
            .join(wanted.select("pair").distinct(), "pair", "left_semi"))


def _settled(live: DataFrame, seeds: DataFrame, belief: DataFrame, trust: int) -> tuple[DataFrame, DataFrame]:
    """(side, pair, confidence, n_seeds) and (inst, belief) where another round changes nothing."""
    last = None
    while True:
        score = written(live.join(belief, "inst").groupBy("side", "pair").agg(
            F.expr("sum(n * belief) div max(total)").alias("confidence"), F.max("n_seeds").alias("n_seeds")), "patterns")
        now = score.agg(F.sum("confidence")).first()[0]
        if now == last:  # no confidence falls, so an equal sum says that none has risen
            return score, belief
        last = now
        raised = live.where("not seed").join(score.select("side", "pair", "confidence"), ["side", "pair"])
        belief = written(seeds.unionByName(raised.select("inst", F.expr(f"confidence * {trust} div 100").alias("belief")))
                         .groupBy("inst").agg(F.max("belief").alias("belief")), "beliefs")


def confident_patterns(seen: DataFrame, texts: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: int = MIN_CONFIDENCE,
                       trust: int = TRUST) -> DataFrame | None:
    """(side, pair, confidence, n_seeds) of the patterns that extract, from rows of
    (inst, kind, side, pair); none if no pattern has enough seeds."""
    if not 0 <= trust <= 100:
        raise ValueError("trust is a per cent")
    edges = (seen.groupBy("side", "pair", "inst").agg(F.count(F.lit(1)).alias("n"), (F.max("kind") >= 0).alias("seed")))
    edges = written(edges, "edges")
    seeds = written(edges.where("seed").select("inst").distinct().withColumn("belief", F.lit(100).cast("bigint")), "seeds")
    believed, belief, known, live, score = seeds.select("inst"), seeds, None, None, None
    while True:
        rich = (edges.join(believed, "inst").groupBy("side", "pair").agg(F.count(F.lit(1)).alias("n_seeds"))
                .where(F.col("n_seeds") >= min_seeds))
        new = written(rich if known is None else rich.join(known, ["side", "pair"], "left_anti"), "candidates")
        if new.isEmpty():
            break
        known = new.select("side", "pair") if known is None else written(known.unionByName(new.select("side", "pair")), "known")
        counted = written(new.join(count_pairs(texts, new), "pair"), "totals")
        held = edges.join(counted, ["side", "pair"])
        # two base spans of one token stand beside one pair
        most = written(held.groupBy("side", "pair").agg(F.greatest(F.max("total"), F.sum("n")).alias("total")), "totals")
        held = held.drop("total").join(most, ["side", "pair"])
        live = written(held if live is None else held.unionByName(live), "live")
        score, belief = _settled(live, seeds, belief, trust)
        good = score.where(F.col("confidence") >= min_confidence).select("side", "pair")
        fresh = written(live.where("not seed").join(good, ["side", "pair"]).select("inst").distinct()
                        .join(believed, "inst", "left_anti"), "believed")
        if fresh.isEmpty():
            break
        believed = written(believed.unionByName(fresh), "believed")
    return None if score is None else score.where(F.col("confidence") >= min_confidence)


@columns_apart("text")
def find(docs: DataFrame, text: str = "text", **params) -> DataFrame:
    """``docs`` without the text, with ``n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_context``. ``spans`` lists the base spans and, as kind ``context``, the discovered ones;
    ``params`` go to ``confident_patterns``."""
    out = (*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_context")
    cols = [c for c in docs.columns if c not in out and c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    found = written(docs.select(*cols, F.pandas_udf(_scan, _SCAN_TYPE)(body).alias("_f")).select(
        *cols, F.col("_f.base").alias("_base"), F.col("_f.seen").alias("_seen"),
        F.monotonically_increasing_id().alias("_row")), "spans")
    each = found.select("_row", F.explode("_seen").alias("o")).select("_row", "o.*")
    side = F.explode(F.array(F.struct(F.lit("L").alias("side"), F.col("left").alias("pair")),
                             F.struct(F.lit("R").alias("side"), F.col("right").alias("pair"))))
    seen = each.select("_row", "s", "e", "kind", "inst", side.alias("p")).select(
        "_row", "s", "e", "kind", "inst", "p.side", "p.pair").where("pair is not null")
    good = confident_patterns(seen, docs.select(body.alias("t")), **params)
    if good is None:
        found = found.withColumn("_more", F.array().cast(f"array<{_SPAN}>"))
    else:
        more = (seen.where("kind < 0").join(good, ["side", "pair"]).groupBy("_row")
                .agg(F.collect_set(F.struct("s", F.lit(len(KINDS)).alias("k"), "e")).alias("_more")))
        found = found.join(more, "_row", "left").withColumn(
            "_more", F.coalesce("_more", F.array().cast(f"array<{_SPAN}>")))
    names = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat(
        F.element_at(names, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")
    # a second parameter of the inner function would be the place in the array
    n_of = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k))
    return found.select(
        *cols,
        *[n_of(k).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(F.encode(listed(F.col("_base")), "utf-8"), 256).alias("base_sha256"),
        listed(F.concat("_base", "_more")).alias("spans"), F.size("_more").cast("bigint").alias("n_context"))
