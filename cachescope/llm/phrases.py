"""Operator 11: phrase collocation mining after Toivonen.

Phrases are 2 to 4 words in a row inside a piece of text; everything is per language.

1. Sample. A hash-random share of the documents is mined level by level at a lowered
   threshold: a phrase is counted there only if its first and its last words (all but one)
   are frequent in the sample. What is frequent is the proposal.
2. Full pass. One scan over all documents counts the proposal and its negative border
   exactly: every phrase that occurs and whose parts without the last and without the first
   word are both proposed, whether it is proposed itself or not; and all words.
3. Expansion. A phrase of the border that reaches the threshold is a failure: its extensions
   were not counted. Failures join the proposal, and a further scan counts the part of the
   new border that no scan has counted. When a scan brings no failure the result is closed:
   every frequent phrase has been counted, whatever the sample was. At most three
   expansions follow, since each settles one more phrase length. Where failures are few
   beside the frequent phrases, as with a fair sample, one expansion closes the result:
   what it counts anew it also extends, up to the longest phrases, frequent or not.
4. Scores. A frequent phrase is cut after its first k words; the counts of both parts are
   joined to it, and the lowest-scoring cut counts. A phrase that lies inside a longer
   frequent one with at least ``ABSORB`` per cent of its count is dropped. The best of each
   language are picked in two steps, so no task orders a language.

The proposal reaches the tasks as a filter of fixed size (8 MB): a phrase that passes it by
chance is counted like any other, so the filter costs time at most. Counts are combined by
94-bit hashes (no collision is expected at 10^12 phrases) in the tasks, whose runs of text
leave one sorted block of hashes and counts for each range of hashes, then in one task a
few ranges; ranges are so many that each holds what a few MB of text bring. What is shuffled
of the border is narrow. A block also names its run of text, and a sum keeps one of the runs
it was counted in: a last scan cuts the same runs and spells a frequent phrase out in that
run only, so a phrase is spelt once, however many tasks there are. If the texts should come in
another order then, what was not found in its run is spelt by a further scan in any run.

Defined cases: null text is empty, null language is ``und``; A-Z are lower-cased, other
letters stay; texts without words count nothing; a very long text is worked off in parts
cut between pieces; repeated rows count as often as they stand there; ties are ordered by
the phrase; an empty table gives an empty result; further columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filter_of, passes, written

#: Words of the longest phrase, and the least count of a candidate.
MAX_WORDS, MIN_COUNT = 4, 30
#: Share of the documents that propose, and the part of the expected count asked for there.
SAMPLE, LOWERED = 0.125, 0.6
#: Failures for each frequent phrase up to which one expansion goes on to the longest phrases.
FEW = 0.25
#: Share of a phrase's count, in per cent, from which a longer one stands for it.
ABSORB = 80
#: Phrases returned for each language.
TOP = 2000
#: Scores are this times a / (l + r).
SCORE_UNIT = 2_000_000
#: Bytes of text that are counted together.
RUN_BYTES = 4 << 20
#: Bytes of text for which there is a range of hashes, and the most ranges.
RANGE_BYTES, MAX_RANGES = 4 << 20, 1 << 14
#: Counts that wait in a task to be summed.
WAITING_ROWS = 1 << 20
#: Rows that leave a task at a time.
OUT_ROWS = 1 << 16
#: Phrases that a task remembers to have spelt out in any run (it spells some again beyond that).
SPELT_ROWS = 4_000_000
#: Groups in which the best of a language are picked first.
PICK_GROUPS = 64

# fixed values: what ends a piece, and what lies between words
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b"\t"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = bytes.maketrans(_CAPITALS + _ENDS + _BLANKS, _CAPITALS.lower() + b"\n" * len(_ENDS) + b" " * len(_BLANKS))
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)

_COUNTS = "a long, b int, n long"
_BLOCKS = "part int, a binary, b binary, n binary"
_RUN = "run int"
_NAMES = "a long, b int, lang string, k int, phrase binary, n long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(32))


class Words:
    """A folded text as word numbers (0 where a piece ends), with the words and their hashes."""

    def __init__(self, text: bytes):
        import xxhash

        parts = pc.split_pattern(pa.array([text.replace(b"\n", b" \n ")], pa.binary()), pattern=" ").flatten()
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_pylist()
        number = np.arange(1, len(words) + 1, dtype="i8")
        for word, n in ((b"\n", 0), (b"", -1)):
            if word in words:
                number[words.index(word)] = n
        ids = number[coded.indices.to_numpy()]
        self.ids = ids[ids >= 0]
        self.words = pa.concat_arrays([pa.array([b"\n"], pa.binary()), coded.dictionary])
        digests = b"\0" * 16 + b"".join([xxhash.xxh3_128_digest(w) for w in words])
        self.hashes = np.frombuffer(digests, dtype=">u8").astype("u8").reshape(-1, 2).T.copy()


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each different pair of hashes, its count)."""
    coded = pa.array(a).dictionary_encode()
    number, n = coded.indices.to_numpy(), len(coded.dictionary)
    place = np.empty(n, dtype="i8")
    place[number] = np.arange(len(a))
    if (b == b[place][number]).all():
        return place, np.bincount(number, minlength=n)
    _, place, count = np.unique(np.stack([a, b]), axis=1, return_index=True, return_counts=True)
    return place, count


def occurring(text: Words, seed: int, levels: range, new: np.ndarray | None, old: np.ndarray | None,
              spell: bool = False, rest: bool = False, due: np.ndarray | None = None,
              run: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, positions, hashes a, hashes b, counts) of the different phrases of k words to be
    counted; the two low bits of b are k - 1.

    Words are always counted (where ``levels`` has 1). Longer phrases are if both parts, all
    of whose own parts pass the filter ``new``, pass it; those that ``old`` had let through
    in the same way are left out. With ``rest`` those that ``old`` had not let through pass
    as parts of longer ones, whatever ``new`` holds. With ``spell`` it is the phrases that pass ``new`` themselves,
    and with a filter ``due`` only those that are due in this ``run``.
    """
    ids = text.ids
    inner = ids > 0
    ga, gb = (_mixed(h[ids] ^ np.uint64(seed)) for h in text.hashes)
    ok = inner if new is None else inner & passes(new, ga.view("i8"))
    was = inner & passes(old, ga.view("i8")) if old is not None else None

    def asked(h):
        return slice(None) if due is None else passes(due, h.view("i8") ^ _of_run(run))

    def named(k, p, a, b):
        place, count = _distinct(a, b)
        return k, p[place], a[place].view("i8"), (b[place] >> np.uint64(32) << np.uint64(2) | np.uint64(k - 1)).astype("u4").view("i4"), count

    if 1 in levels:
        p = np.flatnonzero(ok if spell else inner)
        if spell:
            p = p[asked(ga[p])]
        yield named(1, p, ga[p], gb[p])
    if new is None:
        return
    for k in range(2, levels.stop):
        m = len(ids) - k + 1
        p = np.flatnonzero(ok[:m] & ok[1:m + 1]) if m > 0 else []
        if not len(p):
            return
        last = ids[p + k - 1]
        a = _mixed(ga[p] * np.uint64(_MIX[0]) ^ text.hashes[0][last])
        b = _mixed(gb[p] * np.uint64(_MIX[0]) ^ text.hashes[1][last])
        done = was[p] & was[p + 1] if was is not None else None
        through = passes(new, a.view("i8")) if spell or k + 1 < levels.stop else None
        if rest and through is not None:
            through = through | ~done
        if k in levels:
            take = np.flatnonzero(through) if spell else slice(None) if done is None else ~done
            if spell:
                take = take[asked(a[take])]
            if len(p[take]):
                yield named(k, p[take], a[take], b[take])
        if k + 1 < levels.stop:
            ga, gb, ok = np.zeros(m, "u8"), np.zeros(m, "u8"), np.zeros(m, dtype=bool)
            ga[p], gb[p], ok[p] = a, b, through
            if was is not None:
                was = np.zeros(m, dtype=bool)
                was[p] = done & passes(old, a.view("i8"))


def _run_name(task: int, number: int) -> int:
    """A run of text as 32 bits; runs that share a name cost time at most."""
    import xxhash

    return int(np.uint32(xxhash.xxh32_intdigest(f"{task} {number}")).view("i4"))


def _of_run(run: int) -> np.int64:
    """What sets a run's hashes apart from those of other runs; ``_due`` is the same as a column."""
    return np.int64(run) << np.int64(32) | np.int64(run & 0xFFFFFFFF)


def _due() -> Column:
    run = F.col("run").cast("long")
    return F.col("a").bitwiseXOR(F.shiftleft(run, 32).bitwiseOR(run.bitwiseAND(F.lit(0xFFFFFFFF))))


def _parts(text: bytes, limit: int) -> Iterator[bytes]:
    """A folded text in parts of about ``limit`` bytes, cut where a piece ends."""
    at = 0
    while len(text) - at > limit:
        cut = text.rfind(b"\n", at, at + limit)
        if cut < at:
            cut = text.find(b"\n", at)
            if cut < 0:
                break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


def _spelt(lang: str, text: Words, found) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _NAMES.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in (
        (0, pa.int64()), (0, pa.int32()), (lang, pa.string()), (0, pa.int32()), (b"", pa.binary()),
        (int((text.ids > 0).sum()), pa.int64()))], names=names)
    for k, p, a, b, _ in found:
        words = [text.words.take(pa.array(text.ids[p + i])) for i in range(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.repeat(pa.scalar(lang), len(p)), pa.array(np.full(len(p), k, "i4")),
             pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary())), pa.array(np.zeros(len(p), "i8"))], names=names)


def _planes(x: np.ndarray) -> bytes:
    """The highest bytes of all numbers, then the next ones: what sorted numbers share compresses."""
    return x.astype(x.dtype.newbyteorder(">")).view("u1").reshape(len(x), -1).T.tobytes()


def _unplaned(planes: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(planes, "u1").reshape(width, -1).T.copy().view(">" + kind).ravel().astype(kind)


def _blocks(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ranges: int) -> pa.RecordBatch:
    """Hashes and counts as one row a range of hashes, each sorted."""
    a, b, n = (np.concatenate(x) for x in zip(*found))
    a = a.view("u8")
    order = np.argsort(a)
    a, b, n = a[order], b.view("u4")[order], n[order].astype("u8")
    part = (a >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1))) if len(a) else np.empty(0, "i8")
    ends = np.append(cuts[1:], len(a))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[cuts].astype("i4"))] + [pa.array([_planes(x[i:j]) for i, j in zip(cuts, ends)], pa.binary())
                                               for x in (a, b, n)], names=["part", "a", "b", "n"])


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray, *run: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts of equal pairs of hashes added up, with one of their runs."""
    order = np.argsort(a)
    if ((np.diff(a[order]) == 0) & (np.diff(b[order]) != 0)).any():  # first hashes met by chance
        order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    start = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0)))
    return a[start], b[start], np.add.reduceat(n, start), *(r[order[start]] for r in run)


def _adder(least: int, runs: bool = False):
    """A function for mapInArrow over blocks: the sums from ``least`` on, with ``runs`` each with a
    run that it was counted in. What a task holds is the different hashes of its ranges."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, rows = None, [], 0

        def summed():
            return _summed(*(np.concatenate(x) for x in zip(*([held] if held else []), *waiting)))

        for batch in batches:
            for i in range(len(batch)):
                block = tuple(_unplaned(batch.column(c)[i].as_py(), kind) for c, kind in ((1, "u8"), (2, "u4"), (3, "u8")))
                if runs:
                    block += (np.full(len(block[0]), batch.column(4)[i].as_py(), "i4"),)
                waiting.append(block)
                rows += len(block[0])
                if rows >= max(WAITING_ROWS, len(held[0]) if held else 0):
                    held, waiting, rows = summed(), [], 0
        if waiting:
            held = summed()
        if held:
            keep = held[2] >= least
            out = [x[keep].view(kind) for x, kind in zip(held, ("i8", "i4", "i8", "i4"))]
            for at in range(0, len(out[0]), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[at:at + OUT_ROWS]) for x in out],
                                                 names=["a", "b", "n", "run"][:len(out)])

    return add


def _scanner(levels: range, new, old, run_bytes: int, spell: bool = False, ranges: int = 1,
             rest: bool = False, runs: bool = False, due=None, anywhere: bool = False):
    """A function for mapInArrow over (lang, text as bytes): counts of the phrases that
    ``occurring`` names in blocks (with ``runs`` each block names its run of text), or with
    ``spell`` the words of those due in a run, or ``anywhere``, and the number of all words."""
    spelt_out = [np.empty(0, dtype="i8")]  # sorted hashes of the phrases that this task has spelt in any run

    def fresh(found):
        for k, p, a, b, n in found:
            known = spelt_out[0]
            at = np.searchsorted(known, a)
            new = at == len(known)
            new[~new] = known[at[~new]] != a[~new]
            if len(known) < SPELT_ROWS:
                order = np.argsort(a[new])
                spelt_out[0] = np.insert(known, at[new][order], a[new][order])
            else:
                spelt_out[0] = np.sort(a[new])
            yield k, p[new], a[new], b[new], n[new]

    def flushed(held: dict[str, list[bytes]], number: int) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        name = 0 if anywhere else _run_name(TaskContext.get().partitionId(), number)
        run = []
        for lang, texts in held.items():
            text = Words(b"\n".join(texts))
            if not len(text.ids):
                continue
            found = occurring(text, xxhash.xxh64_intdigest(lang.encode()), levels, new and new.value, old and old.value, spell, rest,
                              due and due.value, name)
            if spell:
                yield from _spelt(lang, text, fresh(found) if anywhere else found)
                continue
            run += [(a, b, n) for _, _, a, b, n in found]
        if run:
            block = _blocks(run, ranges)
            yield block.append_column("run", pa.array(np.full(len(block), name, "i4"))) if runs else block

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt_out[0] = spelt_out[0][:0]
        held, size, number = {}, 0, 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                for part in _parts(text.as_py().translate(_FOLD), run_bytes):
                    held.setdefault(lang, []).append(part)
                    size += len(part) + 1
                    if size >= run_bytes:
                        yield from flushed(held, number)
                        held, size, number = {}, 0, number + 1
        yield from flushed(held, number)

    return scan


def hash_ranges(texts: DataFrame) -> int:
    """In how many ranges the hashes of ``texts`` are counted."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MAX_RANGES, 1 + size // RANGE_BYTES)


def counts(texts: DataFrame, levels: range, least: int, new=None, old=None, run_bytes: int = RUN_BYTES,
           ranges: int = 1, rest: bool = False, runs: bool = False) -> DataFrame:
    """(a, b, n): counts of the phrases that ``occurring`` names, from ``least`` on; with ``runs``
    also one run of text that each was counted in."""
    run = f", {_RUN}" if runs else ""
    found = texts.mapInArrow(_scanner(levels, new, old, run_bytes, ranges=ranges, rest=rest, runs=runs), _BLOCKS + run)
    return found.repartition(ranges, "part").mapInArrow(_adder(least, runs), _COUNTS + run)


def _length(b: str) -> Column:
    return F.col(b).bitwiseAND(F.lit(3)) + 1


def spelt(texts: DataFrame, found: DataFrame, max_words: int = MAX_WORDS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(lang, k, phrase, n): ``found`` with its words, and all words of a language (k = 0).

    A phrase is spelt in its ``run`` of the texts; those that the runs of this scan do not hold
    (the texts came in another order) are spelt in any run."""
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast(filter_of(found, "a"))

    def named(rows: DataFrame, key: Column, anywhere: bool = False) -> DataFrame:
        due = sc.broadcast(filter_of(rows.select(key.alias("a")), "a"))
        names = texts.mapInArrow(_scanner(range(1, max_words + 1), shared, None, run_bytes, spell=True, due=due,
                                          anywhere=anywhere), _NAMES)
        # once each; words that pass a filter by chance find no count
        once = names.groupBy("a", "b", "lang", "k", "phrase").agg(F.sum("n").alias("total"))
        return (once.join(rows.select("a", "b", "n"), ["a", "b"], "left").where("n is not null or k = 0")
                .select("a", "b", "lang", "k", "phrase", F.coalesce("n", "total").alias("n")))

    own = written(named(found, _due()), "names")
    left = written(found.join(own.where("k > 0"), ["a", "b"], "left_anti"), "unnamed")
    if not left.isEmpty():
        own = own.unionByName(named(left, F.col("a"), anywhere=True).where("k > 0"))
    return own.select("lang", "k", "phrase", "n")


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def proposal(texts: DataFrame, share: float = SAMPLE, min_count: int = MIN_COUNT, lowered: float = LOWERED,
             max_words: int = MAX_WORDS, run_bytes: int = RUN_BYTES) -> np.ndarray:
    """Filter of the phrases that a hash-random sample of the texts proposes."""
    spark = texts.sparkSession
    sample = written(texts.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < int(share * (1 << 20))), "sample")
    least = max(2, int(lowered * share * min_count))
    ranges = hash_ranges(sample)
    have: np.ndarray | None = None
    for k in range(1, max_words):  # what is proposed of the longest has no extension to let through
        shared = None if have is None else spark.sparkContext.broadcast(have)
        found = filter_of(counts(sample, range(k, k + 1), least, new=shared, run_bytes=run_bytes, ranges=ranges), "a")
        have = found if have is None else have | found
    return have


def frequent(texts: DataFrame, proposed: np.ndarray, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
             run_bytes: int = RUN_BYTES, passes_log: list | None = None, few: float = FEW) -> DataFrame:
    """(a, b, n, run): every phrase of at most ``max_words`` words with ``min_count`` occurrences,
    exact whatever ``proposed`` holds. ``passes_log`` takes the number of border failures of
    every scan: phrases found frequent whose extensions were not counted."""
    if not 2 <= max_words <= 4:
        raise ValueError("phrases have 2 to 4 words at most")
    sc = texts.sparkSession.sparkContext
    ranges = hash_ranges(texts)
    now = sc.broadcast(proposed)
    all_found = found = written(counts(texts, range(1, max_words + 1), min_count, new=now, run_bytes=run_bytes, ranges=ranges, runs=True), "phrases")
    while True:
        known = F.pandas_udf(_known(now), "boolean")
        failures = written(found.where(_length("b") < max_words).where(~known(F.col("a"))).select("a"), "failures")
        n = failures.count()
        if passes_log is not None:
            passes_log.append(n)
        if not n:
            return all_found
        was, now = now, sc.broadcast(now.value | filter_of(failures, "a"))
        rest = n <= few * found.count()
        found = written(counts(texts, range(2, max_words + 1), min_count, new=now, old=was, run_bytes=run_bytes, ranges=ranges, rest=rest, runs=True), "phrases")
        all_found = all_found.unionByName(found)
        if rest:
            if passes_log is not None:
                passes_log.append(0)
            return all_found


def _known(shared):
    import pandas as pd

    return lambda h: pd.Series(passes(shared.value, h.to_numpy("i8")))


def _split(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ").cast("binary")


def scored(found: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of every candidate: its lowest-scoring cut."""
    cand = found.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"),
                                        F.split(F.col("phrase").cast("string"), " ", -1).alias("w"))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    halves = cand.withColumn("cut", cut).select(
        "lang", "phrase", "k", "a", "cut", _split(F.col("w"), F.lit(1), F.col("cut")).alias("first"),
        _split(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    # plain tables on both sides, so that Spark can split a word that very many phrases begin or end with
    part = found.where(F.col("k").between(1, max_words - 1)).select(
        F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias("_n"))
    for side, count in (("first", "l"), ("rest", "r")):
        halves = (halves.join(part, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part")))
                  .withColumn(count, F.col("_n")).drop("_lang", "_part", "_n", side))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    halves = (halves.withColumn("_x", F.lit(SCORE_UNIT).cast("decimal(10,0)") * wide("a")).withColumn("_y", wide("l") + wide("r"))
              .withColumn("score", F.expr("_x div _y")))
    return (halves.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r")).alias("b"))
            .select("lang", "phrase", "b.k", "b.a", "b.l", "b.r", "b.score"))


def absorbed(found: DataFrame, max_words: int = MAX_WORDS, absorb: int = ABSORB) -> DataFrame:
    """(lang, phrase) of the candidates that a longer one stands for."""
    longer = found.where("k >= 3").select("lang", "n", "k", F.split(F.col("phrase").cast("string"), " ", -1).alias("w"))
    spans = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m"))
                      for m in range(2, max_words) for s in range(1, max_words - m + 2)])
    inside = (longer.withColumn("p", F.explode(spans)).where("p.m < k and p.s + p.m - 1 <= k")
              .select("lang", _split(F.col("w"), F.col("p.s"), F.col("p.m")).alias("phrase"), "n")
              .groupBy("lang", "phrase").agg(F.max("n").alias("most")))
    own = found.where("k >= 2").select("lang", "phrase", "n")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return own.join(inside, ["lang", "phrase"]).where(100 * wide("most") >= absorb * wide("n")).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, share: float = SAMPLE, absorb: int = ABSORB,
                 run_bytes: int = RUN_BYTES, passes_log: list | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases, by falling
    score, falling count, then the phrase's bytes."""
    texts = _texts(docs, text, lang)
    proposed = proposal(texts, share, min_count, max_words=max_words, run_bytes=run_bytes)
    found = written(spelt(texts, frequent(texts, proposed, min_count, max_words, run_bytes, passes_log),
                          max_words, run_bytes), "spelt")
    rows = (scored(found, min_count, max_words)
            .join(absorbed(found, max_words, absorb), ["lang", "phrase"], "left_anti"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    group = F.pmod(F.xxhash64("phrase"), F.lit(PICK_GROUPS))
    first = (rows.withColumn("_g", group)
             .withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_g").orderBy(*order))).where(F.col("_k") <= top))
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = found.where("k = 0").select(F.col("lang").alias("_lang"), F.col("n"))
    return (best.join(total, F.col("lang") == F.col("_lang"))
            .select("lang", F.col("rank").cast("bigint").alias("rank"), F.col("phrase").cast("string").alias("phrase"),
                    "a", "l", "r", "n", "score"))
