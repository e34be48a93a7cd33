"""Operator 2: n-gram Jaccard self-join with Bayesian candidate pruning.

Two texts are linked when the Jaccard similarity of their sets of five-word shingles is
at least 0.8. Equal texts are one class, whatever their number of copies.

1. Classes. One scan computes per document the md5 of its text and, in Python, MinHash
   values of its shingles. Documents are grouped by the md5 (map-side combine), so a
   group of copies costs one row from here on.
2. Candidates. Values are cut into bands; classes that agree on a band meet in a bucket.
   A bucket of n classes is dealt into ``ceil(n / BLOCK)`` blocks, and each pair of
   blocks is a group of its own, so no task holds more than two blocks.
3. Pruning. In a group all pairs compare their MinHash values a slice at a time. With m
   of n values equal, the similarity has the posterior Beta(m + 1, n - m + 1); a pair is
   dropped as soon as the posterior chance of the threshold is below ``TOLERANCE``.
   What leaves a task is a spanning forest of the surviving pairs, not the pairs.
4. Verification. The components of the forests are small families of likely links. Their
   texts alone are shuffled (a fixed-size filter keeps the others out), dealt into
   blocks again, pruned with all values, and every surviving pair is verified exactly on
   its shingle sets. A task returns each class's number of links and one edge to the
   smallest class that it is connected with.

A pair with similarity s meets in some band with chance ``1 - (1 - s^ROWS)^BANDS``: 0.99993
at 0.8, more above. Every verified link counts; none is cut by a cap on buckets or partners.

Defined cases: words are runs of anything but ASCII white space, lower-cased; null text
is empty; a text without words has no shingles, and no links but to its copies; a text of
one to four words is one shingle; a null document id is kept, and stands for a class only
where it has no other; rows that share an id are told apart by their text; repeated rows
are copies; an empty table gives an empty result; further columns, whatever their names, are
ignored, or kept as they are where documents come back.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, columns_apart, maybe_in, shuffle_parts, written
from .components import components

#: Words in a shingle and the least similarity of a link.
SHINGLE, THRESHOLD = 5, 0.8
#: Bands of ROWS MinHash values each.
BANDS, ROWS = 24, 5
#: Values that pairs compare at a time in a bucket; the first SLICES of them are shipped there.
SLICE, SLICES = 20, 3
#: A pair is dropped when the posterior chance of reaching the threshold is below this.
TOLERANCE = 1e-5
#: Classes in a block.
BLOCK = 256

HASHES = BANDS * ROWS
_WORD = re.compile(WORD_RE)
_SEED = np.random.default_rng(20240).integers(1, 2**63, size=(2, HASHES), dtype="u8")
#: Word hashes that a task remembers.
CACHE_WORDS = 500_000


# -- shingles and MinHash ------------------------------------------------------

class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, dtype="u8")
    ids = np.fromiter(map(hashes.__getitem__, words), dtype="u8", count=len(words))
    width = min(SHINGLE, len(ids))
    n = len(ids) - width + 1
    h = np.full(n, width, dtype="u8")
    for k in range(width):
        h = (h ^ ids[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def minhash(sh: np.ndarray) -> np.ndarray:
    """HASHES MinHash values (32 bits each) of a set of shingle hashes."""
    a, b = _SEED[0] | np.uint64(1), _SEED[1]
    best = np.full(HASHES, 2**32 - 1, dtype="u4")
    for at in range(0, len(sh), 2048):
        x = sh[at:at + 2048, None] * a + b
        x ^= x >> np.uint64(29)
        np.minimum(best, ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).min(axis=0).astype("u4"), out=best)
    return best


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among n values with which a pair goes on.

    The posterior Beta(m + 1, n - m + 1) exceeds t with the chance that at most m of n + 1
    draws of chance t succeed.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold)**(n + 1 - m)
        if total >= tolerance:
            return m
    return n


#: By number of values compared.
LEAST_MATCHES = {n: least_matches(n) for n in range(SLICE, HASHES + 1, SLICE)}


def surviving(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that no slice of the values rules out; with ``same`` the
    two are one block and each pair comes once."""
    n = min(SLICE, a.shape[1])
    i, j = np.nonzero(sum((a[:, None, k] == b[None, :, k]).astype("i2") for k in range(n)) >= LEAST_MATCHES[n])
    if same:
        i, j = i[i < j], j[i < j]
    while n < a.shape[1] and len(i):
        to = min(n + SLICE, a.shape[1])
        keep = (a[i, :to] == b[j, :to]).sum(axis=1) >= LEAST_MATCHES[to]
        i, j, n = i[keep], j[keep], to
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component under the edges (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


# -- Spark stages --------------------------------------------------------------

def class_key(text: Column) -> Column:
    """md5 of a text."""
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "utf-8")))


def _buckets(sig: Column) -> Column:
    """A 64-bit key for each band of a signature, if there is one."""
    keys = [F.xxhash64(F.lit(k), F.substring(sig, 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)]
    return F.when(F.octet_length(sig) > 0, F.array(*keys)).otherwise(F.array().cast("array<bigint>"))


def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    hashes = WordHashes()
    for batch in batches:
        sets = (shingles(t, hashes) for t in batch)
        yield pd.Series([minhash(x).tobytes() if len(x) else b"" for x in sets], dtype=object)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(cls, cid, rep, copies, sig): one row per class of equal texts.

    ``rep`` is the smallest id of the class, ``cid`` a number of it, good for this table.
    """
    sign = F.pandas_udf(_signed, "binary")
    rows = docs.select(F.col(key).alias("id"), class_key(F.col(text)).alias("cls"),
                       sign(F.coalesce(F.col(text), F.lit(""))).alias("sig"))
    one = rows.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                  F.first("sig").alias("sig"))
    return written(one.withColumn("cid", F.monotonically_increasing_id()), "classes")


def _dealt(rows: DataFrame, group: list[str], size: str, cid: str = "cid") -> DataFrame:
    """Rows of a group dealt into blocks and copied to every pair of blocks they belong to:
    ``bi <= bj`` name the pair, ``side`` says whether the row is of block ``bj``."""
    n = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64(cid), n).cast("int")
    return (rows.withColumn("_b", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), n - 1)))
            .withColumn("bi", F.least("_b", "_o")).withColumn("bj", F.greatest("_b", "_o"))
            .withColumn("side", F.col("_b") != F.col("bi")).drop("_b", "_o", size)
            .repartition(shuffle_parts(rows.sparkSession), *group, "bi", "bj")
            .sortWithinPartitions(*group, "bi", "bj"))


def _groups(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The sorted groups of a partition, one at a time."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        keys = batch[names]
        cut = np.flatnonzero((keys.values[1:] != keys.values[:-1]).any(axis=1)) + 1
        edges = [0, *cut.tolist(), len(batch)]
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield batch.iloc[a:b]
        held = batch.iloc[edges[-2]:]
    if held is not None and len(held):
        yield held


def _values(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype="u4") for x in column])


def _likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forest edges (u, v) of the pairs in each group that pruning leaves."""
    us, vs = [], []
    for g in _groups(batches, ["bucket", "bi", "bj"]):
        if len(g) < 2:
            continue
        cid, sig, side = g["cid"].to_numpy(), _values(g["sig"]), g["side"].to_numpy(dtype=bool)
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        same = g["bi"].iat[0] == g["bj"].iat[0]
        if not len(a) or not (same or len(b)):
            continue
        i, j = surviving(sig[a], sig[a if same else b], same)
        root = forest(len(g), a[i], (a if same else b)[j])
        x = np.flatnonzero(root != np.arange(len(g)))
        us.append(cid[x])
        vs.append(cid[root[x]])
        if len(us) >= 2000:
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})
            us, vs = [], []
    if us:
        yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})


def families(cls: DataFrame) -> DataFrame:
    """(cid, family): components of the pairs that pruning by the first values leaves."""
    rows = cls.select("cid", F.explode(_buckets(F.col("sig"))).alias("bucket"))
    # written, so that the join can split a bucket that very many classes share
    sizes = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    head = cls.select(F.col("cid").alias("_c"), F.substring("sig", 1, 4 * SLICE * SLICES).alias("sig"))
    met = rows.join(sizes, "bucket").join(head, F.col("cid") == F.col("_c")).drop("_c")
    edges = _dealt(met, ["bucket"], "n").select("bucket", "bi", "bj", "side", "cid", "sig").mapInPandas(
        _likely, "u long, v long")
    return components(edges).select(F.col("node").alias("cid"), F.col("root").alias("family"))


def _verifier(threshold: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for g in _groups(batches, ["family", "bi", "bj"]):
            if len(g) < 2:
                continue
            cid, sig, side = g["cid"].to_numpy(), _values(g["sig"]), g["side"].to_numpy(dtype=bool)
            a, b = np.flatnonzero(~side), np.flatnonzero(side)
            same = g["bi"].iat[0] == g["bj"].iat[0]
            if not len(a) or not (same or len(b)):
                continue
            i, j = surviving(sig[a], sig[a if same else b], same)
            i, j = a[i], (a if same else b)[j]
            if not len(i):
                continue
            need = np.unique(np.concatenate([i, j]))
            texts = g["text"].to_numpy()
            sets = {k: shingles(texts[k], hashes) for k in need.tolist()}
            every = np.unique(np.concatenate(list(sets.values())))
            sets = {k: np.searchsorted(every, s) for k, s in sets.items()}
            mark = np.zeros(len(every), dtype=bool)
            link = np.zeros(len(i), dtype=bool)
            order = np.argsort(i, kind="stable")
            last = -1
            for p in order.tolist():
                x, y = int(i[p]), int(j[p])
                if x != last:
                    mark[:] = False
                    mark[sets[x]] = True
                    last = x
                both = int(mark[sets[y]].sum())
                link[p] = both >= threshold * (len(sets[x]) + len(sets[y]) - both) - 1e-9
            i, j = i[link], j[link]
            n = np.bincount(np.concatenate([i, j]), minlength=len(g))
            root = forest(len(g), i, j)
            x = np.flatnonzero(n)
            if len(x):
                yield pd.DataFrame({"cid": cid[x], "links": n[x], "to": cid[root[x]]})

    return verify


def linked(docs: DataFrame, cls: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(cid, n_links, group): classes with a verified link, the number of other classes
    linked to each, and the smallest class of its connected group."""
    fam = families(cls)
    size = fam.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    members = written(fam.join(size, "family").join(cls.select("cid", "cls", "rep", "sig"), "cid"), "families")
    # One text of each class in a family; the filter keeps all other texts out of the shuffle.
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), class_key(F.col(text)).alias("cls"))
    texts = texts.where(maybe_in(F.xxhash64("cls", "id"), members.select(F.xxhash64("cls", "rep").alias("h")), "h"))
    one = (members.join(texts, (members["cls"] == texts["cls"]) & members["rep"].eqNullSafe(texts["id"]))
           .select("cid", "family", "n", "sig", "text"))
    # rows that share id and text meet the family more than once: blocks need them once
    met = _dealt(one.dropDuplicates(["cid"]), ["family"], "n")
    part = written(met.select("family", "bi", "bj", "side", "cid", "sig", "text").mapInPandas(
        _verifier(threshold), "cid long, links long, to long"), "links")
    group = components(part.select(F.col("cid").alias("u"), F.col("to").alias("v")))
    return (part.groupBy("cid").agg(F.sum("links").alias("n_links"))
            .join(group.withColumnRenamed("node", "cid"), "cid").select("cid", "n_links", F.col("root").alias("group")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per document: ``key, text_class, n_copies, n_links, class_id, cls``.

    ``text_class`` is the smallest id among the texts with the same words, of which there
    are ``n_copies``; ``n_links`` the number of different texts linked to it; ``class_id`` the
    smallest id of its group of copies and linked texts.
    """
    cls = classes(docs, key, text)
    links = linked(docs, cls, threshold, key, text)
    known = cls.select("cid", "cls", "rep", "copies").join(links, "cid", "left").withColumn(
        "group", F.coalesce("group", "cid"))
    lead = known.groupBy("group").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "cid")).alias("lead"))
    known = written(known.join(lead, "group").select(
        F.col("cls").alias("_cls"), F.col("rep").alias("text_class"), F.col("copies").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("lead.rep").alias("class_id"),
        # the class of which a copy stays when one document of the group is kept
        (F.col("cid") == F.col("lead.cid")).alias("leads")), "known")
    rows = docs.select(F.col(key), class_key(F.col(text)).alias("cls"))
    return rows.join(known, F.col("cls") == F.col("_cls")).drop("_cls")


@columns_apart("key", "text")
def one_per_group(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of every group: that with the smallest id (of rows that
    share it and its text, one)."""
    found = near_duplicates(docs.select(key, text), threshold, key, text)
    # (class, id) of all rows that can't stay without a second look
    seen = found.groupBy("cls", F.col(key).alias("_id")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.first(F.col("leads") & F.col(key).eqNullSafe(F.col("text_class"))).alias("_stays"))
    doubt = written(seen.where("_n > 1 or not _stays"), "doubt").withColumnRenamed("cls", "_cls")
    own = F.xxhash64(class_key(F.col(text)), F.col(key))
    marked = docs.withColumn("_maybe", maybe_in(own, doubt.select(F.xxhash64("_cls", "_id").alias("h")), "h"))
    sure = marked.where("not _maybe").drop("_maybe")
    rest = marked.where("_maybe").drop("_maybe").withColumn("_key", class_key(F.col(text)))
    judged = rest.join(doubt, (F.col("_key") == F.col("_cls")) & F.col(key).eqNullSafe(F.col("_id")), "left")
    clear = judged.where("_cls is null").select(*docs.columns)
    kept = judged.where("_cls is not null and _stays").dropDuplicates(["_key", "_id"]).select(*docs.columns)
    return sure.unionByName(clear).unionByName(kept)
