"""Operator 10: benchmark decontamination.

1. Seeds. Every run of ``SEED`` words of a test item is a seed; of an item of fewer words, all
   of it is. One scan over the
   documents looks every run of words up in the seeds (a sorted array of hashes) and
   writes, for each (document, item) that shares one, the stretch of the document that
   the item could cover, and the seeds. Texts are read whole and never shuffled.
2. Rarity. The distinct documents that hold each seed are counted; a seed in ``df`` of
   ``N`` documents is worth ``ln(N / df)``. The sum is reported as ``evidence`` and decides
   nothing: an item that leaked into every document is found like any other.
3. Alignment. Smith-Waterman over words (match 2, mismatch -1, gap -1), all stretches of
   an item at once, scores copies that were paraphrased or edited; the similarity is the
   score over that of an exact copy. A passage counts if its similarity reaches
   ``MIN_SIMILARITY`` or its score ``MIN_SCORE``, so a part of a long item is found as well.
   Every stretch with a seed is aligned, but for those that share too few words with the
   item for any alignment to reach the threshold.

The test items come to the driver in blocks of at most ``BLOCK_SEEDS`` seeds, each searched
in a scan of its own; that bounds what is broadcast whatever the size of the benchmark.

Defined cases: words are lower-cased runs of letters and digits; null texts have none;
an item with fewer than ``SEED`` words is found where it stands word for word, one without
words nowhere; an item id that is null is kept as such; repeated rows give repeated results; an empty table on either
side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_apart, written

#: Words in a seed.
SEED = 4
#: Seeds in a block of test items at most.
BLOCK_SEEDS = 1_000_000
#: Smith-Waterman scores.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an exact copy's score from which a document counts as contaminated.
MIN_SIMILARITY = 0.5
#: Score from which it does whatever the item's length: 13 words in a row, or more with edits.
MIN_SCORE = 26
#: A stretch reaches so many words, as a share of the item's length, past where the item would end.
SLACK = 0.5
#: Hits of a text that are worked on at once.
HITS = 2_000_000
#: Cells of an alignment that are worked on at once.
ALIGN_CELLS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Block:
    """Some test items, as arrays: vocabulary, sorted seed hashes, and postings by seed."""

    vocab: dict[str, int]
    items: list[np.ndarray]  # word ids
    names: list  # item ids
    seeds: np.ndarray
    first: np.ndarray  # postings of seed k: first[k] to first[k + 1]
    item: np.ndarray
    offset: np.ndarray
    sizes: list[int]  # words of the seeds there are


def _runs(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the runs of ``size`` word ids that begin at ``at``."""
    h = np.full(len(at), size, dtype="u8")
    for k in range(size):
        h = (h ^ ids[at + k].astype("u8")) * np.uint64(_MIX[0])
        h ^= h >> np.uint64(29)
    return h * np.uint64(_MIX[1])


def make_block(rows: list[tuple]) -> Block:
    vocab: dict[str, int] = {}
    items, names, hashes, item, offset, sizes = [], [], [], [], [], set()
    for name, words in rows:
        ids = np.array([vocab.setdefault(w, len(vocab) + 1) for w in words], dtype="i4")
        size = min(SEED, len(ids))
        sizes.add(size)
        h = _runs(ids, np.arange(len(ids) - size + 1), size)
        hashes.append(h)
        item.append(np.full(len(h), len(items), dtype="i4"))
        offset.append(np.arange(len(h), dtype="i4"))
        items.append(ids)
        names.append(name)
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    seeds, first = np.unique(flat[order], return_index=True)
    return Block(vocab, items, names, seeds, np.append(first, len(flat)),
                 np.concatenate(item)[order], np.concatenate(offset)[order], sorted(sizes))


def blocks(benchmark: DataFrame, key: str, text: str, limit: int = BLOCK_SEEDS) -> Iterator[Block]:
    """Blocks of test items, streamed partition by partition."""
    rows, seeds = [], 0
    for r in benchmark.select(F.col(key).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = words_of(r.t)
        if not words:
            continue
        if rows and seeds + len(words) > limit:
            yield make_block(rows)
            rows, seeds = [], 0
        rows.append((r.i, words))
        seeds += len(words)
    if rows:
        yield make_block(rows)


def _hits(ids: np.ndarray, size: int, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(position, seed) of the runs of ``size`` words of a text that are seeds."""
    n = len(ids) - size + 1
    whole = ids[:n] > 0
    for k in range(1, size):
        whole &= ids[k:k + n] > 0
    at = np.flatnonzero(whole)
    h = _runs(ids, at, size)
    place = np.searchsorted(block.seeds, h)
    place[place == len(block.seeds)] = 0
    hit = block.seeds[place] == h
    return at[hit], place[hit]


def stretches(words: list[str], block: Block) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(item, start, word ids, seeds) for each stretch of a text that shares seeds with an item."""
    get = block.vocab.get
    ids = np.fromiter((get(w, 0) for w in words), dtype="i4", count=len(words))
    found = [_hits(ids, size, block) for size in block.sizes if size <= len(ids)]
    at, place = (np.concatenate(x) for x in zip(*found)) if found else ((), ())
    if not len(at):
        return
    count = block.first[place + 1] - block.first[place]
    # a text of very many hits is worked off in parts, each cut between two hits
    part = (np.cumsum(count) - count) // HITS
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(at)]
    for a, b in zip(edges[:-1], edges[1:]):
        yield from _merged(at[a:b], place[a:b], count[a:b], ids, block)


def _merged(at: np.ndarray, place: np.ndarray, count: np.ndarray, ids: np.ndarray, block: Block):
    """The stretches of hits (position, seed), those of one item that overlap merged."""
    post = np.repeat(block.first[place] - np.cumsum(count) + count, count) + np.arange(count.sum())
    pos, seed, item, off = np.repeat(at, count), np.repeat(place, count), block.item[post], block.offset[post]
    order = np.argsort(item, kind="stable")
    pos, seed, item, off = pos[order], seed[order], item[order], off[order]
    edges = [0, *(np.flatnonzero(item[1:] != item[:-1]) + 1).tolist(), len(item)]
    for x, y in zip(edges[:-1], edges[1:]):
        i = int(item[x])
        size = len(block.items[i])
        slack = int(math.ceil(size * SLACK))
        lo = np.maximum(pos[x:y] - off[x:y] - slack, 0)
        hi = np.minimum(pos[x:y] - off[x:y] + size + slack, len(ids))
        order = np.argsort(lo, kind="stable")
        lo, hi, own = lo[order], np.maximum.accumulate(hi[order]), seed[x:y][order]
        cut = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(lo))):
            yield i, int(lo[a]), ids[lo[a]:hi[b - 1]], np.unique(own[a:b])


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of ``item`` with each row of ``stretch`` (0-padded), and
    the position after its last word."""
    rows, width = stretch.shape
    step = np.arange(width, dtype="i4") * -GAP
    prev = np.zeros((rows, width + 1), dtype="i4")
    best, end = np.zeros(rows, dtype="i4"), np.zeros(rows, dtype="i4")
    for w in item.tolist():
        now = np.maximum(prev[:, :-1] + np.where(stretch == w, MATCH, MISMATCH), prev[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        # a gap in the item: the best earlier cell of this row, less its distance
        now = np.maximum.accumulate(now + step, axis=1) - step
        prev[:, 1:] = now
        top = now.argmax(axis=1)
        value = now[np.arange(rows), top]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
    return best, end


def _reach(item: np.ndarray, stretch: np.ndarray) -> int:
    """A score that no alignment of the two exceeds, from the words they share."""
    return MATCH * int(min(np.isin(stretch, item).sum(), np.isin(item, stretch).sum()))


def _padded(parts: list[np.ndarray], back: bool = False) -> np.ndarray:
    out = np.zeros((len(parts), max(map(len, parts))), dtype="i4")
    for r, p in enumerate(parts):
        out[r, :len(p)] = p[::-1] if back else p
    return out


def _candidates(docs: DataFrame, block: Block, key: str, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(block))  # at most BLOCK_SEEDS seeds

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = Block(**shared.value)
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"]):
                seen: set[int] = set()  # a seed counts once a document, whatever its items and stretches
                for x in stretches(words_of(t), b):
                    new = set(x[-1].tolist()) - seen
                    seen |= new
                    rows.append((k, *x, sorted(new)))
            if rows:
                yield pd.DataFrame(rows, columns=["k", "item", "start", "ids", "seeds", "new"])

    # the key travels as text: a column of numbers and nulls would reach pandas as floats
    return docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(
        scan, "k string, item int, start int, ids array<int>, seeds array<int>, new array<int>")


def _schema(key_type: T.DataType, item_type: T.DataType, key: str) -> T.StructType:
    return T.StructType([T.StructField(key, key_type), T.StructField("item_id", item_type),
                         T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()),
                         T.StructField("end_word", T.LongType()), T.StructField("n_seeds", T.LongType()),
                         T.StructField("evidence", T.DoubleType())])


def _aligned(found: DataFrame, block: Block, worth: np.ndarray, min_similarity: float, min_score: float, key: str,
             key_type: T.DataType, item_type: T.DataType) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast((vars(block), worth))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, value = Block(**shared.value[0]), shared.value[1]
        for batch in batches:
            seeds = [np.asarray(s) for s in batch["seeds"]]
            evidence = np.array([value[s].sum() for s in seeds])
            batch = batch.assign(evidence=evidence, n_seeds=[len(s) for s in seeds])
            out = []
            for i, group in batch.groupby("item", sort=False):
                item = b.items[i]
                full, at = MATCH * len(item), 0
                least = min(min_similarity * full, min_score)
                group = group[[_reach(item, np.asarray(x)) >= least for x in group["ids"]]]
                parts = [np.asarray(x) for x in group["ids"]]
                while at < len(parts):
                    to = max(at + 1, min(len(parts), at + ALIGN_CELLS // max(map(len, parts[at:at + 4096]))))
                    best, end = align(item, _padded(parts[at:to]))
                    keep = np.flatnonzero(best >= least)
                    if len(keep):  # the reverse alignment of what lies before the end finds the start
                        heads = [parts[at + r][:end[r]] for r in keep]
                        _, back = align(item[::-1], _padded(heads, back=True))
                        rows = group.iloc[at + keep]
                        out.append(pd.DataFrame({
                            key: rows["k"].to_numpy(), "item_id": [b.names[i]] * len(keep),
                            "similarity": best[keep] / full,
                            "start_word": rows["start"].to_numpy() + end[keep] - back,
                            "end_word": rows["start"].to_numpy() + end[keep],
                            "n_seeds": rows["n_seeds"].to_numpy(), "evidence": rows["evidence"].to_numpy()}))
                    at = to
            if out:
                yield pd.concat(out)

    rows = found.mapInPandas(judge, _schema(T.StringType(), item_type, key))
    return rows.withColumn(key, F.col(key).cast(key_type))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text", min_similarity: float = MIN_SIMILARITY,
                 block_seeds: int = BLOCK_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, end_word, n_seeds, evidence): every passage
    of a document that aligns with a test item."""
    item_type = benchmark.schema[item_key].dataType
    total, out = None, None
    for n, block in enumerate(blocks(benchmark, item_key, item_text, block_seeds)):
        total = docs.count() if total is None else total
        found = written(_candidates(docs, block, key, text), f"seeds-{n}")
        df = found.select(F.explode("new").alias("s")).groupBy("s").count().toPandas()  # one row per seed at most
        worth = np.zeros(len(block.seeds))
        worth[df["s"]] = np.log(total / df["count"])
        part = _aligned(found.drop("new"), block, worth, min_similarity, min_score, key, docs.schema[key].dataType,
                        item_type)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], _schema(docs.schema[key].dataType, item_type, key))
    return out


@columns_apart("key", "text")
def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                         **params) -> DataFrame:
    """``docs`` without the documents in which a passage aligns with a test item."""
    hits = contaminated(docs, benchmark, key, text, **params).select(F.col(key).alias("_k")).distinct()
    return docs.join(hits, docs[key].eqNullSafe(hits["_k"]), "left_anti")
