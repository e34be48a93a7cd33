"""Operator 1: documents as flat token-id files with 64-bit offsets.

Layout of a data set (one folder), little-endian and without headers, so that every
file can be memory-mapped as an array:

``ids-SSSSS.bin``      unsigned 16- or 32-bit token ids of a shard's documents, end to end
``docs-SSSSS.bin``     signed 64-bit document ids of the shard, ascending
``offsets-SSSSS.bin``  unsigned 64-bit: the id position, counted over ALL shards, at which
                       each document starts, and one more for the end of the shard
``nulls-SSSSS.bin``    one byte a document: 1 where the document id is null

Shards follow each other in ascending document id. Two passes write them: every task
of the first encodes one key range, writes ids and lengths and reports (shard, ids);
the prefix sum over those reports - one pair of numbers per shard - gives the bases,
and the second pass turns lengths into global offsets. A file is written under a name
of its attempt and renamed when complete, so a task that runs twice (lost executor,
speculation) leaves one whole file.

The text is encoded word by word through the tokenizer library: white space always
ends a token of this kind of vocabulary (words with ends, white space dropped), so the
ids of a text are the ids of its words one after another. Each worker process remembers
the ids of words it has seen (at most ``CACHE_WORDS``), which saves most of the work on
natural text. ``tests/llm`` holds the result against the library's own whole texts.
Special tokens whose string stands in a text become what the library makes of them by
default, their own id; ``plain_specials`` takes the string as ordinary text instead.

Defined cases: null text is empty (only the end id); a null document id sorts first
(and is kept as null); rows that share an id are ordered by the hash of their text;
a very long text is one document; an empty table writes no files and reads back as no
rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, shuffle_parts, slices

#: Words whose ids a worker process remembers, twice over (about 200 bytes each).
CACHE_WORDS = 500_000
#: Ids a reader checks and hands on at a time.
READ_DOCS = 20_000


class WordEncoder(dict):
    """Text to id bytes through a tokenizer file: a dict of words seen that learns others."""

    def __init__(self, path: str, width: int, limit: int = CACHE_WORDS, plain_specials: bool = False):
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_specials
        # a text that may hold a special token is left to the library as a whole
        self.special = [] if plain_specials else [
            t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.code, self.limit = {2: "H", 4: "I"}[width], limit
        # str.split() also parts at these; the tokenizer doesn't
        self.odd = re.compile("[\x1c-\x1f]")
        self.old: dict[str, bytes] = {}
        # Composed Latin letters (but the dotted capital I, whose small form is two characters),
        # then ASCII marks (but the apostrophe, which may start a contraction).
        self.shape = re.compile("([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*)"
                                r"([!-&(-/:-@\[-`{-~]*)").fullmatch
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xAA, 0x180)}

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tok.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        made = self.old.get(word)
        if made is None:
            head, tail = parts.groups() if (parts := self.shape(word)) else ("", "")
            if head and tail:
                made = self[head] + self[tail]  # marks after a letter are a piece apart
            elif head:
                # A run of letters that normalising only lower-cases is one piece for the model.
                low = head.lower()
                made = self[low] if low != head else self._bytes(
                    [t.id for t in self.tok.model.tokenize(low.translate(self.as_bytes))])
            else:
                made = self._whole(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = made
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = lambda t: self.odd.search(t) or any(s in t for s in self.special)
        return [self._whole(t) if whole(t) else b"".join(map(self.__getitem__, t.split())) for t in texts]


def encoder(path: str, width: int, plain_specials: bool = False) -> WordEncoder:
    """The worker process's encoder for a tokenizer file (kept between tasks)."""
    name = (path, width, plain_specials)
    kept = sys.modules["tokenizers"].__dict__.setdefault("_cachescope_encoders", {}) \
        if "tokenizers" in sys.modules else {}
    if name not in kept:
        import tokenizers

        made = WordEncoder(path, width, plain_specials=plain_specials)
        kept = tokenizers.__dict__.setdefault("_cachescope_encoders", {})
        kept[name] = made
    return kept[name]


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Put:
    """A file that gets its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, base = _fs(folder)
        task = TaskContext.get()
        self.final = f"{base}/{name}"
        self.now = f"{base}/_{name}.{task.taskAttemptId() if task else 0}"
        self.fs.create_dir(base, recursive=True)
        self.out = self.fs.open_output_stream(self.now)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.now, self.final)


def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file of the data set as an array: memory-mapped from a local or mounted folder,
    read through the file system's client otherwise."""
    fs, base = _fs(folder)
    if fs.type_name == "local":
        import os

        path = f"{base}/{name}"
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.empty(0, dtype=kind)
    with fs.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.read(), dtype=kind)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2,
                 key: str = "doc_id", text: str = "text",
                 plain_specials: bool = False) -> list[tuple[int, int, int]]:
    """Write the data set; returns (shard, documents, base) of each shard, in order.

    ``width`` is the bytes of an id: 2 for vocabularies up to 65,536, else 4. What comes
    back to the driver is one row of three numbers per shard.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), body.alias("text")).withColumn(
        "h", F.xxhash64("text"))
    # A shard is a range of ids; equal ids may go apart, ordered by their text's hash.
    rows = rows.repartitionByRange(shuffle_parts(spark), "id", "h").sortWithinPartitions("id", "h")
    # a column of numbers and nulls would reach pandas as floats
    rows = rows.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer, width, plain_specials)
        end = np.asarray([end_id], dtype=f"<u{width}").tobytes()
        files, n_docs, n_ids = None, 0, 0
        for batch in batches:
            texts, ids, none = batch["text"].tolist(), batch["id"].to_numpy("<i8"), batch["none"].to_numpy("u1")
            at = 0
            for run in slices(texts, 256, 1 << 20):
                files = files or [_Put(folder, f"{k}-{shard:05d}.bin") for k in ("ids", "docs", "nulls", "lengths")]
                coded = enc.encode(run)
                part = slice(at, at + len(run))
                at += len(run)
                lengths = np.array([len(b) // width + 1 for b in coded], dtype="<i8")
                files[0].write(b"".join([x for b in coded for x in (b, end)]))
                files[1].write(ids[part].tobytes())
                files[2].write(none[part].tobytes())
                files[3].write(lengths.tobytes())
                n_docs += len(run)
                n_ids += int(lengths.sum())
        for f in files or ():
            f.done()
        if n_docs:
            yield pd.DataFrame({"shard": [shard], "n_docs": [n_docs], "n_ids": [n_ids]})

    made = rows.mapInPandas(encode, "shard int, n_docs long, n_ids long").collect()
    shards, base = [], 0
    for r in sorted(made, key=lambda r: r.shard):
        shards.append((r.shard, r.n_docs, base))
        base += r.n_ids

    def offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, start in zip(batch["shard"], batch["base"]):
                lengths = _mapped(folder, f"lengths-{shard:05d}.bin", "<i8")
                ends = np.concatenate([[0], np.cumsum(lengths)]) + start
                f = _Put(folder, f"offsets-{shard:05d}.bin")
                f.write(ends.astype("<u8").tobytes())
                f.done()
            yield pd.DataFrame({"n": [len(batch)]})

    _per_shard(spark, shards).mapInPandas(offsets, "n long").agg(F.sum("n")).collect()
    return shards


def _per_shard(spark: SparkSession, shards: list[tuple[int, int, int]]) -> DataFrame:
    frame = spark.createDataFrame(shards, "shard int, n_docs long, base long")
    return frame.repartition(max(1, min(len(shards), 4096)), "shard")


def read_tokens(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]], width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    The checksum is over the ids as 32-bit integers, whatever width the files have.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for batch in batches:
            for shard in batch["shard"]:
                ids = _mapped(folder, f"ids-{shard:05d}.bin", f"<u{width}")
                offsets = _mapped(folder, f"offsets-{shard:05d}.bin", "<u8").astype("<i8")
                keys = _mapped(folder, f"docs-{shard:05d}.bin", "<i8")
                none = _mapped(folder, f"nulls-{shard:05d}.bin", "u1").astype(bool)
                for at in range(0, len(keys), READ_DOCS):
                    to = min(at + READ_DOCS, len(keys))
                    cut = offsets[at:to + 1] - offsets[0]
                    crc = [zlib.crc32(np.asarray(ids[i:j], dtype="<u4")) for i, j in zip(cut[:-1], cut[1:])]
                    yield pd.DataFrame({
                        "doc_id": keys[at:to], "none": none[at:to], "start": offsets[at:to], "n_tokens": np.diff(cut), "ids_crc32": crc})

    rows = _per_shard(spark, shards).select("shard").mapInPandas(
        read, "doc_id long, none boolean, start long, n_tokens long, ids_crc32 long")
    return rows.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2,
                      folder: str | None = None, **params) -> DataFrame:
    """Write ``docs`` as token files and return what the files say of every document."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, folder, tokenizer, end_id, width, **params), width)
