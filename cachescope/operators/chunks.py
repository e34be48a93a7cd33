"""Text of streamed responses that come as chunks of bytes.

A chunk is one read of a stream (``request, number, data``); lines and characters may be cut
anywhere between two chunks. No body is put together: a chunk's whole lines are parsed where
the chunk is, and only the pieces before its first and after its last line break are joined
with those of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_text import lines_text

#: Bytes of one read of a response.
READ_BYTES = 1024
#: Chunks of a request that are ordered together.
BLOCK_CHUNKS = 4096

_FIRST = -(1 << 63)  # the line that begins with the body


def _utf8(piece: Column) -> Column:
    """Bytes held one to a character, as the text that they spell; bad bytes become U+FFFD."""
    return F.make_valid_utf8(F.encode(piece, "ISO-8859-1").cast("string"))


def chunked(df: DataFrame, body: str, *, size: int = READ_BYTES) -> DataFrame:
    """``df`` with ``number, data`` in place of ``body``: a row for every ``size`` bytes of it, one if it is empty."""
    raw = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rest = [c for c in df.columns if c != body]
    last = F.expr(f"greatest(octet_length(_raw) - 1, 0) div {int(size)}")
    return (df.select(*rest, raw.alias("_raw")).select(*rest, "_raw", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("number"))
            .select(*rest, "number", F.substring("_raw", (F.col("number") * size + 1).cast("int"), F.lit(int(size))).alias("data")))


def stream_text(chunks: DataFrame, *, keys: tuple[str, ...] = ("request_id",), number: str = "number", data: str = "data",
                block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """``keys, text``: what :func:`sse_text` gives for the chunks of a request one after another.

    Chunks are ordered by ``number``, which needs no beginning and may have holes; of chunks of
    one number the one with the least bytes counts, so a repeated delivery changes nothing. Null
    data is empty; a request of which no line holds text has the text ''; requests with a null
    key are one request. Chunks without a number are left out.

    To which line a piece belongs is decided by the last chunk before it that holds a line
    break: a running maximum, taken in blocks of ``block_chunks`` chunks and over the blocks of
    a request, so no task orders a long response.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    n = F.col(number).cast("bigint")
    rows = chunks.where(n.isNotNull()).select(
        *[F.col(k).alias(a) for k, a in zip(keys, ks)], n.alias("_n"), F.expr(f"floor(`{number}` / {int(block_chunks)})").alias("_b"),
        F.decode(F.coalesce(F.col(data), F.lit(b"")), "ISO-8859-1").alias("_d"))
    broken = F.max(F.when(F.instr("_d", "\n") > 0, F.col("_n")))
    earlier = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*ks, "_b").agg(broken.alias("_m")).select(
        *[F.col(k).alias(f"{k}r") for k in ks], F.col("_b").alias("_br"), F.max("_m").over(earlier).alias("_before"))

    order = Window.partitionBy(*ks, "_b").orderBy("_n", "_d")
    once = rows.withColumn("_same", F.lag("_n").over(order)).where("_same is null or _same < _n")
    cut = once.withColumn("_m", broken.over(order.rowsBetween(Window.unboundedPreceding, -1)))
    same = (F.col("_b") == F.col("_br"))
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}r"))
    placed = cut.join(blocks, same).select(
        *ks, "_n", F.coalesce("_m", "_before", F.lit(_FIRST)).alias("_line"), F.split("_d", "\n", -1).alias("_l"))
    # of each chunk: its whole lines, the piece that ends a line begun before, the piece that begins one
    last = F.size("_l") - 1
    kinds = F.array(
        F.when(last > 1, F.struct(F.col("_n").alias("line"), F.lit(0).alias("at"), lines_text(
            F.transform(F.slice("_l", F.lit(2), F.greatest(last - 1, F.lit(0))), _utf8)).alias("s"))),
        F.struct(F.col("_line").alias("line"), F.lit(1).alias("at"), F.col("_l")[0].alias("s")),
        F.when(last > 0, F.struct(F.col("_n").alias("line"), F.lit(1).alias("at"), F.element_at("_l", -1).alias("s"))))
    pieces = placed.select(*ks, "_n", F.explode(F.array_compact(kinds)).alias("p")).select(*ks, "_n", "p.*")
    # a line is as long as its pieces together; a chunk's whole lines are a group of one row
    joined = pieces.groupBy(*ks, "line", "at").agg(F.array_sort(F.collect_list(F.struct("_n", "s"))).alias("c"))
    whole = F.array_join(F.transform("c", lambda x: x["s"]), "")
    texts = joined.select(*ks, "line", "at", F.when(F.col("at") == 0, whole).otherwise(
        lines_text(F.array(_utf8(whole)))).alias("s"))
    said = F.array_sort(F.collect_list(F.when(F.col("s") != "", F.struct("line", "at", "s"))))
    return texts.groupBy(*ks).agg(said.alias("t")).select(
        *[F.col(a).alias(k) for k, a in zip(keys, ks)], F.array_join(F.transform("t", lambda x: x["s"]), "").alias("text"))
