"""Tables that ``foreachBatch`` sinks append to and read back.

A sink writes its rows under ``<path>/full=0/batch=<id>``, overwriting what an
earlier attempt of the same batch left there, and reads with an explicit
``before=<id>``: only the folders of earlier batches, which are complete, since
a stream starts a batch after the sink returned for the one before. A batch that is
retried - also after it had written everything - therefore sees what its first
attempt saw and writes the same rows again. ``compact`` writes the whole table as
of a batch under ``full=1``; readers start from the newest such copy and add the
later batches. Nothing is ever deleted, so readers of any age keep working.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def append(df: DataFrame, path: str, batch_id: int, full: bool = False) -> None:
    """Write the rows of a batch, in place of those of an earlier attempt."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/full={int(full)}/batch={batch_id}")


def _all(spark: SparkSession, path: str, schema: T.StructType, before: int | None) -> DataFrame | None:
    parts = T.StructType([*schema.fields, T.StructField("full", T.IntegerType()), T.StructField("batch", T.LongType())])
    try:
        rows = spark.read.schema(parts).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows if before is None else rows.where(F.col("batch") < before)


def read(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """All rows of the batches before ``before`` (default: of all batches)."""
    schema = _schema(schema)
    rows = _all(spark, path, schema, before)
    if rows is None:
        return spark.createDataFrame([], schema)
    base = rows.where("full = 1").agg(F.max("batch")).first()[0]
    own = F.col("full") == 0
    if base is not None:
        own = (own & (F.col("batch") > base)) | ((F.col("full") == 1) & (F.col("batch") == base))
    return rows.where(own).select(*schema.names)


def read_newest(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """The rows of the newest batch before ``before``, for tables whose every batch is whole."""
    schema = _schema(schema)
    rows = _all(spark, path, schema, before)
    newest = None if rows is None else rows.agg(F.max("batch")).first()[0]
    if newest is None:
        return spark.createDataFrame([], schema)
    return rows.where(F.col("batch") == newest).select(*schema.names)


def compact(spark: SparkSession, path: str, schema, batch_id: int) -> None:
    """Write the table up to and with ``batch_id`` as one copy."""
    schema = _schema(schema)
    before = read(spark, path, schema, batch_id)
    own = _all(spark, path, schema, None).where((F.col("full") == 0) & (F.col("batch") == batch_id)).select(*schema.names)
    append(before.unionByName(own), path, batch_id, full=True)
