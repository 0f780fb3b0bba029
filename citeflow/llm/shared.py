"""Helpers that several operators share: written intermediate tables and distributed prefix sums."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and driver and executors are one process (tests) a temporary folder is made
    and set; on a cluster a missing setting raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``compression`` other than the session's.

    This cuts the lineage, survives lost executors, and lets Spark know the table's size when it
    chooses between broadcast and shuffle joins.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, limit: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of about ``limit`` bytes for the jobs run inside, so that buffers of texts stay small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hash64(*cols: Column | str) -> Column:
    """A non-negative 63-bit hash."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 63) - 1))


def worker_memory(name: str) -> dict:
    """A dictionary that lives in the Python worker for the tasks that share its name.

    A worker serves one job after another, so it keeps one such dictionary only: the last asked for.
    """
    held = sys.modules.setdefault("_worker_memory", types.ModuleType("_worker_memory")).__dict__
    if held.get("owner") != name:
        held.update(owner=name, kept={})
    return held["kept"]


#: The column by which numbered rows are joined back.
ROW = "_row_number"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written once with a number of its own for each row, in ROW, whatever its ids are. ``df`` has no
    such column: callers choose its columns, or wrap them."""
    return materialise(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def wrapped(df: DataFrame, name: str = "doc") -> DataFrame:
    """``df`` as one struct column, so that its columns, whatever they are called, clash with nothing."""
    return df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]).alias(name))


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, (MapType, VariantType)):
        return False
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    return all(_hashable(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else True


def row_hash(struct: Column, kind: StructType) -> Column:
    """A number of all fields of a struct column; maps and variants, which Spark does not hash, by their JSON."""
    plain = [struct[f.name] for f in kind.fields if _hashable(f.dataType)]
    other = [F.to_json(F.struct(struct[f.name].alias("v"))) for f in kind.fields if not _hashable(f.dataType)]
    return F.xxhash64(*plain, *other)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def block_offsets(totals: DataFrame, block: str, value: str, fan: int = 4096) -> DataFrame:
    """Exclusive prefix sums of ``value`` over ``block`` (a non-negative long), as column ``before``.

    Two levels, so that no task sees more than ``fan`` blocks or one row per ``fan`` blocks.
    """
    t = totals.select(F.col(block).cast("long").alias(block), F.col(value).cast("long").alias(value))
    t = t.withColumn("_super", F.floor(F.col(block) / fan).cast("long"))
    upper = t.groupBy("_super").agg(F.sum(value).alias("_v"))
    w = Window.orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select("_super", F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_super").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return t.join(upper, "_super").select(block, (F.col("_start") + F.col("_in")).alias("before"))
