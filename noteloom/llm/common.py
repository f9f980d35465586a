"""Shared helpers: input table, lineage cuts in the shared folder, null handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


_held: dict[object, object] = {}


def held[T](key: object, make: Callable[[], T]) -> T:
    """What a worker process has made under the key; it holds one such thing for further tasks."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drops what this worker process still holds of another operator, at the beginning of tasks that need the memory."""
    _held.clear()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a temporary one only where the setting is absent and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Small results: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Larger results: a Parquet table in the shared folder, so lost executors recompute nothing upstream."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noteloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(*columns: Column) -> Column:
    """128 bits of the columns' values and of which of them are null: rows of equal keys are equal."""
    own = [x for c in columns for x in (c.isNull(), c)]
    part = lambda *lead: F.lpad(F.hex(F.xxhash64(*lead, *own)), 16, "0")
    return F.unhex(F.concat(part(), part(F.lit("row"))))


def quoted(name: str) -> str:
    """A column's name as a reference to it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns])


def hashable(column: Column, kind: DataType) -> Column:
    """The column itself, or its JSON where its type has maps or variants in it, which Spark doesn't hash."""
    text = kind.simpleString()
    return F.to_json(F.struct(column.alias("v"))) if "map<" in text or "variant" in text else column
