"""Writing intermediate tables where all executors can read them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def place(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; on one machine without it, in a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "vicinage-stages")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table where all executors can read it."""
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables are broadcast up to this many bytes, as measured; a larger one meets the rows in a shuffle join.
BROADCAST_BYTES = 32 << 20


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a table that is read from storage: lengths of its texts, bytes and lists (of structures by their fields), eight for any other field, and some for each row."""
    total = F.lit(16)
    for f in df.schema:
        kind = f.dataType
        if kind.typeName() in ("string", "binary"):
            size = F.octet_length(f.name)
        elif kind.typeName() == "array":
            size = 8 * (2 + len(kind.elementType) if kind.elementType.typeName() == "struct" else 1) * F.size(f.name)
        else:
            size = F.lit(8)
        total = total + F.coalesce(size.cast("long"), F.lit(0))
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("n")).first()["n"]


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its measured size is within BROADCAST_BYTES."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df
