"""Reading inputs, writing intermediate tables to the folder that all executors share, and taking rows out of a table."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; only those are read from Parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; on a single machine without one, a temporary folder.

    A session with executors on other machines must name the folder: a local one would be lost to them.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "vicinage-stages")
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends here.

    A lost executor then costs no more than the tasks of the current step. Columns that Python or a
    row number produced are fixed from here on, whatever is retried later.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what `materialize` wrote, once nothing will read it again; None is passed over."""
    for table in tables:
        if table is not None:
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(table.written_at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Tables are broadcast up to this many bytes, as measured; a larger one meets the rows in a shuffle join.
BROADCAST_BYTES = 32 << 20


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a table that is read from storage: lengths of its texts and lists, eight for any other field, and some for each row."""
    sizes = []
    for f in df.schema:
        if isinstance(f.dataType, (StringType, BinaryType)):
            sizes.append(F.octet_length(f.name))
        elif f.dataType.typeName() == "array":
            sizes.append(8 * F.size(f.name))
        else:
            sizes.append(F.lit(8))
    total = F.lit(16)
    for s in sizes:
        total = total + F.coalesce(s, F.lit(0))
    return df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0)).alias("n")).first()["n"]


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its measured size is within BROADCAST_BYTES."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in batches of at most `rows` rows, so that what a task makes of them is bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def digest_of(column: str = "text") -> Column:
    """SHA-256 of a text in UTF-8 as lower-case hex; null counts as empty."""
    return F.sha2(text_of(column), 256)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many leading underscores as make it differ from all columns of df, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df by name; names may hold dots."""
    return [F.col(f"`{c}`") for c in df.columns]


def leave_out(docs: DataFrame, lost: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """docs without the rows that `lost` names, and with one row only for each that `repeated` names.

    Both are tables (doc_id, sha), read from storage, that name rows by id, null or not, and SHA-256 of the text:
    other texts of the same id stay. A list of bounded size, as measured, is broadcast and texts stay where
    they are. Columns keep their names and order, whatever they are called.
    """
    sha, key, other = fresh(docs, "_sha", "_lost_id", "_lost_sha")
    named = docs.withColumn(sha, digest_of())
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(other))
    out = named.join(small(lost.toDF(key, other)), same, "left_anti")
    if repeated is not None and not repeated.isEmpty():
        pairs = small(repeated.toDF(key, other))
        out = out.join(pairs, same, "left_anti").unionByName(out.join(pairs, same, "left_semi").dropDuplicates(["doc_id", sha]))
    return out.select(columns_of(docs))


def leave_out_texts(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs without the rows whose text has a SHA-256 among `lost`, a table of one column read from storage."""
    sha, other = fresh(docs, "_sha", "_lost_sha")
    named = docs.withColumn(sha, digest_of())
    return named.join(small(lost.toDF(other)), F.col(sha) == F.col(other), "left_anti").select(columns_of(docs))


def bounded_sample(df: DataFrame, rows: int, key: str, spare: float = 2) -> DataFrame:
    """At most `rows` rows of df, those whose hashed key is smallest.

    Rows are thinned by hash before the sort, so that what tasks send to the driver is bounded as well.
    spare: how many times `rows` the thinning leaves, for rows that are dropped later or unevenly hashed.
    """
    total, wide = df.count(), 1 << 40
    if total > 2 * spare * rows:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(wide)) < int(wide * spare * rows / total))
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(wide)), key).limit(rows)
