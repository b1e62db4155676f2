"""Readers and writers of vector files. Binary files are read whole on the executors, one task a file or more."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def _decoded(spark: SparkSession, path: str, decode, kind: str = "float") -> DataFrame:
    """id and vec of all files of a path. Ids are places, counted on from file to file in the order of their names."""
    files = spark.read.format("binaryFile").load(path)
    dtype = np.float64 if kind == "double" else np.float32

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "n": [len(decode(bytes(c))) for c in frame["content"]]})

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content, base in zip(frame["content"], frame["_base"]):
                x = decode(bytes(content))
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096].astype(dtype)
                    yield pd.DataFrame({"id": np.arange(base + at, base + at + len(part)), "vec": list(part)})

    schema = f"id long, vec array<{kind}>"
    names = files.select("path").limit(2).collect()
    if len(names) < 2:
        return files.select("content", F.lit(0).cast("long").alias("_base")).mapInPandas(rows, schema)
    counted = files.select("path", "content").mapInPandas(sizes, "path string, n long")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    base = counted.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return files.select("path", "content").join(base, "path").select("content", "_base").mapInPandas(rows, schema)


def read_fvecs(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """id (place in the file) and vec of records of a 32-bit length and that many 32-bit floats, little-endian."""

    def decode(raw: bytes) -> np.ndarray:
        if not raw:
            return np.zeros((0, 0), np.float32)
        d = int(np.frombuffer(raw, "<i4", 1)[0])
        if d <= 0 or len(raw) % (4 * (d + 1)):
            raise ValueError("not a file of equal fvecs records")
        x = np.frombuffer(raw, "<f4").reshape(-1, d + 1)
        if (np.ascontiguousarray(x[:, 0]).view("<i4") != d).any():
            raise ValueError("records of different lengths")
        return x[:, 1:]

    out = _decoded(spark, path, decode)
    return out if ids is None else out.join(ids.select("id"), "id", "left_semi")


def read_raw(spark: SparkSession, path: str, dimension: int, kind: str = "f4") -> DataFrame:
    """id and vec of little-endian numbers (f4 or f8) without a header."""

    def decode(raw: bytes) -> np.ndarray:
        x = np.frombuffer(raw, f"<{kind}")
        if len(x) % dimension:
            raise ValueError("the file isn't a whole number of vectors")
        return x.reshape(-1, dimension)

    return _decoded(spark, path, decode, "double" if kind == "f8" else "float")


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    """id and vec of the images of an idx file, gzipped or not: unsigned bytes, flattened."""

    def decode(raw: bytes) -> np.ndarray:
        raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        magic, n, h, w = np.frombuffer(raw, ">i4", 4)
        if magic != 2051:
            raise ValueError("not an idx image file")
        return np.frombuffer(raw, np.uint8, n * h * w, 16).reshape(n, h * w)

    return _decoded(spark, path, decode)


def read_npy(spark: SparkSession, path: str, dimension: int | None = None, kind: str = "float") -> DataFrame:
    """id and vec of a two-dimensional npy array of floats; another dimension than the one named is an error. kind is float, or double to keep float64."""
    import io

    def decode(raw: bytes) -> np.ndarray:
        x = np.load(io.BytesIO(raw), allow_pickle=False)
        if x.ndim != 2 or x.dtype.kind != "f" or dimension not in (None, x.shape[1]):
            raise ValueError(f"a float matrix is asked for, found {x.dtype} {x.shape}")
        return x

    return _decoded(spark, path, decode, kind)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """vec of each line of a file of comma-separated numbers without header; ids are unique, not dense."""
    values = F.transform(F.split("value", ","), lambda x: x.cast("float"))
    return spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("id"), values.alias("vec"))


def read_metric_text(spark: SparkSession, path: str) -> DataFrame:
    """line, vec, word of a text file whose first line is `dimension rows metric`: numbers, or words for metric 6.

    The first line is known by its offset, so files are read by any number of tasks.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    head = lines.orderBy("line").limit(1).collect()
    if not head:
        return lines.select("line", F.lit(None).cast("array<float>").alias("vec"), F.lit(None).cast("string").alias("word"))
    metric = int(head[0]["value"].split()[2])
    body = lines.where((F.col("line") != head[0]["line"]) & (F.trim("value") != ""))
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("float"))
    return body.select("line", (F.lit(None).cast("array<float>") if metric == 6 else numbers).alias("vec"), (F.trim("value") if metric == 6 else F.lit(None).cast("string")).alias("word"))


def read_query_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a query file: a count, then one id a line."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where("trim(value) <> ''")
    first = lines.agg(F.min("line")).first()[0]
    return lines.where(F.col("line") != first).select(F.trim("value").cast("long").alias("id")) if first is not None else lines.select(F.lit(0).cast("long").alias("id")).where("false")


def read_update_log(spark: SparkSession, path: str) -> DataFrame:
    """seq, op, id of an update file: a count, then `flag id` lines; 0 inserts, 1 deletes, others query."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()).where("trim(value) <> ''")
    first = lines.agg(F.min("seq")).first()[0]
    fields = F.split(F.trim("value"), r"\s+")
    op = F.when(fields[0] == "0", "insert").when(fields[0] == "1", "delete").otherwise("query")
    return lines.where(F.col("seq") != (-1 if first is None else first)).select("seq", op.alias("op"), fields[1].cast("long").alias("id"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of a (gzipped) CSV edge list without header."""
    return spark.read.schema("src long, dst long").csv(path)


def write_pairs(pairs: DataFrame, path: str, n: int | None = None) -> None:
    """Pairs in order as Parquet, with id = i * n + j if n is given. An existing path is an error."""
    out = pairs if n is None else pairs.withColumn("id", F.col("i") * n + F.col("j"))
    out.orderBy("i", "j").write.mode("errorifexists").parquet(path)


def write_text(rows: DataFrame, path: str) -> None:
    """Neighbours or counts as CSV with a header. An existing path is an error."""
    rows.write.mode("errorifexists").csv(path, header=True)
