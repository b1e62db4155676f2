"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Built-in functions only. The first scan makes three numbers a row; a text is hashed as a whole only if
another row agrees with it on length and prefix hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm.tables import BROADCAST_BYTES, leave_out, materialize, measured_bytes, text_of

#: Characters that the prefix hash covers.
PREFIX = 128


def _hashed(docs: DataFrame, digest_all: bool) -> DataFrame:
    """doc_id, _len, _alive (whether length and prefix hash occur again), text_sha256 and _row of each row, written."""
    rows = docs.select("doc_id", text_of().alias("_text")).select(
        "doc_id", "_text", F.octet_length("_text").alias("_len"), F.xxhash64(F.substring("_text", 1, PREFIX)).alias("_pre")
    )
    keys = materialize(rows.select("_len", "_pre"), "exact-keys")
    lengths = materialize(keys.groupBy("_len").count().where("count > 1").select("_len"), "exact-lengths")
    alive = keys.join(lengths, "_len").groupBy("_len", "_pre").count().where("count > 1")
    alive = materialize(alive.select("_len", "_pre", F.lit(True).alias("_alive")), "exact-prefixes")

    if measured_bytes(alive) <= BROADCAST_BYTES:
        hashed = rows.join(F.broadcast(alive), ["_len", "_pre"], "left")
        needed = F.lit(True) if digest_all else F.col("_alive")
        hashed = hashed.select("doc_id", "_len", "_alive", F.when(needed, F.sha2("_text", 256)).alias("text_sha256"))
    else:  # the digest goes through the shuffle in place of the text
        hashed = rows.select("doc_id", "_len", "_pre", F.sha2("_text", 256).alias("text_sha256"))
        hashed = hashed.join(alive, ["_len", "_pre"], "left").select("doc_id", "_len", "_alive", "text_sha256")
    return materialize(hashed.withColumn("_row", F.monotonically_increasing_id()), "exact-hashed")


def duplicate_groups(docs: DataFrame, *, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of a group the row with the largest doc_id
    stays (null ids are smallest; of rows that repeat id and text exactly one is kept). text_sha256 is
    null for rows whose text never had to be read in full, unless digest_all. Ids may be of any type that
    can be ordered. Columns besides doc_id and text are not looked at. An empty table gives no rows.
    """
    hashed = _hashed(docs, digest_all)
    groups = (
        hashed.where("_alive")
        .groupBy("_len", "text_sha256")
        .agg(F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    groups = materialize(groups, "exact-groups")
    # A group may hold a third of all rows: both sides are plain scans here, so that Spark may split the hot key.
    return hashed.join(groups, ["_len", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("_keep").isNull(), F.col("doc_id")).otherwise(F.col("_keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_keep").isNull() | (F.col("_keep._row") == F.col("_row"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each text, with all their columns.

    Of equal texts the row with the largest doc_id stays, a null id being smallest; of rows that repeat both
    id and text one stays. Rows are told by id and text, so another text of the same id isn't touched, and a row
    whose text nobody else has always stays. Columns may have any names. An empty table stays empty.
    """
    pairs = _hashed(docs, False).where("_alive").groupBy("_len", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_n"))
    pairs = materialize(pairs, "exact-pairs")
    groups = pairs.groupBy("_len", "text_sha256").agg(F.max(F.struct("doc_id")).alias("_keep"), F.sum("_n").alias("_rows"))
    groups = materialize(groups.where("_rows > 1"), "exact-groups")
    told = materialize(pairs.join(groups, ["_len", "text_sha256"]).select("doc_id", "text_sha256", "_n", F.col("doc_id").eqNullSafe(F.col("_keep.doc_id")).alias("_stays")), "exact-told")
    return leave_out(docs, told.where("NOT _stays").select("doc_id", "text_sha256"), told.where("_stays AND _n > 1").select("doc_id", "text_sha256"))
