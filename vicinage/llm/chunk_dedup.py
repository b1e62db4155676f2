"""Repeated passages by content-defined chunking with a gear rolling hash.

A text is cut where the hash of the last 16 bytes has some bits clear, so cuts depend on content only
and an insertion moves no cut beyond its neighbourhood. Chunks are deduplicated by a 128-bit digest; runs of
chunks that other documents also have are the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vicinage.llm.tables import columns_of, fresh, materialize, pieces_of, text_of

SPAN = 16  # bytes that the rolling hash covers; the bits looked at come from these
BITS = 4  # clear bits at a cut: a candidate each 16 bytes on average
SHORTEST, LONGEST = 24, 256
#: The shortest passage, in bytes. A run covers a shared passage but for the parts before its first and behind its last
#: cut. Measured by planting passages in documents of the test tables: of those of 51 words (319 bytes) 1.9 % are
#: missed with 64 bytes, 2.3 % with 96, 3.7 % with 128, 12.6 % with 192; of 80 words 1.1 % up to 112.
PASSAGE = 64

#: Texts that are cut at once: a text makes dozens of chunks, which all stand in memory until they are handed over.
CUT_ROWS = 500

#: One 32-bit number for each byte value, from a digest of the value.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], dtype=np.uint32)


def cuts_of(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's UTF-8 bytes, the last being its length. No character is cut."""
    n = len(data)
    if not n:
        return []
    h = GEAR[data]
    reach = 1
    while reach < min(SPAN, n):  # each turn doubles the number of bytes that a hash covers
        wider = h.copy()
        wider[reach:] += h[:-reach] << np.uint32(reach)
        h = wider
        reach *= 2
    open_ = h & np.uint32(((1 << BITS) - 1) << (SPAN - BITS)) == 0
    ends = np.flatnonzero(open_) + 1
    ends = ends[ends < n]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    out, last = [], 0
    for end in [*ends.tolist(), n]:
        while end - last > LONGEST:
            stop = last + LONGEST
            while stop > last + 1 and data[stop] & 0xC0 == 0x80:
                stop -= 1
            out.append(stop)
            last = stop
        if end - last >= SHORTEST or end == n:
            if end > last:
                out.append(end)
            last = end
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """Every chunk of every text: _row, _text (its hash, as xxhash64 gives it), doc_id, chunk, start, end, size, _high, _low.

    start and end are code points, size is bytes, _high and _low the digest. _row tells rows of docs apart, whatever their ids.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    schema = StructType().add("_row", "long").add("_text", "long").add(rows.schema["doc_id"]).add("chunk", "integer").add("start", "integer").add("end", "integer").add("size", "integer").add("_high", "long").add("_low", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        digest = xxhash.xxh3_128_digest
        for batch in pieces_of(batches, CUT_ROWS):
            owners, hashes, docs_, numbers, starts, ends, sizes, digests = [], [], [], [], [], [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                raw = text.as_py().encode()
                data = np.frombuffer(raw, np.uint8)
                cuts = cuts_of(data)
                if cuts:
                    begins = [0, *cuts[:-1]]
                    digests += [digest(raw[a:b]) for a, b in zip(begins, cuts)]
                    at = np.array([0, *cuts])
                    if not raw.isascii():
                        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
                    else:
                        points = at
                    n = len(cuts)
                    owners.append(np.full(n, row))
                    hashes.append(np.full(n, xxhash.xxh64_intdigest(raw, 42), np.uint64).view(np.int64))
                    docs_ += [doc] * n
                    numbers.append(np.arange(n, dtype=np.int32))
                    starts.append(points[:-1])
                    ends.append(points[1:])
                    sizes.append(np.diff(at).astype(np.int32))
                row += 1
            pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            columns = [joined(owners, np.int64), joined(hashes, np.int64), pa.array(docs_, batch.schema.field("doc_id").type), joined(numbers, np.int32), joined(starts, np.int32), joined(ends, np.int32), joined(sizes, np.int32), pairs[:, 0].copy(), pairs[:, 1].copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema.fieldNames())

    return rows.mapInArrow(cut, schema)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Runs of chunks that more than one document has: doc_id, start, end, n_chunks, n_bytes, first_doc_id, n_copies, kept, text_hash.

    start and end are code points of the row's text, and text_hash is its xxhash64. first_doc_id is the smallest id that has the run's
    first chunk and n_copies the most copies that one of its chunks has; kept is true where every chunk of the run has
    its first occurrence (by id; rows with a null id count as one document, the first). Runs of under `passage` bytes, such as a licence line, aren't
    listed. Null and empty texts have no chunks; rows that repeat an id are one document; ids may be of any type that
    can be ordered; an empty table gives no rows.
    """
    made = chunks(docs)
    whole = made.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    # Ids that aren't numbers are told apart by a 64-bit hash here, and compared themselves below.
    number = F.col("doc_id").cast("long") if whole else F.xxhash64("doc_id")
    made = materialize(made, "chunk-rows").withColumn("_id", F.when(F.col("doc_id").isNull(), F.lit(-(2**63))).otherwise(number))
    # Half a digest leaves few chunks by mistake and makes the two large shuffles smaller; the rest is compared below.
    # Every small side is written first: the joins read two plain tables, so that Spark may split a digest with many rows.
    often = made.groupBy("_low").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b")).where("_a <> _b").select("_low")
    often = materialize(often, "chunk-often")
    hits = materialize(made.drop("_text").join(often, "_low"), "chunk-hits")
    shared = hits.groupBy("_high", "_low").agg(F.min(F.struct("doc_id", "_row")).alias("_first"), F.min("_id").alias("_a"), F.max("_id").alias("_b"), F.count(F.lit(1)).alias("_n"))
    shared = materialize(shared.where("_a <> _b").select("_high", "_low", "_first", "_n"), "chunk-shared")
    hits = materialize(hits.join(shared, ["_high", "_low"]).select("_row", "doc_id", "chunk", "start", "end", "size", "_n", "_first"), "chunk-repeats")
    order = Window.partitionBy("_row").orderBy("chunk")
    runs = hits.withColumn("_run", F.col("chunk") - F.row_number().over(order))
    found = runs.groupBy("_row", "_run").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("size").alias("n_bytes"),
        F.min_by(F.col("_first.doc_id"), F.col("chunk")).alias("first_doc_id"),
        F.max("_n").alias("n_copies"),
        F.min(F.col("_first._row") == F.col("_row")).alias("kept"),
    )
    texts = made.where("chunk = 0").select("_row", F.col("_text").alias("text_hash"))
    return found.where(F.col("n_bytes") >= passage).join(texts, "_row").drop("_row", "_run")


def cut_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the passages that aren't kept cut out of their texts.

    Rows are told by id, null or not, and the hash of their text, so another text of the same id is left as it is; of rows that
    repeat both, all are cut alike, and keep what one of them keeps. Other rows, null texts and all other columns are unchanged.
    """
    key, other, spans, hash_ = fresh(docs, "_lost_id", "_lost_hash", "_spans", "_hash")
    lost = passages.groupBy("doc_id", "text_hash", "start", "end").agg(F.max("kept").alias("kept")).where("NOT kept")
    lost = lost.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(other)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans))
    lost = materialize(lost, "chunk-cuts")

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, cuts):
            if cuts is None or text is None:
                return text
            parts, at = [], 0
            for c in cuts:
                parts.append(text[at : c["start"]])
                at = max(at, c["end"])
            return "".join([*parts, text[at:]])

        return pd.Series([one(t, c) for t, c in zip(texts, spans)])

    out = docs.withColumn(hash_, F.xxhash64("text")).join(lost, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(hash_) == F.col(other)), "left")
    return out.withColumn("text", without(F.col("text"), F.col(spans))).select(columns_of(docs))
