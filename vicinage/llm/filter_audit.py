"""Interaction of filters that are applied one after another, by a packed bitmap index.

Each partition packs its rows into NumPy bitsets, one for each filter and label, in which every part of the corpus
owns a run of whole bytes. Survivors of a set of filters are the rows' bits AND NOT those of its filters; a popcount
over a part's run counts them. Counts of all sets are summed over partitions, and every order of the filters
is read off them: what a filter removes depends on the set before it only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vicinage.llm.tables import materialize, small, text_of

#: Filters of whole texts, in the order of their bits; the last one looks at the other rows too.
FILTERS = "ABCDE"
STRETCH = 1 << 20  # bytes whose words are listed at once
HELD = 4096  # parts that a task counts before it passes their sums on

UPPER = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point
SPACES = b" \t\n\v\f\r"


def stretches(data: bytes) -> Iterator[bytes]:
    """The whole of data in stretches that end where a word ends."""
    begin = 0
    while begin < len(data):
        end = begin + STRETCH
        while end < len(data) and data[end] not in SPACES:
            end += 1
        yield data[begin:end]
        begin = end


def text_failures(data: bytes) -> int:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, signs."""
    words, distinct = 0, set()
    for part in stretches(data):
        found = part.split()
        words += len(found)
        distinct.update(found)
    capitals = len(data) - len(data.translate(None, UPPER))
    points = len(data.translate(None, CONTINUED))
    failed = (words < 200, 100 * len(distinct) < 50 * words, 100 * capitals > 2 * points, len(data.translate(None, SIGNS)) < len(data))
    return sum(1 << k for k, f in enumerate(failed) if f)


def failures(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, part (its source; null is empty), failed (bits of FILTERS).

    Null texts count as empty. A row fails E if its text is that of a smaller doc_id, whichever filters either
    passes; a null doc_id is neither smaller nor larger than another. Ids may be of any type that can be ordered.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            failed, digests = np.zeros(len(b), np.int32), []
            for k, text in enumerate(texts):
                data = text.as_py()
                failed[k] = text_failures(data)
                digests.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(failed), pa.array(digests, pa.binary())], ["doc_id", "part", "failed", "sha"])

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    fields = [rows.schema["doc_id"], rows.schema["part"], *StructType.fromDDL("failed int, sha binary").fields]
    found = materialize(rows.mapInArrow(measured, StructType(fields)), "audit-failures")
    groups = found.groupBy("sha").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _first IS NOT NULL").select("sha", "_first")
    # A text may be that of a third of all rows: both sides are plain scans here, so that Spark may split the hot key.
    told = found.join(small(materialize(groups, "audit-copies")), "sha", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    return told.select("doc_id", "part", (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed"))


class Bitmaps:
    """Bitsets of the rows of one batch: every part owns a run of whole bytes in each of them."""

    def __init__(self, part_of: np.ndarray, parts: int):
        sizes = np.bincount(part_of, minlength=parts)
        length = (sizes + 7) // 8
        self.begin = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        self.bits = int(length.sum()) * 8
        order = np.argsort(part_of, kind="stable")
        rank = np.empty(len(part_of), np.int64)
        rank[order] = np.arange(len(part_of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = self.begin[part_of] * 8 + rank

    def packed(self, flags: np.ndarray) -> np.ndarray:
        plane = np.zeros(self.bits, bool)
        plane[self.place] = flags
        return np.packbits(plane)

    def counted(self, bitset: np.ndarray) -> np.ndarray:
        """Set bits of each part."""
        return np.add.reduceat(np.bitwise_count(bitset).astype(np.int64), self.begin)


def survivors(flagged: DataFrame, filters: int, labels: tuple[str, ...]) -> DataFrame:
    """(part, subset, n and one count for each label): rows of each part that no filter of the subset fails, for all subsets of filters.

    flagged: part, failed (bits of the filters), and a boolean column for each label.
    """
    width = 1 + len(labels)
    schema = StructType([StructField("part", flagged.schema["part"].dataType), *StructType.fromDDL("subset int, n long").fields, *[StructField(x, LongType()) for x in labels]])

    def rows_of(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        counts = np.concatenate(list(sums.values()))
        names = [p for p in sums for _ in range(1 << filters)]
        columns = [pa.array(names, pa.string()), pa.array(np.tile(np.arange(1 << filters, dtype=np.int32), len(sums))), *[pa.array(counts[:, k]) for k in range(width)]]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            coded = b.column("part").dictionary_encode()
            names = coded.dictionary.to_pylist()
            failed = b.column("failed").to_numpy()
            maps = Bitmaps(coded.indices.to_numpy(), len(names))
            fails = [maps.packed(failed >> k & 1 == 1) for k in range(filters)]
            label = [maps.packed(b.column(x).to_numpy(zero_copy_only=False)) for x in labels]
            alive = [maps.packed(np.ones(len(b), bool))]
            table = np.zeros((len(names), 1 << filters, width), np.int64)
            for subset in range(1 << filters):
                if subset:
                    last = subset.bit_length() - 1
                    alive.append(alive[subset ^ 1 << last] & ~fails[last])
                table[:, subset, 0] = maps.counted(alive[subset])
                for k, bits in enumerate(label):
                    table[:, subset, 1 + k] = maps.counted(alive[subset] & bits)
            for name, counts in zip(names, table):
                sums[name] = sums[name] + counts if name in sums else counts
            if len(sums) > HELD:
                yield rows_of(sums)
                sums = {}
        if sums:
            yield rows_of(sums)

    counted = flagged.select("part", "failed", *labels).mapInArrow(count, schema)
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", *labels)])


def orders(counts: DataFrame, filters: str, labels: tuple[str, ...]) -> DataFrame:
    """Every order of the filters and step in it, of the counts by subset that survivors gives: for each part

    kept, removed, redundant (fails, but was removed earlier), unique_fails (fails this filter alone), <label>_lost
    and shapley (what the filter removes, summed over all orders).
    """
    columns = ["kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in labels], "shapley"]
    every = list(permutations(range(len(filters))))
    whole = (1 << len(filters)) - 1

    def report(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left = rows.sort_values("subset")[["n", *labels]].to_numpy()
        n, out = left[:, 0], []
        shapley = [0] * len(filters)
        for subset in range(whole + 1):
            size = subset.bit_count()
            for f in range(len(filters)):
                if not subset >> f & 1:
                    shapley[f] += math.factorial(size) * math.factorial(len(filters) - 1 - size) * int(n[subset] - n[subset | 1 << f])
        for order in every:
            name, before = "".join(filters[f] for f in order), 0
            for step, f in enumerate(order):
                after = before | 1 << f
                lost = left[before] - left[after]
                redundant = n[0] - n[1 << f] - lost[0]
                alone = n[whole ^ 1 << f] - n[whole]
                out.append((key[0], name, step + 1, n[after], lost[0], redundant, alone, *lost[1:], shapley[f]))
                before = after
        return pd.DataFrame(out, columns=["part", "filter_order", "step", *columns])

    schema = "part string, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in columns)
    return counts.groupBy("part").applyInPandas(report, schema)  # a part has one row for each subset of filters


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order of the five filters over docs: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, source (null text: empty; null source: the empty part). labels: doc_id, quality, toxic; a document
    that several rows label is good or toxic if one of them says so, others and null ids are neither. Rows
    count one by one, repeated ones too. Other columns aren't read. An empty table gives no rows.
    """
    found = failures(docs)
    marked = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("doc_id IS NOT NULL AND (good OR toxic)")
    told = found.join(small(materialize(marked, "audit-labels")), "doc_id", "left")
    said = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    counts = survivors(told.select("part", "failed", said("good"), said("toxic")), len(FILTERS), ("good", "toxic"))
    return orders(materialize(counts, "audit-counts"), FILTERS, ("good", "toxic"))
