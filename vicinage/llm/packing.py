"""Best-fit packing of tokenised documents into sequences.

Bulk-synchronous best fit. Pieces longer than half a sequence open one each. The others follow by classes of length, longest
first, in rounds: pieces and gaps are range-sorted together by size, and a sweep downwards gives each piece the
smallest gap that holds it and isn't taken, its successor. A gap is offered once, or as many times as it holds the
longest piece of the class. Every range is swept by itself; what is left of the ranges is matched between them
by rank, so that no gap is claimed twice. Then the gaps shrink and the round repeats with the pieces that found none. New
sequences are opened when the free space can't hold what is left. Pieces, gaps, ranks and placements stay
distributed; the driver sees how many there are of each size (at most `capacity` numbers) and of each range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vicinage.llm.tables import materialize, pieces_of, text_of
from vicinage.llm.tokens import BEYOND_PLAIN, LONGEST_REMEMBERED, chunks_of

REMEMBERED = 400_000
BATCH_ROWS = 1000  # documents whose pieces are handed over together


class IdEncoder:
    """Token ids of whole texts, as little-endian 32-bit numbers, equal to the tokenizers library's.

    Chunks between single spaces are encoded once and remembered. New ones go through tiktoken with the
    same vocabulary, or through tokenizers itself if they hold characters that the two may split differently.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        byte = {self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(b))[0][0]: b for b in range(128)}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte |= {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in specials}
        self.ordinary = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.specials = bool(specials)
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if BEYOND_PLAIN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ordinary(text), "<u4").tobytes()

    def looked_up(self, chunk: str, known: dict[str, bytes], lead: str) -> bytes:
        ids = known.get(chunk)
        if ids is None:
            ids = self.encode(lead + chunk)
            if len(chunk) <= LONGEST_REMEMBERED:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.specials and "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = chunks_of(text)
        head = self.looked_up(chunks[0], self.first, "")
        del chunks[0]
        found = list(map(self.later.get, chunks))
        if None in found:
            found = [self.looked_up(c, self.later, " ") if x is None else x for c, x in zip(chunks, found)]
        return head + b"".join(found)


_ENCODERS: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = IdEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document's ids are those of its text (null: empty) and end_id. A document longer than capacity is
    cut so that all pieces but the first are full. _pid numbers the pieces of all documents; it holds once the
    result is written.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    schema = StructType([rows.schema["doc_id"]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("_pid", "long")
    if keep_ids:
        schema = schema.add("ids", "binary")
    last = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(path).ids, TaskContext.get().partitionId() << 40
        for batch in pieces_of(batches, BATCH_ROWS):
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode(text.as_py()) + last
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    body = ids[4 * start : 4 * (start + length)]
                    row = (doc, piece, start, length, zlib.crc32(body), number, body)
                    for column, value in zip(out, row):
                        column.append(value)
                    number += 1
                    start += length
                    piece += 1
            types = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], schema.fieldNames())

    return rows.mapInArrow(pieces, schema)


#: Pieces and gaps that are swept together, at least: a sweep takes no more ranges than that, or than shuffles have partitions.
RANGE = 50_000


def classes_of(capacity: int) -> list[tuple[int, int]]:
    """(above, up to) of the classes of lengths up to half of capacity, longest first: each reaches down to a quarter, the last to nothing."""
    out, top = [], capacity // 2
    while top > 0:
        low = top // 4 if top > 16 else 0
        out.append((low, top))
        top = low
    return out


def matched_in_order(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a sequence of gaps (true) and pieces go together when each piece takes the last gap before it that isn't taken.

    Positions of the gaps and of their pieces: gaps and pieces nest like brackets, and those of a depth alternate.
    """
    depth = np.cumsum(np.where(gap, 1, -1))
    least = np.minimum.accumulate(np.minimum(depth, 0))
    alone = ~gap & (depth == least) & (depth < np.concatenate([[0], least[:-1]]))  # a piece that finds no gap
    at = np.flatnonzero(~alone)
    level = np.where(gap, depth, depth + 1)[at]
    at = at[np.argsort(level, kind="stable")]
    level = np.where(gap, depth, depth + 1)[at]
    pair = gap[at[:-1]] & ~gap[at[1:]] & (level[:-1] == level[1:]) if len(at) > 1 else np.zeros(0, bool)
    return at[:-1][pair], at[1:][pair]


def swept(pieces: DataFrame, slots: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame, int, dict[int, int]]:
    """One sweep: (_pid, length, bin, slot) of the pieces that found a gap, (_pid, length) of the others, how many found one, and how many of each length didn't.

    pieces: _pid, length. slots: bin, slot, size, gap. Of gaps that are offered alike the smaller one is taken first.
    """
    none = F.lit(0).cast("long")
    both = pieces.select("length", F.lit(1).alias("kind"), none.alias("gap"), F.col("_pid").alias("key"), F.lit(0).alias("slot")).unionByName(slots.select(F.col("size").alias("length"), F.lit(0).alias("kind"), "gap", F.col("bin").alias("key"), "slot"))
    order = [F.desc("length"), F.asc("kind"), F.desc("gap"), F.asc("key"), F.asc("slot")]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        found = pa.Table.from_batches(read)
        part = TaskContext.get().partitionId()
        length, kind, key, slot = (found[c].to_numpy() for c in ("length", "kind", "key", "slot"))
        gaps, taken = matched_in_order(kind == 0)
        free = np.ones(len(kind), bool)
        free[gaps] = free[taken] = False
        rest, open_ = np.flatnonzero(free & (kind == 1)), np.flatnonzero(free & (kind == 0))
        out = [(2, np.arange(len(taken)), key[taken], length[taken], key[gaps], slot[gaps])]
        out.append((1, np.arange(len(rest)), key[rest], length[rest], np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int32)))
        out.append((0, np.arange(len(open_)), np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64), key[open_], slot[open_]))
        for state, rank, pid, size, bin_, n in out:
            for at in range(0, len(rank), 50_000):
                cut = slice(at, at + 50_000)
                m = len(rank[cut])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, state, np.int32)), pa.array(rank[cut]), pa.array(pid[cut]), pa.array(size[cut].astype(np.int64)), pa.array(bin_[cut]), pa.array(n[cut].astype(np.int32))], ["part", "state", "rank", "_pid", "length", "bin", "slot"])

    made = both.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(sweep, "part int, state int, rank long, _pid long, length long, bin long, slot int")
    made = materialize(made, "pack-sweep")
    by_size = made.groupBy("part", "state", F.when((F.col("state") == 1) & F.lit(ranges == 1), F.col("length")).alias("size")).count().collect()
    counts: dict[tuple[int, int], int] = {}  # three a range
    for r in by_size:
        counts[r["part"], r["state"]] = counts.get((r["part"], r["state"]), 0) + r["count"]
    # Between the ranges: those of larger sizes come first, and the last gaps left of them are the smallest.
    stack: list[list[int]] = []
    segments, prefix, base = [], [], 0
    for part in sorted({p for p, _ in counts}):
        wanted, rank = counts.get((part, 1), 0), 0
        while rank < wanted and stack:
            n = min(wanted - rank, stack[-1][1])
            segments.append((part, rank, rank + n, stack[-1][0], stack[-1][1] - n, stack[-1][1], base))
            base += n
            rank += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        prefix.append((part, rank))
        if counts.get((part, 0), 0):
            stack.append([part, counts[part, 0]])
    spark = pieces.sparkSession
    placed = made.where("state = 2").select("_pid", "length", "bin", "slot")
    if segments:
        cuts = spark.createDataFrame(segments, "part int, _from long, _to long, gpart int, _low long, _high long, _base long")
        one = made.where("state = 1").join(F.broadcast(cuts.drop("gpart", "_low", "_high")), "part").where("rank >= _from AND rank < _to")
        two = made.where("state = 0").select(F.col("part").alias("gpart"), "rank", "bin", "slot").join(F.broadcast(cuts.drop("part", "_from", "_to")), "gpart").where("rank >= _low AND rank < _high")
        one = one.select((F.col("_base") + F.col("rank") - F.col("_from")).alias("_match"), "_pid", "length")
        two = two.select((F.col("_base") + F.col("_high") - 1 - F.col("rank")).alias("_match"), "bin", "slot")
        placed = materialize(placed.unionByName(one.join(two, "_match").select("_pid", "length", "bin", "slot")), "pack-placed")
    rest = made.where("state = 1").select("part", "rank", "_pid", "length")
    if prefix:
        rest = rest.join(F.broadcast(spark.createDataFrame(prefix, "part int, _done long")), "part").where("rank >= _done")
    rest, n = rest.select("_pid", "length"), base + sum(n for (_, state), n in counts.items() if state == 2)
    if len(counts) and all(r["size"] is not None for r in by_size if r["state"] == 1) and not segments:
        return placed, rest, n, {r["size"]: r["count"] for r in by_size if r["state"] == 1}
    return placed, rest, n, {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # at most capacity numbers


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """(_pid, bin, offset) of pieces (_pid, length), read from storage, that are shorter than capacity."""
    spark = pieces.sparkSession
    most = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity numbers
    opening = pieces.where(F.col("length") > capacity // 2)
    bins = materialize(opening.select((2 * F.col("_pid")).alias("bin"), (capacity - F.col("length")).alias("gap")), "pack-gaps")
    placed = opening.select("_pid", "length", (2 * F.col("_pid")).alias("bin"), F.lit(0).alias("round"), F.lit(0).alias("slot"))
    opened, round_ = 0, 0
    for low, top in classes_of(capacity):
        left = {n: k for n, k in lengths.items() if low < n <= top}
        todo = pieces.where(F.col("length").between(low + 1, top)).select("_pid", "length")
        stuck = False
        while left:
            number, tokens, longest = sum(left.values()), sum(n * k for n, k in left.items()), max(left)
            gaps = {r["gap"]: r["count"] for r in bins.groupBy("gap").count().collect()}  # at most capacity numbers
            free = sum(g * k for g, k in gaps.items() if g >= min(left))
            new = max(1, tokens // capacity) if stuck else max(0, tokens - free) // capacity
            if new:
                empty_ones = spark.range(opened, opened + new).select((2 * F.col("id") + 1).alias("bin"), F.lit(capacity).cast("long").alias("gap"))
                bins, opened = bins.unionByName(empty_ones), opened + new
                gaps[capacity] = gaps.get(capacity, 0) + new
            # Gaps beyond those that surely hold all pieces aren't offered: the smaller ones come first.
            offered, widest = 0, longest
            for g in sorted(gaps):
                if g >= longest and offered < number:
                    offered, widest = offered + g // longest * gaps[g], g
            times = F.when(F.col("gap") >= longest, F.floor(F.col("gap") / longest)).otherwise(1).cast("int")
            slots = bins.where(F.col("gap").between(min(left), widest)).select("bin", "gap", F.least("gap", F.lit(longest).cast("long")).alias("size"), F.explode(F.sequence(F.lit(0), times - 1)).alias("slot"))
            found, todo, n, left = swept(todo, slots, min(most, -(-(number + offered + sum(gaps.values())) // RANGE)))
            round_ += 1
            if n:
                placed = placed.unionByName(found.select("_pid", "length", "bin", F.lit(round_).alias("round"), "slot"))
                used = found.groupBy("bin").agg(F.sum("length").alias("_used"))
                bins = bins.join(used, "bin", "left").select("bin", (F.col("gap") - F.coalesce("_used", F.lit(0))).alias("gap")).where("gap > 0")
            bins = materialize(bins, "pack-gaps")
            stuck = 5 * n < 2 * number and not new
    before = Window.partitionBy("bin").orderBy("round", "slot", "_pid").rowsBetween(Window.unboundedPreceding, -1)  # at most capacity rows
    return placed.select("_pid", "bin", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")).alias("offset"))


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces, written before, with sequence_id and offset in place of _pid.

    Full pieces are sequences of their own, numbered downwards from -1.
    """
    kept = [f for f in pieces.columns if f != "_pid"]
    found = best_fit(pieces.where(F.col("length") < capacity).select("_pid", "length"), capacity)
    own = pieces.where(F.col("length") == capacity).select(*kept, (-1 - F.col("_pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < capacity).join(found, "_pid").select(*kept, F.col("bin").alias("sequence_id"), "offset")
    return own.unionByName(short)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """All documents in as few sequences as best fit finds, one row for each piece.

    doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset; ids are little-endian 32-bit numbers.
    Null texts are empty and have the end id only. Repeated rows and null ids are packed like others, ids may be of any
    type, other columns aren't read; an empty table gives no rows.
    """
    return place(materialize(token_pieces(docs, path, capacity, keep_ids=keep_ids), "pack-pieces"), capacity)
