"""Hard negatives by distributed radix selection.

Every anchor and positive opens a window of scores, in which the first k rows of other labels are wanted. A pass over
all rows makes a histogram of one digit of the scores of each window; it tells in which bucket the k-th score is
and how many of the bucket are wanted. The next pass looks into that bucket, digit by digit, until the score is known, and on
through the ids where more rows have that very score than are wanted. Then the rows up to there are gathered, and no others.

Rows are packed in blocks once, anchors in blocks with the state of their windows; a pass joins each block of rows
with each block of anchors, so a task holds two blocks whatever the data, and only counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.llm.tables import materialize, small

SCALE = 256  # a component x becomes floor(SCALE * x)
ROWS, ANCHORS = 1024, 256  # of a block of rows; of a block of anchors, on average
DIGIT = 8  # bits
HELD = 16  # anchor blocks whose counts a task holds before it passes them on

KINDS = (np.int16, np.int32, np.int64)
#: A window: place of its anchor in the block, id and score of the positive, ends of the scores, the digits known so far of the wanted place and how many are wanted from there on;
#: then the same for the ids of rows with the score found. known is -1 in a window that holds no more rows than are wanted.
STATE = np.dtype([(n, np.int64) for n in ("anchor", "positive", "score", "low", "high", "known", "want", "id_known", "tied")])


def packed(points: DataFrame, anchor: Column) -> DataFrame:
    """Blocks of up to ROWS rows (block, n, dim, kind, ids, labels, anchors, codes) of the rows of vec_id, embedding, label that take part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 31
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.slice(at, ROWS)
                sizes = np.diff(b.column("embedding").offsets.to_numpy())
                values = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    values = np.floor(SCALE * values)
                if len(values) and np.abs(values).max() >= 2.0**62:
                    raise ValueError("a component's integer form is beyond 2^62: its scores don't fit a long")
                dim = int(sizes.max(initial=0))
                codes = np.zeros((len(b), dim), np.int64)
                codes[np.arange(dim)[None, :] < sizes[:, None]] = values.astype(np.int64)
                top = np.abs(codes).max(initial=0)
                kind = next(k for k, t in enumerate(KINDS) if top <= np.iinfo(t).max)
                column = lambda name, t: b.column(name).to_numpy(zero_copy_only=False).astype(t).tobytes()
                row = {"block": number, "n": len(b), "dim": dim, "kind": kind, "ids": column("vec_id", np.int64), "labels": column("label", np.int64), "anchors": column("anchor", bool), "codes": codes.astype(KINDS[kind]).tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=form)
                number += 1

    form = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("anchors", pa.binary()), ("codes", pa.binary())])
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = points.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return rows.mapInArrow(pack, "block long, n int, dim int, kind int, ids binary, labels binary, anchors binary, codes binary")


class Block:
    """Rows of one block as arrays: row numbers, ids, labels, codes and the largest code."""

    def __init__(self, r: dict):
        self.ids, self.labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
        self.codes = np.frombuffer(r["codes"], KINDS[r["kind"]]).reshape(r["n"], r["dim"])
        self.top = int(np.abs(self.codes.astype(np.int64)).max(initial=0))
        self.rows = np.frombuffer(r["rows"], np.int64) if "rows" in r else r["block"] * ROWS + np.arange(r["n"])


def scores(a: Block, b: Block) -> np.ndarray:
    """Inner products of all rows of two blocks, exact; what one vector is longer than another counts as zero."""
    dim = min(a.codes.shape[1], b.codes.shape[1])
    bound = a.top * b.top * max(1, dim)
    if bound >= 2**63:
        raise ValueError("a score doesn't fit a long")
    kind = np.float64 if bound < 2**53 else np.int64  # exact either way; the first is a matter of speed
    return (a.codes[:, :dim].astype(kind) @ b.codes[:, :dim].T.astype(kind)).astype(np.int64)


def anchor_blocks(blocks: DataFrame) -> DataFrame:
    """The anchors of all blocks, dealt anew to blocks of about ANCHORS: search, and the columns of a block with the rows' numbers."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r)
                for k in np.flatnonzero(np.frombuffer(r["anchors"], bool)):
                    row = {"row": int(b.rows[k]), "id": int(b.ids[k]), "label": int(b.labels[k]), "dim": r["dim"], "kind": r["kind"], "codes": b.codes[k].tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema=form)

    form = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("kind", pa.int32()), ("codes", pa.binary())])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        dim, kind = int(rows["dim"].max()), int(rows["kind"].max())
        codes = np.zeros((len(rows), dim), KINDS[kind])
        for k, (c, own) in enumerate(zip(rows["codes"], rows["kind"])):
            values = np.frombuffer(c, KINDS[own])
            codes[k, : len(values)] = values
        column = lambda name: rows[name].to_numpy(np.int64).tobytes()
        return pd.DataFrame([[key[0], len(rows), dim, kind, column("row"), column("id"), column("label"), codes.tobytes()]])

    picked = materialize(blocks.mapInArrow(pick, "row long, id long, label long, dim int, kind int, codes binary"), "negatives-anchors")
    count = max(1, -(-picked.count() // ANCHORS))
    dealt = picked.withColumn("search", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
    return dealt.groupBy("search").applyInPandas(pack, "search int, n int, dim int, kind int, rows binary, ids binary, labels binary, codes binary")


Kernel = Callable[[Block, Block, np.ndarray], Iterator[pd.DataFrame]]


def over_blocks(blocks: DataFrame, anchors: DataFrame, searches: int, schema: str, start: Callable[[], object], visit, finish) -> DataFrame:
    """visit(held, search, anchors, rows, windows) for every block of rows with every block of anchors; what a task holds is passed on by finish(held).

    Each task makes `held` by start(). visit and finish give data frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = start()
        for batch in batches:
            for r in batch.to_pylist():
                one = Block({k[2:]: v for k, v in r.items() if k.startswith("a_")})
                windows = np.frombuffer(r["state"], STATE) if r.get("state") is not None else np.zeros(0, STATE)
                for frame in visit(held, r["search"], one, Block(r), windows):
                    yield pa.RecordBatch.from_pandas(frame, preserve_index=False)
        for frame in finish(held):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    named = anchors.select("search", *[F.col(c).alias(f"a_{c}") for c in ("n", "dim", "kind", "rows", "ids", "labels", "codes")], *(["state"] if "state" in anchors.columns else []))
    each = blocks.drop("anchors").withColumn("search", F.explode(F.sequence(F.lit(0), F.lit(searches - 1))))
    return each.join(small(named), "search").mapInArrow(run, schema)


def first_positives(blocks: DataFrame, anchors: DataFrame, searches: int, positives: int) -> DataFrame:
    """(search, anchor, rank, positive, score): of each anchor the first other rows of its label; higher scores first, ties by smaller id."""

    def visit(held, search, a, b, windows):
        s = scores(a, b)
        i, j = np.nonzero((a.labels[:, None] == b.labels[None, :]) & (a.rows[:, None] != b.rows[None, :]))
        order = np.lexsort((b.rows[j], b.ids[j], -s[i, j], i))
        i, j = i[order], j[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < positives
        i, j = i[best], j[best]
        yield pd.DataFrame({"search": np.full(len(i), search, np.int32), "anchor": i, "positive": b.ids[j], "row": b.rows[j], "score": s[i, j]})

    found = over_blocks(blocks, anchors, searches, "search int, anchor long, positive long, row long, score long", lambda: None, visit, lambda held: ())
    rank = F.row_number().over(Window.partitionBy("search", "anchor").orderBy(F.desc("score"), "positive", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= positives)


def opened(anchors: DataFrame, positives: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """anchors with the state of their windows: negative scores of low to high hundredths of the positive's."""

    def states(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["anchor", "rank"])
        state = np.zeros(len(rows), STATE)
        for name in ("anchor", "positive", "score"):
            state[name] = rows[name].to_numpy(np.int64)
        ends = [(-(-low * int(p) // 100), high * int(p) // 100) for p in rows["score"]]
        state["low"], state["high"], state["want"] = [e[0] for e in ends], [e[1] for e in ends], k
        return pd.DataFrame([[key[0], state[state["low"] <= state["high"]].tobytes()]])

    made = positives.groupBy("search").applyInPandas(states, "search int, state binary")  # an anchor has a bounded number of positives
    return anchors.join(made, "search")


def looked_at(a: Block, b: Block, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window and row: how far the score is below the window's high end, and whether the row is of another label and inside."""
    s = scores(a, b)[windows["anchor"]]
    inside = (s >= windows["low"][:, None]) & (s <= windows["high"][:, None]) & (a.labels[windows["anchor"]][:, None] != b.labels[None, :])
    return np.where(inside, windows["high"][:, None] - s, 0), inside


def histograms(blocks: DataFrame, anchors: DataFrame, searches: int, shift: int, ids_from: int | None) -> DataFrame:
    """(search, window, digit, n): rows of each window's bucket by the digit above `shift` bits of their score, or with ids_from of their id."""

    def visit(held, search, a, b, windows):
        below, wanted = looked_at(a, b, windows)
        if ids_from is None:
            keys, known = below, windows["known"]
        else:
            wanted &= below == windows["known"][:, None]
            keys, known = np.broadcast_to(b.ids.astype(np.uint64) - np.uint64(ids_from & (2**64 - 1)), below.shape), windows["id_known"].astype(np.uint64)
        kind = keys.dtype.type
        if shift + DIGIT < 64:
            wanted &= keys >> kind(shift + DIGIT) == known[:, None]
        if ids_from is not None:
            wanted &= (windows["tied"] > 0)[:, None]
        w, r = np.nonzero(wanted)
        digit = (keys[w, r] >> kind(shift)).astype(np.int64) & ((1 << DIGIT) - 1)
        if search not in held:
            held[search] = np.zeros(len(windows) << DIGIT, np.int64)
        held[search] += np.bincount((w << DIGIT) + digit, minlength=len(windows) << DIGIT)
        if len(held) > HELD:
            yield from finish(held)
            held.clear()

    def finish(held):
        for search, counts in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"search": np.full(len(at), search, np.int32), "window": (at >> DIGIT).astype(np.int32), "digit": (at & ((1 << DIGIT) - 1)).astype(np.int32), "n": counts[at]})

    counted = over_blocks(blocks, anchors, searches, "search int, window int, digit int, n long", dict, visit, finish)
    return counted.groupBy("search", "window", "digit").agg(F.sum("n").alias("n"))


def refined(anchors: DataFrame, counts: DataFrame, first: bool, last: bool, ids: bool) -> DataFrame:
    """anchors with the state of their windows one digit further: the digit at which the wanted place is reached, and how many are wanted of its bucket.

    A block of anchors has at most one count for each of its windows and digits.
    """

    def step(state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return state
        windows = np.frombuffer(state["state"].iloc[0], STATE).copy()
        table = np.zeros((len(windows), 1 << DIGIT), np.int64)
        table[found["window"].to_numpy(np.int64), found["digit"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        upto = table.cumsum(1)
        active = windows["tied"] > 0 if ids else windows["known"] >= 0
        reached = upto >= windows["want"][:, None]
        digit = reached.argmax(1)
        at = np.arange(len(windows))
        inside = table[at, digit]
        before = upto[at, digit] - inside
        hit = active & reached.any(1)
        name = "id_known" if ids else "known"
        windows[name] = np.where(hit, (windows[name] << DIGIT) | digit, windows[name])
        windows["want"] = np.where(hit, windows["want"] - before, windows["want"])
        if first and not ids:
            windows["known"] = np.where(reached.any(1), windows["known"], -1)
        if last and not ids:
            windows["tied"] = np.where(hit & (inside > windows["want"]), inside, 0)
        return state.assign(state=[windows.tobytes()])

    made = anchors.select("search", "state").groupBy("search").cogroup(counts.groupBy("search")).applyInPandas(step, "search int, state binary")
    return anchors.drop("state").join(made, "search")


def gathered(blocks: DataFrame, anchors: DataFrame, searches: int, ids_from: int, k: int) -> DataFrame:
    """The rows up to the place found in each window; of rows that repeat the last id a block gives no more than k."""

    def visit(held, search, a, b, windows):
        below, wanted = looked_at(a, b, windows)
        known = windows["known"][:, None]
        wanted &= (known < 0) | (below <= known)
        keys = b.ids.astype(np.uint64) - np.uint64(ids_from & (2**64 - 1))
        wanted &= ~((windows["tied"] > 0)[:, None] & (below == known) & (keys[None, :] > windows["id_known"].astype(np.uint64)[:, None]))
        w, r = np.nonzero(wanted)
        order = np.lexsort((b.rows[r], b.ids[r], below[w, r], w))
        w, r = w[order], r[order]
        best = np.arange(len(w)) - np.searchsorted(w, w) < k
        w, r = w[best], r[best]
        of = windows[w]
        yield pd.DataFrame({"anchor_row": a.rows[of["anchor"]], "window": w, "anchor_id": a.ids[of["anchor"]], "positive_id": of["positive"], "negative_id": b.ids[r], "row": b.rows[r], "positive_score": of["score"], "negative_score": of["high"] - below[w, r]})

    return over_blocks(blocks, anchors, searches, "anchor_row long, window long, anchor_id long, positive_id long, negative_id long, row long, positive_score long, negative_score long", lambda: None, visit, lambda held: ())


def mine(points: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of points (vec_id, embedding, label).

    anchor tells which rows are anchors. A score is the inner product of floor(256 * x); an anchor's positives are its
    first other rows of its label, and for each of them the first rows of other labels whose score is between low and high hundredths
    of the positive's are returned, all if there are fewer. Higher scores come first, ties by smaller vec_id.

    Rows with a null vec_id, label, vector or component, or a component that isn't finite, take no part. Components that
    a shorter vector lacks count as zero. Every row stands for itself: one that repeats a vec_id is another
    row, and a negative of its own. A positive with a negative score has no negatives. Scores beyond a long are an error. An
    empty table gives no rows. Other columns aren't read.
    """
    blocks = materialize(packed(points, anchor), "negatives-blocks")
    anchors = materialize(anchor_blocks(blocks), "negatives-searches")
    searches = max(1, anchors.agg(F.max("search")).first()[0] or 0) + 1
    chosen = first_positives(blocks, anchors, searches, positives)
    state = materialize(opened(anchors, chosen, low, high, negatives), "negatives-windows")

    def bits(column: Callable[[np.ndarray], int]) -> int:
        """The largest of a number of each block of anchors."""

        def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": pa.array([column(np.frombuffer(s.as_py(), STATE)) for s in b.column("state")], pa.int64())})

        return state.select("state").mapInArrow(largest, "n long").agg(F.max("n")).first()[0] or 0

    widest = bits(lambda w: int((w["high"] - w["low"]).max(initial=0)).bit_length())
    digits = max(1, -(-widest // DIGIT))
    for d in range(digits):
        counts = histograms(blocks, state, searches, (digits - 1 - d) * DIGIT, None)
        state = materialize(refined(state, counts, d == 0, d == digits - 1, False), "negatives-windows")
    least = 0
    if bits(lambda w: int((w["tied"] > 0).any())):
        ends = points.agg(F.min("vec_id").cast("long").alias("a"), F.max("vec_id").cast("long").alias("b")).first()
        least = ends["a"]
        digits = max(1, -(-(ends["b"] - least).bit_length() // DIGIT))
        for d in range(digits):
            counts = histograms(blocks, state, searches, (digits - 1 - d) * DIGIT, least)
            state = materialize(refined(state, counts, False, False, True), "negatives-windows")
    found = gathered(blocks, state, searches, least, negatives)
    rank = F.row_number().over(Window.partitionBy("anchor_row", "window").orderBy(F.desc("negative_score"), "negative_id", "row"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
