"""Benchmark decontamination with SimHash windows. Built-in functions only.

Every window of a document is fingerprinted, whatever it holds: windows have an item's number of words, rounded
down to a multiple of four so that one of the item's own phases falls on the grid of their starts. A fingerprint has 63
bits, each the majority of a bit of the window's word hashes. Fingerprints are looked up by four blocks of 16
bits (the last has 15); items stand in the index under every block value within two bits of theirs, so that all
fingerprints within 11 bits are found. What is found is verified exactly: bags of five-word shingles, each counting as
often as it occurs, of item-sized windows at every start near by.

Bits are counted in lanes of eight bits, seven to a long: nine longs hold the counts of all 63. Running totals of
the longs over a text's words are kept at every fourth word; a window's counts are the difference of two, since
no lane of it overflows (windows have 240 words at most). Totals stay within a long for TOTALLED words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.llm.tables import leave_out_texts, materialize, small, text_of

SHINGLE = 5
SIMILARITY = 0.75
#: Words from one window's start to the next, and the step of window sizes.
GRID = 4
#: Words of the largest windows; longer items are looked up by pieces of this size.
LARGEST = 240
#: Items of fewer words are looked up by single shingles at every start: the SimHash of one shingle is its hash.
SHORTEST = 11
#: Blocks of 16 bits of a fingerprint, and how many bits of a block may differ.
BLOCKS, NEAR = 4, 2
#: By the pigeonhole principle no fingerprint within this distance is missed.
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Words of text that are fingerprinted together, and for how many totals fit a long.
TOGETHER, TOTALLED = 200_000, 32_000
#: Bytes of items (eight a word, 64 an item) whose index is broadcast at a time: some 550 rows for each of their pieces.
ITEM_BYTES = 128 << 10

_MASKS = np.array([m for m in range(1 << 16) if m.bit_count() <= NEAR], np.uint16)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_WORD = 0x7FFFFFFFFFFFFFFF
#: The lowest bit of seven lanes, and what copies seven bits into them.
_LANES, _SPREAD = sum(1 << 8 * j for j in range(7)), sum(1 << 7 * j for j in range(7))
LONGS = 9


def _lanes(h: str, k: int) -> str:
    """Bits k, k + 8 and so on of a word hash, one a lane; the ninth long has bits 56 to 62."""
    return f"(shiftright({h}, {k}) & {_LANES}L)" if k < 8 else f"((shiftright({h}, 56) * {_SPREAD}L) & {_LANES}L)"


def _majority(rows: DataFrame, words: str, *kept: str) -> DataFrame:
    """The columns kept and _print, the fingerprint from the counts _t0 to _t8 of so many words.

    A lane that counts more than half of them reaches its highest bit. Each step is a column of its own, so that
    the compiled code stays short.
    """
    rows = rows.withColumn("_bias", F.expr(f"(127L - shiftright({words}, 1)) * {_LANES}L"))
    rows = rows.select(*kept, *[F.expr(f"shiftright(_t{k} + _bias, 7) & {_LANES}L").alias(f"_t{k}") for k in range(LONGS)])
    last = [f"shiftleft(shiftright(_t8, {8 * j}) & 1L, {56 + j})" for j in range(7)]
    return rows.select(*kept, F.expr(" | ".join([f"shiftleft(_t{k}, {k})" for k in range(8)] + last)).alias("_print"))


def _words() -> Column:
    """Lower-case words of the column text between white space (blank and \\x09 to \\x0D); none for an empty text."""
    trimmed = F.btrim(F.lower("text"), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _run(at: str, width: str | int = SHINGLE) -> str:
    """The hash of up to five of _words from `at` on; nulls leave a hash as it is."""
    return "xxhash64(" + ", ".join(f"IF({k} < {width}, get(_words, {at} + {k}), NULL)" for k in range(SHINGLE)) + ")"


def _items(benchmark: DataFrame) -> DataFrame:
    """_item, item_id, _n (words), _h (word hashes), _own (hashes of the shingles, of fewer words of the whole)."""
    items = benchmark.select("item_id", text_of().alias("text")).select("item_id", _words().alias("_words")).where("size(_words) > 0")
    own = f"transform(sequence(0, greatest(size(_words) - {SHINGLE}, 0)), i -> {_run('i', f'least(size(_words), {SHINGLE})')})"
    return items.select(F.monotonically_increasing_id().alias("_item"), "item_id", F.size("_words").alias("_n"), F.expr(f"transform(_words, w -> xxhash64(w) & {_WORD}L)").alias("_h"), F.expr(own).alias("_own"))


def _pieces(items: DataFrame) -> DataFrame:
    """_item, _offset, _size, _piece (the fingerprint): all phases, in each stretch of a long item."""
    size = f"least({LARGEST}, {GRID} * ((_n - {GRID - 1}) div {GRID}))"
    rows = items.where(F.col("_n") >= SHORTEST).withColumn("_size", F.expr(f"int({size})"))
    rows = rows.withColumn("_offset", F.explode(F.expr(f"filter(sequence(0, _n - _size), p -> p % {LARGEST} < {2 * GRID})")))
    rows = rows.withColumn("_part", F.expr("slice(_h, _offset + 1, _size)"))
    rows = rows.select("_item", "_n", "_offset", "_size", *[F.expr(f"aggregate(_part, 0L, (n, h) -> n + {_lanes('h', k)})").alias(f"_t{k}") for k in range(LONGS)])
    return _majority(rows, "_size", "_item", "_n", "_offset", "_size").withColumnRenamed("_print", "_piece")


def _slices(pieces: DataFrame) -> list[tuple[list[int], Column]]:
    """Window sizes and a condition on pieces for each part of the index: neighbouring sizes together, a size of many items cut by their hash."""
    sizes = pieces.where("_offset = 0").groupBy("_size").agg(F.sum(8 * F.col("_n") + 64).alias("bytes")).orderBy("_size").collect()  # 60 at most
    out, own, held = [], [], 0
    for r in sizes:
        if own and held + r["bytes"] > ITEM_BYTES:
            out.append((own, F.col("_size").isin(own)))
            own, held = [], 0
        if r["bytes"] > ITEM_BYTES:
            cut = -(-r["bytes"] // ITEM_BYTES)
            out += [([r["_size"]], (F.col("_size") == r["_size"]) & (F.pmod(F.xxhash64("_item"), F.lit(cut)) == k)) for k in range(cut)]
        else:
            own, held = [*own, r["_size"]], held + r["bytes"]
    return out + ([(own, F.col("_size").isin(own))] if own else [])


def window_prints(rows: DataFrame, sizes: list[int], known: list[int]) -> DataFrame:
    """_key, _size, _start, _print, _enough: fingerprints of all windows of the rows' (_key, text), at every start on the grid.

    A window may be short of up to a quarter of its words at a text's ends, where _start is negative or the end beyond the text.
    _enough: at least half of its shingles are known, as the similarity asked for needs 3/4 of an item's.
    """
    most = max(sizes) // GRID
    spare = most // 4 + 1
    step = max(1, min(TOGETHER, TOTALLED) // GRID - most)  # windows of a part, in steps of the grid
    # Texts are dealt out once; their words, totals and windows stay where they are.
    texts = rows.select(F.monotonically_increasing_id().alias("_row"), "_key", "text").repartition("_row")
    words = texts.select("_row", "_key", _words().alias("_words")).withColumn("_n", F.size("_words"))
    words = words.withColumn("_last", F.expr(f"int((_n + {GRID - 1}) div {GRID} + {2 * spare})"))
    parts = words.withColumn("_part", F.explode(F.expr(f"sequence(0, int((_last - 1) div {step}))")))
    steps = parts.withColumn("_at", F.explode(F.expr(f"sequence(_part * {step}, least(_last, (_part + 1) * {step} + {most}))")))
    at = f"{GRID} * (_at - {spare})"
    steps = steps.select("_row", "_key", "_n", "_part", "_at", *[F.expr(f"IF({at} + {j} >= 0 AND {at} + {j} < _n, xxhash64(get(_words, {at} + {j})) & {_WORD}L, 0L)").alias(f"_h{j}") for j in range(2 * GRID)])
    steps = steps.select("_row", "_key", "_n", "_part", "_at", *[F.expr(" + ".join(_lanes(f"_h{j}", k) for j in range(GRID))).alias(f"_s{k}") for k in range(LONGS)], F.array(*[F.xxhash64(*[f"_h{j + k}" for k in range(SHINGLE)]) for j in range(GRID)]).alias("_runs"))
    values = ", ".join(f"{v}L" if v > -(2**63) else f"(-{2**63 - 1}L - 1L)" for v in known)
    shingles = " + ".join(f"IF({at} + {j} BETWEEN 0 AND _n - {SHINGLE} AND _runs[{j}] IN ({values}), 1L, 0L)" for j in range(GRID))
    steps = steps.withColumn(f"_s{LONGS}", F.expr(shingles))
    before = Window.partitionBy("_row", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.select("_row", "_key", "_n", "_part", "_at", *[(F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)) - F.col(f"_s{k}")).alias(f"_t{k}") for k in range(LONGS + 1)])
    totals = steps.groupBy("_row", "_part").agg(F.first("_key").alias("_key"), F.first("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_at", *[f"_t{k}" for k in range(LONGS + 1)]))).alias("_totals"))
    starts = totals.withColumn("_at", F.explode(F.expr(f"sequence(0, least({step}, size(_totals) - 1) - 1)")))
    starts = starts.withColumn("_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    starts = starts.withColumn("_start", F.expr(f"{GRID} * (_part * {step} + _at - {spare})")).withColumn("_w", F.expr("least(_start + _size, _n) - greatest(_start, 0)"))
    starts = starts.where(F.expr(f"4 * _w >= 3 * _size AND _at + _size div {GRID} < size(_totals)"))
    # The last shingle of a window begins a step of the grid before its end.
    within = lambda place: f"greatest(least({place}, _n - {SHINGLE - 1}), 0)"
    enough = f"2 * (_totals[int(_at + _size div {GRID} - 1)]._t{LONGS} - _totals[_at]._t{LONGS}) >= {within(f'_start + _size - {SHINGLE - 1}')} - {within('_start')}"
    starts = starts.select("_key", "_size", "_start", "_w", F.expr(enough).alias("_enough"), F.expr(f"_totals[int(_at + _size div {GRID})]").alias("_end"), F.expr("_totals[_at]").alias("_begin"))
    starts = starts.select("_key", "_size", "_start", "_enough", "_w", *[F.expr(f"_end._t{k} - _begin._t{k}").alias(f"_t{k}") for k in range(LONGS)])
    return _majority(starts, "_w", "_key", "_size", "_start", "_enough")


def _blocks(fingerprint: str) -> Column:
    """Numbers of the blocks of a window size with their values, each in one long. The array names the fingerprint, so that this is computed once before it is taken apart."""
    return F.expr("array(" + ", ".join(f"(_size div {GRID}) * {BLOCKS << 16}L + {b << 16}L + (shiftright({fingerprint}, {16 * b}) & 65535L)" for b in range(BLOCKS)) + ")")


def _near_pieces(rows: DataFrame, pieces: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """_key, _item, _place (where the item would begin), hamming of windows whose fingerprint is near a piece's."""
    masks = F.array(*[F.lit(int(m)).cast("long") for m in _MASKS])
    index = pieces.withColumn("_block", F.explode(_blocks("_piece"))).withColumn("_mask", F.explode(masks))
    index = index.select(F.expr("_block ^ _mask").alias("_where"), "_piece", "_item", "_offset")
    runs_of = "transform(sequence(0, _n - 5), i -> xxhash64(" + ", ".join(f"_h[i + {k}]" for k in range(SHINGLE)) + "))"
    known = items.join(pieces.select("_item").distinct(), "_item", "left_semi").select(F.explode(F.expr(runs_of)).alias("_known")).distinct()
    known = [r["_known"] for r in known.collect()]  # of ITEM_BYTES of items
    windows = window_prints(rows, sizes, known).withColumn("_value", F.explode(_blocks("_print")))
    distance = F.bit_count(F.col("_print").bitwiseXOR(F.col("_piece")))
    found = windows.join(F.broadcast(index), (F.col("_value") == F.col("_where")) & (distance <= RADIUS) & F.col("_enough"))
    return found.select("_key", "_item", (F.col("_start") - F.col("_offset")).alias("_place"), distance.alias("hamming"))


def _short_pieces(rows: DataFrame, short: DataFrame, widths: list[int]) -> DataFrame:
    """The same of items of few words, by their shingles."""
    index = short.select("_item", F.expr(f"least(_n, {SHINGLE})").alias("_known_width"), F.posexplode("_own").alias("_offset", "_known"))
    at = rows.select("_key", _words().alias("_words")).withColumn("_width", F.explode(F.array(*[F.lit(w) for w in widths]))).where("size(_words) >= _width")
    at = at.withColumn("_start", F.explode(F.expr("sequence(0, size(_words) - _width)"))).select("_key", "_width", "_start", F.expr(_run("_start", "_width")).alias("_run"))
    found = at.join(small(materialize(index, "decontam-short")), (F.col("_run") == F.col("_known")) & (F.col("_width") == F.col("_known_width")))
    return found.select("_key", "_item", (F.col("_start") - F.col("_offset")).alias("_place"), F.lit(0).alias("hamming"))


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold an item: doc_id, item_id, similarity, hamming, start_word, n_words, text_sha256.

    One row for each row of docs and item with a window of similarity 0.75 or more: the best window, the first
    among equals, and the smallest distance of a fingerprint. Similarity is that of bags of five-word shingles,
    the shared part over the whole. An item of fewer words must occur word for word. Windows at a document's
    ends may be shorter. Null texts are empty and match nothing, as do items without words; repeated rows and null
    ids give rows of their own. Ids may be of any type. Empty tables give no rows. The index of items is broadcast in
    slices of ITEM_BYTES, for each of which the documents are read once.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    keyed = rows.select(F.xxhash64("text").alias("_key"), "text")  # texts of one key share candidates, nothing else
    items = materialize(_items(benchmark), "decontam-items")
    pieces = materialize(_pieces(items), "decontam-pieces")
    short = items.where(F.col("_n") < SHORTEST)
    widths = sorted(r["w"] for r in short.select(F.expr(f"least(_n, {SHINGLE})").alias("w")).distinct().collect())  # five at most
    near = [_near_pieces(keyed, pieces.where(own), items, sizes) for sizes, own in _slices(pieces)]
    near += [_short_pieces(keyed, short, widths)] if widths else []
    found = near[0] if near else keyed.limit(0).selectExpr("_key", "0L AS _item", "0 AS _place", "0 AS hamming")
    for more in near[1:]:
        found = found.unionByName(more)
    found = found.groupBy("_key", "_item").agg(F.collect_set("_place").alias("_places"), F.min("hamming").alias("hamming"))
    found = materialize(found, "decontam-found")

    # What is found is little: each step is written, so that none is taken apart into the next and computed for every place.
    pairs = rows.withColumn("_key", F.xxhash64("text")).join(small(found), "_key").join(small(items.drop("_h")), "_item")
    pairs = pairs.select("doc_id", "item_id", "hamming", F.sha2("text", 256).alias("text_sha256"), "_n", "_own", "_places", _words().alias("_words"))
    runs_of = f"IF(size(_words) < {SHINGLE}, CAST(array() AS array<bigint>), transform(sequence(0, size(_words) - {SHINGLE}), i -> {_run('i')}))"
    pairs = materialize(pairs.select("doc_id", "item_id", "hamming", "text_sha256", "_n", "_own", "_places", F.expr(runs_of).alias("_runs")), "decontam-pairs")
    same = ["doc_id", "item_id", "hamming", "text_sha256"]
    whole = pairs.where(F.col("_n") < SHINGLE).select(*same, F.lit(1.0).alias("similarity"), F.array_min("_places").cast("long").alias("start_word"), F.col("_n").cast("long").alias("n_words"))

    # All starts near by; an item has _m shingles, the document _len.
    part = pairs.where(F.col("_n") >= SHINGLE).withColumn("_m", F.size("_own")).withColumn("_len", F.size("_runs"))
    first, last = "greatest(p - int(_n div 8 + 8), 1 - _m)", "least(p + int(_n div 8 + 8), _len - 1)"
    part = part.withColumn("_starts", F.array_distinct(F.expr(f"flatten(transform(_places, p -> IF({first} > {last}, CAST(array() AS array<int>), sequence({first}, {last}))))")))
    part = part.withColumn("_low", F.expr("greatest(array_min(_starts), 0)")).withColumn("_runs", F.expr("slice(_runs, _low + 1, least(array_max(_starts) + _m, _len) - _low)"))
    part = materialize(part.select(*same, "_m", "_len", "_own", "_starts", "_low", "_runs"), "decontam-near")
    # A place of a shingle counts in windows that begin behind another: those hold no more places of it before than the item has.
    equal = "filter(sequence(greatest(i - _m + 1, 0), i), t -> get(_runs, t) = x)"
    behind = f"IF(array_contains(_own, x), coalesce(get({equal}, size({equal}) - 1 - size(filter(_own, y -> y = x))), -1), {2**31 - 1})"
    part = materialize(part.select(*same, "_m", "_len", "_starts", "_low", F.expr(f"transform(_runs, (x, i) -> {behind})").alias("_behind")), "decontam-places")
    size = "least(s + _m, _len) - greatest(s, 0)"
    cuts = f"transform(_starts, s -> named_struct('low', greatest(s, 0), 'size', {size}, 'both', size(filter(slice(_behind, greatest(s, 0) - _low + 1, {size}), p -> p < greatest(s, 0) - _low))))"
    best = f"array_max(transform({cuts}, c -> named_struct('similarity', c.both / (c.size + _m - c.both), 'before', -c.low, 'less', -c.size)))"
    part = materialize(part.select(*same, F.expr(best).alias("_best")), "decontam-best").where(F.col("_best.similarity") >= SIMILARITY)
    part = part.select(*same, "_best.similarity", (-F.col("_best.before")).cast("long").alias("start_word"), (SHINGLE - 1 - F.col("_best.less")).cast("long").alias("n_words"))
    return part.unionByName(whole).select("doc_id", "item_id", "similarity", "hamming", "start_word", "n_words", "text_sha256")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns, whatever these are called.

    Rows are told by their text, so that another text of the same id stays and rows without an id are judged like others.
    """
    found = materialize(contaminations(docs, benchmark).select("text_sha256").distinct(), "decontam-result")
    return leave_out_texts(docs, found)


# The same search on arrays of one process; no query uses it, tests hold the operator against it.


def word_hashes(text: str) -> np.ndarray:
    """63-bit hashes of the lower-case words between white space (blank and \\x09 to \\x0D)."""
    words = text.lower().encode().split()
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) & _WORD for w in words), np.uint64, len(words))


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * _MIX[k]) * _MIX[0]
            out ^= out >> np.uint64(32)
    return out


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the known ones, which are sorted and not none."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def simhash(h: np.ndarray) -> int:
    """The fingerprint of a bag of word hashes."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0)
    return int(np.packbits(2 * bits > len(h)).view(np.uint64)[0])


def piece_size(n: int) -> int:
    """Words of the windows in which an item of n words is looked up."""
    return min(LARGEST, GRID * ((n - GRID + 1) // GRID))


class Index:
    """Items and where their pieces stand: by window size and block, a list of pieces for each of 65,536 values."""

    def __init__(self, items: list[tuple]):
        self.items = [(key, np.frombuffer(h, np.uint64)) for key, h in items]
        pieces: dict[int, list[tuple]] = {}
        self.short: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.bags, shingles = [], []
        for k, (_, h) in enumerate(self.items):
            n = len(h)
            own = runs(h, min(SHINGLE, n))
            self.bags.append(Counter(own.tolist()))
            shingles.append(own)
            if n < SHORTEST:
                for p, value in enumerate(own.tolist()):
                    self.short.setdefault(min(SHINGLE, n), {}).setdefault(value, []).append((k, p))
            else:
                size = piece_size(n)
                for p in range(n - size + 1):
                    if p % LARGEST < 2 * GRID:  # all phases, in each stretch of a long item
                        pieces.setdefault(size, []).append((simhash(h[p : p + size]), k, p))
        self.shingles = np.unique(np.concatenate(shingles)) if shingles else np.zeros(0, np.uint64)
        self.sizes: dict[int, tuple] = {}
        for size, rows in sorted(pieces.items()):
            fps = np.array([r[0] for r in rows], np.uint64)
            tables = []
            for block in range(BLOCKS):
                values = (fps >> np.uint64(16 * block)).astype(np.uint16)
                every = (values[:, None] ^ _MASKS[None, :]).ravel()
                order = np.argsort(every, kind="stable")
                begin = np.zeros((1 << 16) + 1, np.int32)
                np.cumsum(np.bincount(every, minlength=1 << 16), out=begin[1:])
                tables.append((begin, (order // len(_MASKS)).astype(np.int32)))
            self.sizes[size] = fps, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), tables


def window_fingerprints(hashes: list[np.ndarray], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, text, start, fingerprint) of all windows of texts of word hashes, at every start on the grid.

    A window may be short of up to a quarter of its words at a text's ends, where start is negative or the end beyond the text.
    """
    spare = max(sizes) // 4 // GRID + 1
    blocks = np.array([-(-len(h) // GRID) + 2 * spare for h in hashes])
    first = np.concatenate([[0], np.cumsum(blocks)])
    bits = np.zeros((first[-1] * GRID, 64), np.uint8)
    there = np.zeros(first[-1] * GRID, np.uint8)
    for f, h in zip(first[:-1], hashes):
        at = (f + spare) * GRID
        bits[at : at + len(h)] = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        there[at : at + len(h)] = 1
    owner = np.repeat(np.arange(len(hashes)), blocks)
    totals = np.zeros((first[-1] + 1, 64), np.int16)  # running totals; they wrap, their differences don't
    np.cumsum(bits.reshape(-1, GRID, 64).sum(1, dtype=np.int16), axis=0, dtype=np.int16, out=totals[1:])
    words = np.concatenate([[0], np.cumsum(there.reshape(-1, GRID).sum(1, dtype=np.int64))])
    for size in sizes:
        q = size // GRID
        begin = np.flatnonzero((owner[: len(owner) - q + 1] == owner[q - 1 :]) & (4 * (words[q:] - words[:-q]) >= 3 * size)) if len(owner) >= q else np.zeros(0, np.int64)
        for at in range(0, len(begin), 20_000):
            b = begin[at : at + 20_000]
            n = (words[b + q] - words[b]).astype(np.int16)
            fps = np.packbits(2 * (totals[b + q] - totals[b]) > n[:, None], axis=1).view(np.uint64)[:, 0]
            yield size, owner[b], (b - first[owner[b]] - spare) * GRID, fps


def candidates(hashes: list[np.ndarray], index: Index) -> dict[tuple[int, int], dict[int, int]]:
    """{(text, item): {place where the item would begin: distance of the fingerprints}} of all texts."""
    found: dict[tuple[int, int], dict[int, int]] = {}
    if not hashes:
        return found

    def add(text: int, item: int, at: int, distance: int) -> None:
        places = found.setdefault((text, item), {})
        places[at] = min(distance, places.get(at, 64))

    if index.sizes:
        # What verification asks for at least, counted for all texts at once: shingles that some item has.
        known = [np.concatenate([[0], np.cumsum(among(runs(h, SHINGLE), index.shingles))]) for h in hashes]
        lengths = np.array([len(k) - 1 for k in known])
        first = np.concatenate([[0], np.cumsum(lengths + 1)])
        known = np.concatenate(known)
        for size, text, start, fps in window_fingerprints(hashes, list(index.sizes)):
            piece_fps, item, offset, tables = index.sizes[size]
            for block, (begin, pieces) in enumerate(tables):
                value = (fps >> np.uint64(16 * block)).astype(np.uint16).astype(np.int64)
                number = begin[value + 1] - begin[value]
                w = np.repeat(np.flatnonzero(number), number[number > 0])
                nth = np.arange(len(w)) - np.repeat(np.cumsum(number[number > 0]) - number[number > 0], number[number > 0])
                p = pieces[begin[value[w]] + nth]
                distance = np.bitwise_count(fps[w] ^ piece_fps[p])
                near = distance <= RADIUS
                w, p, distance = w[near], p[near], distance[near]
                low = np.clip(start[w], 0, lengths[text[w]])
                high = np.clip(start[w] + size - SHINGLE + 1, 0, lengths[text[w]])
                shared = known[first[text[w]] + high] - known[first[text[w]] + low]
                enough = 2 * shared >= high - low  # the similarity asked for needs 3/4 of an item's shingles
                for k in np.flatnonzero(enough).tolist():
                    add(int(text[w[k]]), int(item[p[k]]), int(start[w[k]] - offset[p[k]]), int(distance[k]))
    for width, table in index.short.items():
        keys = np.array(sorted(table), np.uint64)
        for t, h in enumerate(hashes):
            own = runs(h, width)
            for at in np.flatnonzero(among(own, keys)).tolist():
                for item, p in table[int(own[at])]:
                    add(t, item, at - p, 0)
    return found


def _keep_least(places: dict, more: dict) -> None:
    """Adds places with their distances; of a place that both have the smaller distance stays."""
    for place, distance in more.items():
        places[place] = min(distance, places.get(place, distance))
