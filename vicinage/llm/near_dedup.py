"""Near-duplicate components by a chosen-path set similarity join.

Each document's set of word shingles is embedded as minwise tokens. In each of several independent trees a
node chooses coordinates by a hash of its path, and documents that agree there go to the same child. Small
nodes are compared exhaustively on full sets; larger ones branch again. Only documents whose sets differ
enter the trees: equal sets are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vicinage.llm.tables import discard, fresh, leave_out, materialize, small, text_of

SHINGLE = 5
#: Linked when 100 * shared >= 75 * united.
PERCENT = 75
#: Independent trees. A pair of similarity 0.75 shares a tree's first child with probability 0.75, so that
#: it is missed by all with probability 0.25 ** 16 as long as that node is small.
TREES = 16
#: Minwise tokens of the embedding; the first TREES are those of the trees' roots.
TOKENS = 48
#: A node up to this size is compared exhaustively; a larger one branches, up to DEEPEST times.
SMALL, DEEPEST, CHILDREN = 512, 5, 2
#: Trees of the first round. What they connect is known in the next, which looks at all other trees for links between
#: different components only.
FIRST = 2
#: A large node's members are compared with this many of them before it branches.
PIVOTS = 8
#: Agreeing tokens of a likely pair: at similarity 0.75, 36 of 48 are expected, and 3 more or less.
LIKELY = 21
#: Bytes of full sets that are compared together, but for a pair of sets that are larger themselves.
TOGETHER = 32 << 20
#: What a row of a node carries: the class, its sketch, the size of its set and its component so far.
MEMBER = ("id", "sketch", "n", "_c")

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = (np.random.default_rng(11).integers(0, 2**63, TOKENS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = np.random.default_rng(12).integers(0, 2**63, TOKENS, dtype=np.int64).astype(np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; of fewer words, one hash of the sequence."""
    words = text.encode().translate(_UPPER).split()  # bytes split at blanks and \\x09 to \\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b"\0".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            x = (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * _MIX[k]
            out = (out ^ x) * _MIX[0]
            out ^= out >> np.uint64(32)
    return np.unique(out)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The embedding: for each of TOKENS hash functions the smallest value, as 32 bits."""
    with np.errstate(over="ignore"):
        least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 4096):
            part = hashes[at : at + 4096]
            least = np.minimum(least, (part[None, :] * _ODD[:, None] + _ADD[:, None]).min(1))
    return (least >> np.uint64(32)).astype(np.uint32)


def sets_of(docs: DataFrame, full: bool = False) -> DataFrame:
    """doc_id, n_shingles, class (digest of the set, null when empty), sha (SHA-256 of the text), and tokens or, if full, hashes."""
    rows = docs.select("doc_id", text_of().alias("text"))
    schema = StructType([rows.schema["doc_id"]]).add("n_shingles", "long").add("class", "binary").add("sha", "binary").add("hashes" if full else "tokens", "binary")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, classes, digests, last = [], [], [], []
                for text in part["text"]:
                    text = text.as_py()
                    s = shingle_set(text)
                    data = s.tobytes()
                    sizes.append(len(s))
                    classes.append(xxhash.xxh3_128_digest(data) if len(s) else None)
                    digests.append(None if full else hashlib.sha256(text.encode()).digest())
                    last.append((data if full else minwise(s).tobytes()) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (classes, digests, last))], schema.fieldNames())

    return rows.mapInArrow(made, schema)


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """16 bits of each token, enough to count agreements and to part a node's members: an unequal token agrees by mistake in one of 65,536 cases."""
    return tokens.astype(np.uint16)


def _branches(parents: DataFrame, trees: range | None = None) -> DataFrame:
    """Children (node, MEMBER) of rows (node, MEMBER) by their sketches: node is the hash of the path.

    Given trees, the nodes of their roots, of rows (id, tokens, n, _c), by whole tokens, since all rows meet there.
    """
    schema = StructType().add("node", "long").add("id", "long").add("sketch", "binary").add("n", "long").add("_c", "long")

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.num_rows
            if trees is not None:
                values = np.frombuffer(b"".join(batch["tokens"].to_pylist()), np.uint32).reshape(rows, TOKENS)
                buffer = pa.py_buffer(sketch_of(values).tobytes())
                sketches = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * TOKENS), rows, [None, buffer]).cast(pa.binary())
            else:
                sketches = batch["sketch"]
                values = np.frombuffer(b"".join(sketches.to_pylist()), np.uint16).reshape(rows, TOKENS)
            with np.errstate(over="ignore"):
                if trees is not None:
                    paths, at = (np.tile(np.array(trees, kind), (rows, 1)) for kind in (np.uint64, np.int64))
                else:
                    node = batch["node"].to_numpy().view(np.uint64)[:, None]
                    turn = np.arange(CHILDREN, dtype=np.uint64) + np.uint64(1)
                    paths = node ^ (turn * _MIX[3])
                    first = (node * _MIX[1]) >> np.uint64(40)
                    at = ((first + turn * np.uint64(17)) % np.uint64(TOKENS)).astype(np.int64)
                value = np.take_along_axis(values, at, 1).astype(np.uint64)
                child = (paths * _MIX[0] + at.astype(np.uint64)) * _MIX[2] ^ value * _MIX[4]
                child = (child ^ (child >> np.uint64(31))) * _MIX[1]
                child ^= child >> np.uint64(29)
            of = pa.array(np.repeat(np.arange(rows), at.shape[1]))
            carried = [x.take(of) for x in (batch["id"], sketches, batch["n"], batch["_c"])]
            yield pa.RecordBatch.from_arrays([pa.array(child.reshape(-1).view(np.int64)), *carried], ["node", *MEMBER])

    return parents.mapInArrow(descend, schema)


def _placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (id and others) with _c, the component that known gives their id, or the id itself."""
    told = rows.drop("_c").join(small(known), "id", "left")
    return told.withColumn("_c", F.coalesce("component", "id")).drop("component")


def linked_pairs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links among sets that connect what is connected: a spanning forest of the true links.

    Shared counts come from the sorted union of all sets.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m, dtype=np.int64), sizes)
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    some = count[group] > 1
    column = np.cumsum(count > 1) - 1
    out = []
    if not some.any():
        return out
    rows, cols = o[some], column[group[some]]
    shared = np.zeros((m, m), np.float32)
    for low in range(0, int(cols.max()) + 1, 8192):  # a product of 0/1 matrices, a strip of shingles at a time
        inside = (cols >= low) & (cols < low + 8192)
        strip = np.zeros((m, min(8192, int(cols.max()) + 1 - low)), np.float32)
        strip[rows[inside], cols[inside] - low] = 1
        shared += strip @ strip.T
    united = sizes[:, None] + sizes[None, :] - shared
    links = 100 * shared >= PERCENT * united
    left = np.ones(m, bool)
    for begin in range(m):
        front = np.array([begin]) if left[begin] else np.zeros(0, np.int64)
        left[front] = False
        while len(front):
            step = links[front][:, left]
            reached = step.any(0)
            new = np.flatnonzero(left)[reached]
            out += zip(front[step.argmax(0)[reached]].tolist(), new.tolist())
            left[new] = False
            front = new
    return out


def _sifted(groups: DataFrame) -> DataFrame:
    """Rows (node, part, id, sketch, n, _c: component) without those that have no likely partner in their group: (node, id).

    Partners are of different components. A pair is likely when at least LIKELY of its tokens agree and the sizes of
    its sets allow the similarity. What likely pairs connect becomes a node named by a hash of its
    members, so that the same members found in several trees are one node; where its sets take more than TOGETHER
    bytes, it becomes a node for each pair of its pieces.
    """

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sketches, sizes, owners, nodes, out = None, [], [], [], [], [], []

        def emit(members: list[int]) -> None:
            nodes.extend([xxhash.xxh64_intdigest(np.array(members, np.int64).tobytes()) - (1 << 63)] * len(members))
            out.extend(members)

        def close() -> None:
            if len(set(owners)) < 2:
                return
            x = np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, TOKENS)
            agree = np.zeros((len(ids), len(ids)), np.uint8)
            for column in x.T:
                agree += column[:, None] == column[None, :]
            of, n = np.array(owners), np.array(sizes)
            near = (agree >= LIKELY) & (of[:, None] != of[None, :])
            near &= 100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :])
            left = set(np.flatnonzero(near.any(0)).tolist())
            while left:
                reached, front = set(), {left.pop()}
                while front:
                    reached |= front
                    front = set(np.flatnonzero(near[list(front)].any(0)).tolist()) & left
                    left -= front
                at = sorted(reached, key=lambda i: (sizes[i], ids[i]))
                pieces, size = [[]], 0
                for i in at:
                    if pieces[-1] and size + 8 * sizes[i] > TOGETHER // 2:
                        pieces.append([])
                        size = 0
                    pieces[-1].append(i)
                    size += 8 * sizes[i]
                if len(pieces) == 1:
                    emit(sorted(ids[i] for i in at))
                    continue
                for p, one in enumerate(pieces):
                    for two in pieces[p:]:
                        if near[np.ix_(one, two)].any():
                            emit(sorted({ids[i] for i in (*one, *two)}))

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.int64())], ["node", "id"])
            nodes.clear()
            out.clear()
            return made

        for b in batches:
            for key, i, t, n, c in zip(zip(*(b[c].to_pylist() for c in by)), *(b[c].to_pylist() for c in ("id", "sketch", "n", "_c"))):
                if key != now:
                    close()
                    now = key
                    for kept in (ids, sketches, sizes, owners):
                        kept.clear()
                for kept, value in zip((ids, sketches, sizes, owners), (i, t, n, c)):
                    kept.append(value)
            yield batch()
        close()
        yield batch()

    by = ["node", "part"]
    rows = groups.select(*by, *MEMBER).repartition(*by).sortWithinPartitions(*by, "id")
    return rows.mapInArrow(sift, "node long, id long").distinct()


def _compared(groups: DataFrame) -> DataFrame:
    """Links (a, b) of rows (node, id, hashes), one node after another in sorted partitions."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def links():
            found = linked_pairs(sets) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for node, i, h in zip(*(batch[c].to_pylist() for c in ("node", "id")), batch["hashes"]):
                if node != now:
                    if ids:
                        yield links()
                    now, ids, sets = node, [], []
                if ids and ids[-1] == i:  # rows that repeat an id and a set
                    continue
                ids.append(i)
                sets.append(np.frombuffer(h.as_py(), np.uint64))
        if ids:
            yield links()

    return groups.select("node", "id", "hashes").repartition("node").sortWithinPartitions("node", "id").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id that it is connected to, for every end of the edges (a, b).

    Each round points every node to its smallest neighbour, follows the pointers to their roots and contracts
    the edges to roots; the number of nodes halves at least. All tables stay distributed and are written.
    """
    current = materialize(edges.where("a <> b").distinct(), "near-edges")
    if current.isEmpty():
        return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    result = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "near-pointers")
        while True:
            further = point.select(F.col("id").alias("to"), F.col("to").alias("_next"))
            moved = materialize(point.select("id", "to").join(further, "to").select("id", F.col("_next").alias("to"), (F.col("_next") < F.col("to")).alias("_moved")), "near-pointers")
            discard(point)
            point = moved
            if point.where("_moved").isEmpty():
                break
        if result is None:
            result = materialize(point.select("id", "to"), "near-components")
        else:
            step = point.select(F.col("to").alias("_next"), F.col("id").alias("to"))
            longer = materialize(result.join(step, "to", "left").select("id", F.coalesce("_next", "to").alias("to")), "near-components")
            discard(result)
            result = longer
        at_a, at_b = point.select("id", "to").toDF("a", "_ra"), point.select("id", "to").toDF("b", "_rb")
        left = current.join(at_a, "a").join(at_b, "b").where("_ra <> _rb").select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")).distinct()
        left = materialize(left, "near-edges")
        discard(current, point)
        current = left
        if current.isEmpty():
            return result.withColumnRenamed("to", "component")


def extended(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) as `components` gives them, with more links (a, b), both read from storage.

    Only links between different components are followed, by their components' smallest ids.
    """
    if links.isEmpty():
        return known
    at_a, at_b = small(known.toDF("a", "_ra")), small(known.toDF("b", "_rb"))
    between = links.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b"))
    step = components(between)
    merged = known.join(small(step.toDF("component", "_to")), "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    return materialize(merged.unionByName(step.join(known.select("id"), "id", "left_anti")), "near-components")


def _sets_for(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """id and hashes of the given classes, written. One row of docs is read for each; rows that share its id may give others, which are left out."""
    wanted = materialize(classes.join(ids, "id").select("id", "class", F.col("low").alias("_low")), "near-wanted")
    key = fresh(docs, "_low")[0]
    rows = docs.join(small(wanted.select(F.col("_low").alias(key)).distinct()), F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")
    made = sets_of(rows, full=True).where("hashes IS NOT NULL").select("class", "hashes")
    made = materialize(made.join(small(wanted.select("id", "class")), "class").select("id", "hashes"), "near-sets")
    discard(wanted)
    return made


def _members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, class, sha) of docs, and (class, group, component_id) of every class that isn't alone; both written."""
    docs = docs.select("doc_id", "text")
    rows = materialize(sets_of(docs), "near-rows")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("low"), F.first("tokens").alias("tokens"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("_rows"))
    # The number of a class is fixed by being written; a digest of its own would have to be compared in full.
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "near-classes")
    embedded = classes.select("id", "tokens", "n")
    sketches = materialize(_sketched(classes), "near-sketches")

    nodes = materialize(_branches(embedded.withColumn("_c", F.col("id")), range(FIRST)), "near-nodes")
    written, sets, level = [], None, 0
    known, first = None, F.lit(0).cast("long").alias("part")
    while True:
        # Per component first, so that a node with very many rows is counted where they are.
        counts = nodes.groupBy("node", "_c").agg(F.count(F.lit(1)).alias("_k"), F.bit_xor(F.xxhash64("id")).alias("_x"))
        stats = counts.groupBy("node").agg(F.sum("_k").alias("_n"), F.min("_c").alias("_low"), F.max("_c").alias("_high"), F.bit_xor("_x").alias("_xor"), F.max_by("_c", "_k").alias("_most"), F.max("_k").alias("_held"))
        stats = materialize(stats.where("_low <> _high"), "near-stats")  # nodes of one row or one component are done
        # Nodes of the same members, as many pairs have in several trees, are compared once.
        once = stats.groupBy("_n", "_xor").agg(F.min_by(F.struct("node", "_most", "_held"), "node").alias("_of")).select("_n", "_of.*")
        leaf = materialize(once.where(F.col("_n") <= SMALL).select("node"), "near-leaf-nodes")
        leaves = nodes.join(small(leaf), "node").select("node", first, *MEMBER)
        large = once.where(F.col("_n") > SMALL).withColumn("_rest", F.col("_n") - F.col("_held"))
        if level:
            # What becomes of a large node: where few members are outside its largest component, these meet the component
            # (all of it, if the node has half of it or more: once for all such nodes), else it branches as long as it may.
            whole = small(materialize(known.groupBy(F.col("component").alias("_most")).agg(F.count(F.lit(1)).alias("_whole")), "near-sizes"))
            few = F.col("_rest") <= SMALL
            fate = F.when(few & (2 * F.col("_held") >= F.col("_whole")), "met").when(few | F.lit(level == DEEPEST), "rest").otherwise("branch")
            large = large.join(whole, "_most", "left").withColumn("_fate", fate).drop("_whole")
        else:
            large = large.withColumn("_fate", F.lit("branch"))
        large = materialize(large, "near-large")
        fates = {r["_fate"] for r in large.select("_fate").distinct().collect()}  # three at most
        more, used = "branch" in fates, [stats, leaf, large]
        if "met" in fates:
            own, among = _met(nodes, large.where("_fate = 'met'"), known, sketches)
            used.append(own)
            leaves = leaves.unionByName(own.select("node", first, *MEMBER)).unionByName(among)
        if "rest" in fates:
            inside = nodes.join(small(large.where("_fate = 'rest'")), "node")
            used.append(materialize(inside, "near-inside"))
            leaves = leaves.unionByName(_all_against_rest(used[-1]))
        if more:
            branching = materialize(nodes.join(small(large.where("_fate = 'branch'")), "node").select("node", *MEMBER, "_n"), "near-branching")
            used.append(branching)
            parts = (F.col("_n") / SMALL).cast("long") + 1
            ranked = F.pmod(F.xxhash64("node", "id"), F.lit(1 << 40))
            pivots = branching.withColumn("_r", ranked).groupBy("node", "_n", F.pmod("_r", F.lit(PIVOTS)).alias("_slot")).agg(F.min_by(F.struct(*MEMBER), "_r").alias("_member")).select("node", "_n", "_member.*")
            spread = pivots.select("node", F.explode(F.sequence(F.lit(1).cast("long"), parts)).alias("part"), *MEMBER)
            members = branching.select("node", (F.pmod(F.xxhash64("id", "node"), parts) + 1).alias("part"), *MEMBER)
            members = members.join(pivots.select("node", "id"), ["node", "id"], "left_anti")
            leaves = leaves.unionByName(spread).unionByName(members)
        leaves = materialize(_sifted(leaves), "near-leaves")
        new = leaves.select("id").distinct()
        written.append(_sets_for(docs, classes, new if sets is None else new.join(sets.select("id"), "id", "left_anti")))
        sets = written[-1] if sets is None else sets.unionByName(written[-1])
        found = materialize(_compared(sets.join(small(leaves), "id")), "near-links")  # full sets are shuffled once
        known = extended(known, found) if level else components(found)
        deeper = None
        if more or not level:
            # Components are looked up once a row, before it branches.
            deeper = _branches(_placed(branching.drop("_n"), known)) if more else None
            if not level:
                others = _branches(_placed(embedded, known), range(FIRST, TREES))
                deeper = others if deeper is None else deeper.unionByName(others)
            deeper = materialize(deeper, "near-nodes")
        discard(*used, nodes, leaves, found)
        if deeper is None:
            break
        nodes = deeper
        level += 1
    discard(sketches, *written)

    linked = classes.join(known, "id", "left").where("_rows > 1 OR component IS NOT NULL").select("class", "low", F.coalesce("component", "id").alias("group"))
    linked = materialize(linked, "near-linked")
    least = linked.groupBy("group").agg(F.min("low").alias("component_id"))
    told = materialize(linked.join(least, "group").select("class", "group", "component_id"), "near-class-components")
    discard(classes, linked)
    return rows.drop("tokens"), told


def _sketched(classes: DataFrame) -> DataFrame:
    """id, sketch and n of each class."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sketches = [sketch_of(np.frombuffer(t.as_py(), np.uint32)).tobytes() for t in b["tokens"]]
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(sketches, pa.binary()), b["n"]], ["id", "sketch", "n"])

    return classes.select("id", "tokens", "n").mapInArrow(made, "id long, sketch binary, n long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Words are lower-case and parted by white space; a document's set are its distinct five-word shingles,
    of fewer words the one sequence, of no words (null and empty texts) nothing, linked with nothing. Links
    are similarities of at least 0.75 on full sets; component_id is the smallest id that links lead to. Ids may be of
    any type that can be ordered. Rows that repeat an id are documents of their own with the same id. A row
    without an id belongs to the component of its text: it isn't kept where that has an id, and is kept, with a
    null component_id, where no row of it has one. An empty table gives no rows.
    """
    rows, linked = _members(docs)
    # A class may hold a third of all rows: both sides are plain scans here, so that Spark may split the hot key.
    out = rows.select("doc_id", "n_shingles", "class").join(linked.withColumn("_linked", F.lit(True)), "class", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _met(nodes: DataFrame, large: DataFrame, known: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of large nodes outside their largest components: (node, _most, MEMBER), written, and their comparisons with these: (node, part, MEMBER).

    A component that is the largest in several nodes meets the outsiders of all of them at once, in blocks of SMALL by groups of SMALL.
    """
    own = nodes.join(small(large.select(F.col("node").alias("_at"), "_most")), (F.col("node") == F.col("_at")) & (F.col("_c") != F.col("_most")))
    own = materialize(own.select("node", "_most", *MEMBER), "near-outsiders")
    outside = own.select("_most", *MEMBER).dropDuplicates(["_most", "id"])
    sizes = known.groupBy(F.col("component").alias("_most")).agg(((F.count(F.lit(1)) / SMALL).cast("long") + 1).alias("_blocks"))
    sizes = small(materialize(outside.groupBy("_most").agg(((F.count(F.lit(1)) / SMALL).cast("long") + 1).alias("_groups")).join(sizes, "_most"), "near-met"))
    zero = F.lit(0).cast("long")
    members = known.select(F.col("component").alias("_most"), "id").join(sizes, "_most").join(sketches, "id").withColumn("_c", F.col("_most"))
    members = members.withColumn("_b", F.pmod(F.xxhash64("id"), "_blocks")).withColumn("_g", F.explode(F.sequence(zero, F.col("_groups") - 1)))
    rest = outside.join(sizes, "_most").withColumn("_g", F.pmod(F.xxhash64("id"), "_groups")).withColumn("_b", F.explode(F.sequence(zero, F.col("_blocks") - 1)))
    both = members.select("_most", "_b", "_g", *MEMBER).unionByName(rest.select("_most", "_b", "_g", *MEMBER))
    return own, both.select(F.xxhash64("_most", F.lit("met")).alias("node"), (F.col("_b") * 1_000_000 + F.col("_g") + 1).alias("part"), *MEMBER)


def _all_against_rest(inside: DataFrame) -> DataFrame:
    """Comparisons of large nodes that don't branch: members outside a node's largest component with all others, in blocks: (node, part, MEMBER).

    inside: node, _n, MEMBER, _most (the largest component), _rest (members outside it). Each such member goes to
    every block of its node, in groups of SMALL.
    """
    parts, groups = ((F.col(n) / SMALL).cast("long") + 1 for n in ("_n", "_rest"))
    part = (F.col("_b") * 1_000_000 + F.col("_g") + 1).alias("part")
    members = inside.withColumn("_b", F.pmod(F.xxhash64("id", "node"), parts)).withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)))
    rest = inside.where("_c <> _most").withColumn("_g", F.pmod(F.xxhash64("id"), groups)).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return members.select("node", part, *MEMBER).unionByName(rest.select("node", part, *MEMBER)).dropDuplicates(["node", "part", "id"])


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of near-duplicates, with all its columns, and all rows without words.

    The row with the smallest id stays, a null id being largest and ties going to the smaller SHA-256 of the text;
    of rows that repeat id and text one stays. Rows are told by id and text, so another text of the same id
    is judged by itself. Columns may have any names. An empty table stays empty.
    """
    rows, linked = _members(docs)
    pairs = rows.where("class IS NOT NULL").join(linked, "class").groupBy("group", "doc_id", "sha").agg(F.count(F.lit(1)).alias("_n"))
    pairs = materialize(pairs, "near-pairs")
    stays = pairs.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "sha")).alias("_keep"))
    told = pairs.join(materialize(stays, "near-stays"), "group").select("doc_id", F.lower(F.hex("sha")).alias("sha"), "_n", (F.col("doc_id").eqNullSafe(F.col("_keep.doc_id")) & (F.col("sha") == F.col("_keep.sha"))).alias("_stays"))
    told = materialize(told, "near-told")
    return leave_out(docs, told.where("NOT _stays").select("doc_id", "sha"), told.where("_stays AND _n > 1").select("doc_id", "sha"))
