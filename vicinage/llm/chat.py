"""Chat formatting: layouts are known by a fingerprint of their nested field paths.

Each known layout has a declarative mapping to canonical turns (conversation, turn, role, text). Turns are
written with markers; marker-like strings inside texts are escaped so that the output can be read back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
#: A conversation goes on in another row when a row has this many characters, so that rows stay bounded.
SEGMENT = 1 << 20
SPANS = ArrayType(StructType().add("start", "long").add("end", "long"))

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    rows: the record is one turn, fields are (conversation, turn, role, text). items: a list field with a
    role and a text field each. pairs: fixed (role, field) pairs; empty optional fields make no turn.
    """

    name: str
    rows: tuple[str, str, str, str] | None = None
    items: tuple[str, str, str] | None = None
    pairs: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        if self.rows:
            return tuple(sorted(self.rows))
        if self.items:
            field, role, text = self.items
            return tuple(sorted((f"{field}[].{role}", f"{field}[].{text}")))
        return tuple(sorted(f for _, f in self.pairs))


MAPPINGS = (
    Mapping("turn rows", rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", items=("messages", "role", "content")),
    Mapping("exchange", items=("conversations", "from", "value")),
    Mapping("instruction", pairs=(("system", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Mapping("bare instruction", pairs=(("user", "instruction"), ("assistant", "output"))),
    Mapping("completion", pairs=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("response", pairs=(("user", "prompt"), ("assistant", "response"))),
    Mapping("guided response", pairs=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("question", pairs=(("user", "question"), ("assistant", "answer"))),
)


def fingerprint(paths) -> str:
    """Hex digest of a set of field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def schema_paths(kind: DataType, prefix: str = "") -> set[str]:
    """Leaf paths of a schema; [] stands for the items of a list."""
    if isinstance(kind, StructType):
        return set().union(*(schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind)) if len(kind) else set()
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return {prefix}


def value_paths(value, prefix: str = "") -> set[str]:
    """Leaf paths of a parsed JSON value."""
    if isinstance(value, dict):
        return set().union(*(value_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(value_paths(v, f"{prefix}[]") for v in value)) if value else {f"{prefix}[]"}
    return {prefix}


def mapping_for(paths: set[str]) -> Mapping | None:
    """The mapping whose fingerprint the paths have.

    Other fields may stand beside a layout's own: if no fingerprint fits, the mapping that needs only paths given here and
    all that the others of this kind need. Where two layouts are there and neither holds the other, none is chosen.
    """
    found = BY_FINGERPRINT.get(fingerprint(paths))
    if found:
        return found
    fitting = [m for m in MAPPINGS if set(m.paths) <= paths]
    widest = [m for m in fitting if all(set(o.paths) <= set(m.paths) for o in fitting)]
    return widest[0] if widest else None


def canonical_turns(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of a table in any known layout. Extra columns are passed over.

    The layout is found from the schema's fingerprint; an unknown one is an error. Null role and text
    are empty; a null list has no turns.
    """
    mapping = mapping_for(schema_paths(records.schema))
    if mapping is None:
        raise ValueError(f"no mapping for the fields {sorted(schema_paths(records.schema))}")
    empty = F.lit("")
    if mapping.rows:
        conv, turn, role, text = mapping.rows
        return records.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(F.col(text).cast("string"), empty).alias("text"))
    if mapping.items:
        field, role, text = mapping.items
        named = F.transform(field, lambda x: F.struct(F.coalesce(x[role].cast("string"), empty).alias("role"), F.coalesce(x[text].cast("string"), empty).alias("text")))
    else:
        made = [F.when(F.col(f).isNull() | (F.col(f) == ""), None).otherwise(F.struct(F.lit(r).alias("role"), F.col(f).cast("string").alias("text"))) if f in mapping.optional else F.struct(F.lit(r).alias("role"), F.coalesce(F.col(f).cast("string"), empty).alias("text")) for r, f in mapping.pairs]
        named = F.filter(F.array(*made), lambda x: x.isNotNull())
    turns = records.select(F.col(key).alias("conv_id"), F.posexplode(named).alias("turn", "_item"))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(known[F.col("_item.role")], F.col("_item.role")).alias("role"), F.col("_item.text").alias("text"))


def turns_of_value(value) -> list[tuple[str, str]] | None:
    """Role and text of each turn of one parsed JSON record; None if its layout is unknown."""
    mapping = mapping_for(value_paths(value)) if isinstance(value, dict) else None
    if mapping is None or mapping.rows:
        return None
    as_text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if mapping.items:
        field, role, text = mapping.items
        if not isinstance(value[field], list) or not all(isinstance(x, dict) for x in value[field]):
            return None
        return [(ROLES.get(as_text(x.get(role)), as_text(x.get(role))), as_text(x.get(text))) for x in value[field]]
    return [(r, as_text(value.get(f))) for r, f in mapping.pairs if value.get(f) or f not in mapping.optional]


def canonical_json(records: DataFrame, key: str, column: str) -> DataFrame:
    """conv_id, turn, role, text of a column of JSON records whose layouts may differ from row to row.

    Records that aren't JSON, have no known layout, more than one, or turns that aren't objects come out as one turn
    with a null role and the raw text. A null record has no turns.
    """

    @F.pandas_udf("array<struct<role:string,text:string>>")
    def turns(texts: pd.Series) -> pd.Series:
        def one(raw):
            try:
                found = turns_of_value(json.loads(raw)) if raw is not None else []
            except ValueError:
                found = None
            return [{"role": None, "text": raw}] if found is None else [{"role": r, "text": t} for r, t in found]

        return pd.Series([one(x) for x in texts])

    rows = records.select(F.col(key).alias("conv_id"), F.posexplode(turns(F.col(column))).alias("turn", "_item"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "_item.role", "_item.text")


_OPEN, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No "<|" is left: each "<", backslashes, "|" gets one more backslash."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted string."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield role_of(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END)


def format_turns(turns: DataFrame) -> DataFrame:
    """One row or more for each conversation: conv_id, segment, formatted, loss (list of start and end).

    Turns are ordered by turn, ties by role, then text; null turns come first. Rows with a null conv_id
    are one conversation. Repeated rows are turns of their own. Partitions are sorted and streamed, so a
    conversation of any length takes memory for one segment only; its segments follow one another.
    """
    kind = next(f for f in turns.select("conv_id").schema)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = StructType([kind]).add("segment", "long").add("formatted", "string").add("loss", SPANS)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        conv, number, parts, loss, length, begun, id_type = None, 0, [], [], 0, False, None
        done: list[tuple] = []

        def flush():
            done.append((conv, number, "".join(parts), [{"start": s, "end": e} for s, e in loss]))
            parts.clear()
            loss.clear()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], id_type), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string()), pa.array([d[3] for d in done], spans)], ["conv_id", "segment", "formatted", "loss"])
            done.clear()
            return out

        for b in batches:
            id_type = b.schema.field("conv_id").type
            for c, role, text in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist()):
                if begun and (c != conv or length >= SEGMENT):
                    flush()
                    number = number + 1 if c == conv else 0
                    length = 0
                conv, begun = c, True
                head, body = f"{START}{role_line(role)}\n", escape(text)
                if role == LEARNED:
                    loss.append((length + len(head), length + len(head) + len(body)))
                parts += (head, body, END)
                length += len(head) + len(body) + len(END)
            if done:
                yield batch()
        if begun:
            flush()
            yield batch()

    return rows.mapInArrow(segments, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, from the formatted rows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows may come in any order; they are dealt by conversation and sorted by segment, and streamed, since a digest
    goes over the turns one after another. Rows with a null conv_id are one conversation.
    """
    kind = next(f for f in formatted.select("conv_id").schema)
    schema = StructType([kind]).add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")
    names = schema.fieldNames()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, id_type = None, [], None

        def flush():
            conv, n, turns, chars, learned, size = now
            done.append((conv, n, turns.hexdigest(), chars, learned.hexdigest(), size))

        def batch():
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)
            done.clear()
            return out

        for b in batches:
            id_type = b.schema.field("conv_id").type
            for c, segment, text, loss in zip(b["conv_id"].to_pylist(), b["segment"].to_pylist(), b["formatted"].to_pylist(), b["loss"].to_pylist()):
                if now is None or now[0] != c:
                    if now:
                        flush()
                    now = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    learned = unescape(text[span["start"] : span["end"]])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(text)
            if done:
                yield batch()
        if now:
            flush()
            yield batch()

    rows = formatted.select("conv_id", "segment", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return rows.mapInArrow(digests, schema)
