"""Personal data: pattern matches with checks, and a skip-chain conditional random field that adds to them.

The field's variables are a document's tokens that hold a digit or an at sign; all others are outside by
definition. Neighbouring tokens are joined by chain edges, and each token to the last one before it, at
whatever distance, that repeats it, its digits or its name before the at sign, by a skip edge. Loopy message
passing over both makes labels agree. The field is fitted on texts in which found data is mentioned again without what
its pattern asks for (a phone number without its plus sign, an address without its domain), next to like numbers
that were never mentioned: only the skip edge tells the two apart.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vicinage.llm.tables import bounded_sample, text_of

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: The field is fitted on at most this many documents, on texts of up to so many characters among them, and on the first tokens of a text.
FIT_ROWS, FIT_CHARS, FIT_TOKENS = 6000, 20_000, 500
#: A token is labelled only if its marginal probability is this high.
SURE = 0.9
#: The tokens that follow directly are taken along if theirs is this high.
ALONG = 0.75
ROUNDS = 8

_HINT = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that can't start a match can't start one further inside, so only its beginning is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SPACE = re.compile(r"\s")
_TRIM = " \t\r\n.,;:!?\"'<>[]{}|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches that pass their checks, by kind, then start."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m[0]))
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                found.append((3, *m.span()))
    return found


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Start and end of the tokens between white space that hold a digit or an at sign."""
    spans, end = [], 0
    for m in _HINT.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        spans.append((start, end))
    return spans


FEATURES = (
    "any", "at sign", "domain", "two at signs", "plus first", "bracketed", "four parts", "part too large", "luhn", "letters", "hyphen", "dot inside", "other sign",
    "digits 0", "digits 1", "digits 2-3", "digits 4", "digits 5-6", "digits 7", "digits 8-11", "digits 12-15", "digits 16-19", "digits 20+",
    "after a number", "before a number", "after plus", "after brackets", "second after plus",
)
_AT = {name: i for i, name in enumerate(FEATURES)}
_SIZES = ((0, 0), (1, 1), (2, 3), (4, 4), (5, 6), (7, 7), (8, 11), (12, 15), (16, 19), (20, 1 << 60))


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """One row of FEATURES for each token."""
    out = np.zeros((len(spans), len(FEATURES)), np.float32)
    for k, (start, end) in enumerate(spans):
        core = text[start:end].strip(_TRIM)
        digits = _DIGITS.findall(core)
        row = out[k]
        row[0] = 1
        row[_AT["at sign"]] = "@" in core
        row[_AT["domain"]] = bool(_DOMAIN.search(core))
        row[_AT["two at signs"]] = core.count("@") > 1
        row[_AT["plus first"]] = core.startswith("+")
        row[_AT["bracketed"]] = core.startswith("(") and core.endswith(")")
        parts = core.split(".")
        four = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
        row[_AT["four parts"]] = four
        row[_AT["part too large"]] = four and any(len(p) > 3 or int(p) > 255 for p in parts)
        row[_AT["luhn"]] = 16 <= len(digits) <= 19 and luhn("".join(digits))
        row[_AT["letters"]] = any(c.isalpha() for c in core)
        row[_AT["hyphen"]] = "-" in core[1:]
        row[_AT["dot inside"]] = "." in core
        row[_AT["other sign"]] = any(not c.isalnum() and c not in "+-.@()_%" for c in core)
        row[_AT["digits 0"] + next(i for i, (a, b) in enumerate(_SIZES) if a <= len(digits) <= b)] = 1
        if k and start - spans[k - 1][1] <= 1:
            row[_AT["after a number"]] = out[k - 1][_AT["before a number"]] = 1
            row[_AT["after plus"]] = out[k - 1][_AT["plus first"]]
            row[_AT["second after plus"]] = out[k - 1][_AT["after plus"]]
            row[_AT["after brackets"]] = out[k - 1][_AT["bracketed"]]
    return out


def edges_of(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(token, token, 0 for chain or 1 for skip); a token has at most one skip edge to earlier ones of each kind."""
    edges, last = [], {}
    for k, (start, end) in enumerate(spans):
        chained = bool(k) and start - spans[k - 1][1] <= 1
        if chained:
            edges.append((k - 1, k, 0))
        core = text[start:end].strip(_TRIM)
        digits = "".join(_DIGITS.findall(core))
        names = [core] if "@" in core or len(digits) >= 4 else []
        if len(digits) >= 7:
            names.append("#" + digits[-10:])
            names.append("#" + digits[-7:])  # a phone number's last part stands alone where it is parted by blanks
        if "@" in core and core.index("@") > 0:
            names.append("@" + core[: core.index("@")])
        before = {last[n] for n in names if n in last} - ({k - 1} if chained else set())
        edges += [(j, k, 1) for j in before]
        last |= dict.fromkeys(names, k)
    return edges


def beliefs(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS):
    """Marginals of all variables, and of all edges, by loopy message passing over one or many documents at once."""

    def spread(x):  # a log-sum-exp over the sender's labels
        top = x.max(1, keepdims=True)
        return (np.log(np.exp(x - top).sum(1, keepdims=True)) + top)[:, 0]

    n, e = len(edges), edges.astype(np.int64).reshape(-1, 3)
    send, get = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
    tables = pair[e[:, 2]] if n else np.zeros((0, *pair.shape[1:]))
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(n) + n, np.arange(n)])
    messages = np.zeros((2 * n, unary.shape[1]))
    for _ in range(rounds if n else 0):
        total = unary.copy()
        np.add.at(total, get, messages)
        new = spread((total[send] - messages[back])[:, :, None] + tables)
        new -= new.max(1, keepdims=True)
        messages = 0.5 * messages + 0.5 * new
    total = unary.copy()
    np.add.at(total, get, messages)
    both = None
    if n:
        out = total[send] - messages[back]
        both = out[:n, :, None] + tables[:n] + out[n:, None, :]
        both = np.exp(both - both.max((1, 2), keepdims=True))
        both /= both.sum((1, 2), keepdims=True)
    marginal = np.exp(total - total.max(1, keepdims=True))
    return marginal / marginal.sum(1, keepdims=True), both


@dataclass(frozen=True)
class Field:
    """Weights of the field: features by labels, and label pairs for chain and skip edges."""

    unary: np.ndarray
    pair: np.ndarray


def labels_of(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    labels = np.full(len(spans), OUTSIDE)
    for kind, start, end in reversed(base):
        for k, (a, b) in enumerate(spans):
            if a < end and start < b:
                labels[k] = kind
    return labels


def mention(kind: int, text: str) -> str:
    """Found data as it may be mentioned again: without what its pattern asks for."""
    if kind == 0:
        return text[: text.index("@") + 1] + text[text.index("@") + 1 :].split(".")[0]
    if kind == 1:
        return text.replace(".", "-")
    if kind == 2:
        return "-".join(re.findall(".{1,4}", "".join(_DIGITS.findall(text)))) + "/"
    return text.lstrip("+")


def altered(text: str, chance: random.Random) -> str:
    """The same shape with other digits, or other letters where there are few digits."""
    kind = r"[0-9]" if len(_DIGITS.findall(text)) > 3 else r"[0-9a-z]"
    return re.sub(kind, lambda m: chance.choice("0123456789" if m[0].isdigit() else "abcdefghijklmnopqrstuvwxyz"), text)


def with_mentions(text: str, base: list[tuple[int, int, int]], chance: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with a second mention of some of its data behind it, among like data that it doesn't have; the text and the mentions' spans."""
    parts, spans, at = [text, "\n"], [], len(text) + 1
    for kind, start, end in chance.sample(base, min(3, len(base))):
        again = mention(kind, text[start:end])
        for found, said in ((True, again), (False, altered(again, chance))) if chance.random() < 0.5 else ((False, altered(again, chance)), (True, again)):
            if found:
                spans.append((kind, at, at + len(said)))
            parts += [said, " and then "]
            at += len(said) + len(" and then ")
    return "".join(parts), spans


def unclear(text: str, base: list[tuple[int, int, int]]) -> bool:
    """Whether a text mentions found data again by itself: what label that has isn't known, so nothing is learnt from it."""
    if not base:
        return False
    spans = tokens_of(text)
    labels = labels_of(spans, base)
    return any(kind == 1 and (labels[a] == OUTSIDE) != (labels[b] == OUTSIDE) for a, b, kind in edges_of(text, spans))


def fit(texts: list[str], steps: int = 150) -> Field:
    """Fit to the pattern matches of some texts and to second mentions of them, by gradient ascent on the approximate likelihood."""
    shape = (len(FEATURES), len(KINDS) + 1)
    weights, pair = np.zeros(shape), np.stack([np.zeros((5, 5)), 0.5 * np.eye(5)])
    rows, labels, edges, n = [], [], [], 0
    for text in texts:
        base = base_spans(text)
        if unclear(text, base):
            continue
        chance = random.Random(zlib.crc32(text.encode()))
        text, again = with_mentions(text, base, chance) if base else (text, [])
        spans = tokens_of(text)
        if len(spans) > FIT_TOKENS:
            spans = spans[: FIT_TOKENS // 2] + spans[-FIT_TOKENS // 2 :]
        if spans:
            rows.append(features(text, spans))
            labels.append(labels_of(spans, base_spans(text) + again))
            edges += [(a + n, b + n, t) for a, b, t in edges_of(text, spans)]
            n += len(spans)
    if not rows:
        weights[0, OUTSIDE] = 5.0
        return Field(weights, pair)
    x, y, e = np.concatenate(rows).astype(np.float64), np.concatenate(labels), np.array(edges, dtype=np.int64).reshape(-1, 3)
    hot = np.eye(5)[y]
    seen = np.zeros_like(pair)
    np.add.at(seen, (e[:, 2], y[e[:, 0]], y[e[:, 1]]), 1)
    speed, fast = np.zeros(shape), np.zeros_like(pair)
    for _ in range(steps):
        marginal, both = beliefs(x @ weights, e, pair)
        up = x.T @ (hot - marginal) / len(x) - 1e-4 * weights
        speed += up**2
        weights += 0.5 * up / np.sqrt(speed + 1e-8)
        if both is not None:
            expected = np.zeros_like(pair)
            np.add.at(expected, e[:, 2], both)
            turn = (seen - expected) / len(e) - 1e-3 * pair
            turn = (turn + turn.transpose(0, 2, 1)) / 2
            fast += turn**2
            pair = pair + 0.2 * turn / np.sqrt(fast + 1e-8)
    return Field(weights, pair)


def sane(kind: int, text: str) -> bool:
    digits = len(_DIGITS.findall(text))
    if kind == 0:
        return bool(re.search(r"[^@\s]@[^@\s]", text))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?:[.-][0-9]{1,3}){3}", text))
    return 13 <= digits <= 19 if kind == 2 else 7 <= digits <= 15


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans that the field finds beside the base ones, for each text."""
    spans = [tokens_of(t) for t in texts]
    starts = np.cumsum([0] + [len(s) for s in spans])
    if not starts[-1]:
        return [[] for _ in texts]
    x = np.concatenate([features(t, s) for t, s in zip(texts, spans)])
    e = np.array([(a + k, b + k, kind) for t, s, k in zip(texts, spans, starts) for a, b, kind in edges_of(t, s)], dtype=np.int64).reshape(-1, 3)
    marginal, _ = beliefs(x @ field.unary, e, field.pair)
    best = np.where(marginal.max(1) >= SURE, marginal.argmax(1), OUTSIDE)
    along = np.where(marginal.max(1) >= ALONG, marginal.argmax(1), OUTSIDE)
    out = []
    for i, (text, own) in enumerate(zip(texts, spans)):
        new, k = [], 0
        labels, follows = best[starts[i] : starts[i + 1]], along[starts[i] : starts[i + 1]]
        while k < len(own):
            kind, last = labels[k], k
            if kind != OUTSIDE:
                while kind in (2, 3) and last + 1 < len(own) and follows[last + 1] == kind and own[last + 1][0] - own[last][1] <= 1:
                    last += 1
                start, end = own[k][0], own[last][1]
                while start < end and text[start] in _TRIM:
                    start += 1
                while end > start and text[end - 1] in _TRIM:
                    end -= 1
                if sane(kind, text[start:end]) and not any(s < end and start < t for _, s, t in base[i]):
                    new.append((int(kind), start, end))
            k = last + 1
        out.append(new)
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def fit_on(docs: DataFrame, rows: int = FIT_ROWS) -> Field:
    """Fit on the texts with candidates, of at most FIT_CHARS characters, among at most `rows` documents chosen by hash of their id."""
    ids = bounded_sample(docs.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL"), rows, "_id").distinct()
    texts = docs.select("doc_id", text_of().alias("t")).where(F.col("t").rlike("[0-9@]") & (F.length("t") <= FIT_CHARS))
    found = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("_id", "t").collect()
    return fit([r["t"] for r in sorted(found, key=lambda r: (r["_id"], r["t"]))])


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the base matches; spans holds those and what the field adds, as
    kind:start:end in code points, by kind and start. Null texts are empty and have none. Repeated rows
    and null ids give rows of their own. A scan and a projection; only the field's fit looks at a sample, which
    FIT_ROWS, FIT_CHARS and FIT_TOKENS bound.
    """
    field = field or fit_on(docs)
    rows = docs.select("doc_id", text_of().alias("text"))
    schema = StructType([rows.schema["doc_id"]])
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    none = hashlib.sha256(b"").hexdigest()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, where = [], []
            for i, t in enumerate(batch["text"]):
                t = t.as_py()
                if _HINT.search(t):
                    texts.append(t)
                    where.append(i)
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, field)
            n = batch.num_rows
            counts = np.zeros((len(KINDS), n), np.int64)
            digest, spans = [none] * n, [""] * n
            for i, own, new in zip(where, base, more):
                for kind, _, _ in own:
                    counts[kind, i] += 1
                digest[i] = hashlib.sha256(shown(own).encode()).hexdigest()
                spans[i] = shown(own + new)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, counts), pa.array(digest), pa.array(spans)], schema.fieldNames())

    return rows.mapInArrow(found, schema)
