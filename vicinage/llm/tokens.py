"""Token counts by byte-pair merging with a heap and a linked list, without making identifiers.

The count of a piece is its number of initial symbols less the number of merges: of all adjacent pairs
with a merge rule the one of lowest rank (leftmost among equals) is merged until none is left.
"""

from __future__ import annotations

import heapq
import json
import re

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vicinage.llm.tables import text_of

#: Above this code point the regex module and the tokenizers library may class a character differently.
PLAIN_BELOW = 0x530
#: Chunks that a worker remembers; when full, it starts anew.
REMEMBERED = 700_000
LONGEST_REMEMBERED = 64

DOUBLE_SPACE = regex.compile(r"\s\s")
LONE_SPACE = regex.compile(r"(?<=\S) (?=\S)")
BEYOND_PLAIN = re.compile(f"[^\\x00-{chr(PLAIN_BELOW - 1)}]")


def chunks_of(text: str) -> list[str]:
    """Split at every single space between other characters.

    No token of a byte-level model spans such a place: the space starts the piece that follows. All
    chunks but the first are meant with that space before them.
    """
    return LONE_SPACE.split(text) if DOUBLE_SPACE.search(text) else text.split(" ")


class MergeCounter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file (.json)."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normalizer is asked for")
        vocab = spec["model"]["vocab"]
        if max(vocab.values()) >= 1 << 17:
            raise ValueError("a vocabulary of at most 131,072 symbols is asked for: a rule is packed in two times 17 bits")
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.symbol = vocab  # of a byte as the file writes it
        self.byte = [vocab[self.pre_tokenizer.pre_tokenize_str(chr(b))[0][0]] if b < 128 else 0 for b in range(256)]
        for b in range(128, 256):  # the second byte of a two-byte character, or the first
            char = bytes([0xC3, b]) if b < 0xC0 else bytes([b, 0xA9]) if 0xC2 <= b < 0xE0 else None
            if char:
                self.byte[b] = vocab[self.pre_tokenizer.pre_tokenize_str(char.decode())[0][0][int(b < 0xC0)]]
        merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merges[vocab[left] << 17 | vocab[right]] = rank << 17 | vocab[left + right]
        self.rule = merges.get
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.short: dict[str, int] = {}

    def merged(self, symbols: list[int]) -> int:
        """Tokens that stay of the symbols of one piece. The list is used up.

        A rule is one number, rank << 17 | symbol made; a heap entry is that number << 26 | position.
        An entry whose rule isn't the one noted for its position any more is stale.
        """
        left = len(symbols)
        if left > 1 << 26:
            raise ValueError("a piece without a break is longer than 67 million bytes: its positions are packed in 26 bits")
        rule, pop, push = self.rule, heapq.heappop, heapq.heappush
        noted = [rule(a << 17 | b, 0) for a, b in zip(symbols, symbols[1:])]
        heap = [v << 26 | i for i, v in enumerate(noted) if v]
        if not heap:
            return left
        heapq.heapify(heap)
        noted.append(0)
        end = left
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while heap:
            item = pop(heap)
            i = item & 0x3FFFFFF
            v = item >> 26
            if noted[i] != v:
                continue
            symbol = symbols[i] = v & 0x1FFFF
            left -= 1
            gone = after[i]
            noted[gone] = 0
            right = after[i] = after[gone]
            if right < end:
                before[right] = i
                v = noted[i] = rule(symbol << 17 | symbols[right], 0)
                if v:
                    push(heap, v << 26 | i)
            else:
                noted[i] = 0
            prior = before[i]
            if prior >= 0:
                v = noted[prior] = rule(symbols[prior] << 17 | symbol, 0)
                if v:
                    push(heap, v << 26 | prior)
        return left

    def piece(self, piece: str) -> int:
        """Tokens of one piece, an ASCII or Latin word or run of signs."""
        count = self.short.get(piece)
        if count is None:
            byte = self.byte
            count = self.merged([byte[b] for b in piece.encode()])
            if len(piece) <= LONGEST_REMEMBERED:
                if len(self.short) >= REMEMBERED:
                    self.short.clear()
                self.short[piece] = count
        return count

    def chunk(self, chunk: str) -> int:
        """Tokens of a chunk, a leading space included."""
        if BEYOND_PLAIN.search(chunk):
            pieces = self.pre_tokenizer.pre_tokenize_str(chunk)
            return sum(self.merged([self.symbol[c] for c in p]) for p, _ in pieces)
        return sum(map(self.piece, self.pieces(chunk)))

    def looked_up(self, chunk: str, known: dict[str, int], lead: str) -> int:
        count = known.get(chunk)
        if count is None:
            count = self.chunk(lead + chunk)
            if len(chunk) <= LONGEST_REMEMBERED:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[chunk] = count
        return count

    def plain(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        chunks = chunks_of(text)
        total = self.looked_up(chunks[0], self.first, "")
        del chunks[0]
        counts = list(map(self.later.get, chunks))
        if None in counts:
            counts = [self.looked_up(c, self.later, " ") if n is None else n for c, n in zip(chunks, counts)]
        return total + sum(counts)

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special token's string in it is one."""
        if not text:
            return 0
        if self.special is None or "<|" not in text and not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter a worker process and file; it keeps what it has learnt from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of a text column under the tokenizer file at path, as known on the executors."""

    @F.pandas_udf(LongType())
    def counted(texts: pd.Series) -> pd.Series:
        count = counter(path).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: no bytes, no tokens. Rows are independent: repeated rows and null ids
    give rows of their own, other columns are not read, an empty table gives no rows. A scan and a
    projection, without a shuffle.
    """
    rows = docs.select("doc_id", text_of().alias("_text"))
    rows = rows.select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), token_count(F.col("_text"), path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
