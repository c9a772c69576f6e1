"""Token counts with a byte-level BPE vocabulary by the whole-token shortcut (operator 12).

A text is split at special tokens and then into pre-tokens. Most pre-tokens are themselves vocabulary strings, and for most of these the
merges lead to exactly that one token. Which strings these are is proved once, by merging every string of the vocabulary alone: since nothing merges
across the border of a pre-token, a pre-token equal to such a string is one token wherever it stands. Pre-tokens found in this table count
one; the merges are run for the rest only, and counts of short pre-tokens are remembered, up to a fixed number.

The table has at most as many strings as the vocabulary, so sending it to the tasks is bounded whatever the input. Texts stay where they were
read: there is no shuffle.

Merging keeps the neighbouring pairs in a heap, so a pre-token of a million characters takes n log n steps.

Letters, numbers and spaces are those of the library's Unicode version: where the tables at hand disagree about a character, the library is asked
once for each of them when a worker starts.

Cases: null counts as the empty text, which has no tokens. Repeated rows are counted each, ids may be null or repeat, other columns are not looked
at, an empty table gives an empty result. Special strings inside texts are special tokens, as the library has it by default.
The vocabulary's path is a parameter and is read on the driver and on each worker. Vocabularies with a normaliser, a prefix space or special tokens that strip their
surroundings are refused.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
#: How byte-level pre-tokens are told apart.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII text.
ASCII_PRE_TOKENS = PRE_TOKENS.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")
_SHORT = 40
_KEPT_LENGTH = 64
_KEPT_COUNTS = 600_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next free code from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = sorted(set(range(256)) - shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merges:
    """The merge rules of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec.get("normalizer"):
            raise ValueError("only BPE vocabularies without normaliser are supported")
        if split["type"] != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level pre-tokens without prefix space are supported")
        added = spec.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special tokens that look at their surroundings are not supported")
        self.specials = sorted((t["content"] for t in added), key=len, reverse=True)
        self.letters = byte_letters()
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.rank = {pair: k for k, pair in enumerate(pairs)}

    def tokens(self, text: str) -> list[str]:
        """The tokens of one pre-token: pairs are merged by rank, the leftmost first among equals."""
        parts = [self.letters[b] for b in text.encode("utf-8")]
        return self._short(parts) if len(parts) <= _SHORT else self._long(parts)

    def _short(self, parts: list[str]) -> list[str]:
        rank, none = self.rank, len(self.rank)
        ranks = [rank.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), none)
        return parts

    def _long(self, parts: list[str | None]) -> list[str]:
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i, j = heappop(heap)
            if parts[i] is None or after[i] != j or j >= n or rank.get((parts[i], parts[j])) != r:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get((parts[a], parts[b]))) is not None:
                    heappush(heap, (r, a, b))
        return [p for p in parts if p is not None]

    def whole(self) -> frozenset[str]:
        """The strings of the vocabulary that merge to one token: the proof that each may be counted without merging."""
        byte_of = {c: b for b, c in self.letters.items()}
        found = set()
        for token in self.vocab:
            try:
                text = bytes(byte_of[c] for c in token).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if self.tokens(text) == [token]:
                found.add(text)
        return frozenset(found)


def disputed(path: str) -> str:
    """The characters that are letters or numbers for the pattern but not for the library, as text.

    Asked are the characters that two tables of different Unicode versions class differently.
    """
    from tokenizers import Tokenizer

    splits = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    asked = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c)[0] not in "LN"]
    return "".join(c for c in asked if len(splits(f"!{c}")) == 1)


def _ranges(chars: str) -> Iterator[str]:
    """Sorted characters as ranges of a character class."""
    start = 0
    for k in range(1, len(chars) + 1):
        if k == len(chars) or ord(chars[k]) != ord(chars[k - 1]) + 1:
            yield f"{regex.escape(chars[start])}-{regex.escape(chars[k - 1])}"
            start = k


class Counts(dict):
    """Tokens of a pre-token; whole tokens are there from the start."""

    def __init__(self, merges: Merges, whole: frozenset[str]) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.merges, self.whole = merges, whole

    def __missing__(self, pre_token: str) -> int:
        n = len(self.merges.tokens(pre_token))
        if len(pre_token) <= _KEPT_LENGTH:
            if len(self) >= len(self.whole) + _KEPT_COUNTS:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[pre_token] = n
        return n


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        merges = Merges(path)
        self.counts = Counts(merges, whole)
        self.pre_tokens = regex.compile(PRE_TOKENS)
        self.ascii_pre_tokens = re.compile(ASCII_PRE_TOKENS, re.ASCII)
        self.special = regex.compile("|".join(map(regex.escape, merges.specials))) if merges.specials else None
        others = disputed(path)
        self.others = regex.compile(f"[{''.join(_ranges(others))}]") if others else None
        self.from_others = re.compile(f"[{min(others)}-{chr(sys.maxunicode)}]") if others else None

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if text.isascii():
            return self.ascii_pre_tokens.findall(text)
        if not self.others or not self.from_others.search(text) or not self.others.search(text):
            return self.pre_tokens.findall(text)
        # A private-use character is neither letter, number nor space for any version.
        plain = self.others.sub("\ue000", text)
        return [text[m.start() : m.end()] for m in self.pre_tokens.finditer(plain)]

    def __call__(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            total += sum(map(self.counts.__getitem__, self.pieces(part)))
        return total


@lru_cache(maxsize=2)
def proved(path: str) -> frozenset[str]:
    """The whole tokens of a vocabulary file, proved once in a process."""
    return Merges(path).whole()


@lru_cache(maxsize=2)
def _counter(path: str, whole: frozenset[str]) -> Counter:
    return Counter(path, whole)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.col(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("t"))
    kind = picked.schema.fields[0].dataType.simpleString()
    whole = docs.sparkSession.sparkContext.broadcast(proved(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, whole.value)
        for b in batches:
            n = pa.array([count(t) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=[id_col, "n_bytes", "n_tokens"])

    counted = picked.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
