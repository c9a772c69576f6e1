"""Encoding and decoding with a sentencepiece BPE vocabulary (operator 3).

The encoder never simulates merges over a text. It keeps, for every prefix of a segment, the one token that ends the encoding of that
prefix. That token is unique: a sequence of tokens is an encoding exactly if every two neighbours are
the encoding of their own concatenation, since merges on both sides of a boundary do not
depend on what lies further off. So for each position the candidates are the pieces that an automaton
finds ending there, and the right one is the candidate compatible with the last token of the prefix before it. The ids are then read
backwards from the end. The work is linear in the text for a bounded piece length, for words of any length.

Compatibility of two pieces is tested once, by merging their concatenation, and remembered.

Segments: where no piece holds a space mark behind another character, no token crosses the start of a
run of space marks, so a text may be cut there; the same for characters that no longer piece contains, such as line
feeds. Encodings of short segments are remembered, up to a fixed number.

Characters outside the vocabulary become byte pieces. Decoding joins pieces, turns space marks into
spaces, drops the one space that encoding put in front, and reads runs of byte pieces as UTF-8 with U+FFFD for
bytes that are not.

Cases: null counts as the empty text, which has no ids. Repeated rows are encoded each. Other columns are not looked at.
The model file's path is a parameter; it is read on each worker, and on the driver if it is not there a worker fails with the library's own error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
_SHORT = 48
_CACHED_SEGMENTS = 200_000
_CACHED_PAIRS = 1_000_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE, _UNUSED = 1, 2, 3, 4, 6, 5


class Pieces:
    """The vocabulary and the tables built from it."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces:
            raise ValueError("only BPE vocabularies without text normalisation are supported")
        if any(p.type in (_USER, _UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if not {c for p in model.pieces if p.type == _NORMAL for c in p.piece} <= {p.piece for p in model.pieces if p.type == _NORMAL}:
            raise ValueError("every character of a piece has to be a piece")
        self.text = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.lengths = [len(p) for p in self.text]
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        if self.unknown != 0:
            raise ValueError("the unknown piece has to be the first")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.segments = self._segmenter()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[str, int, str]] = {}

    def _segmenter(self) -> re.Pattern:
        longer = [p for p in self.score if len(p) > 1]
        inside = set("".join(longer))
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inside)
        if any(MARK in p.lstrip(MARK) for p in longer):
            return re.compile(f"[^{alone}]+|[{alone}]" if alone else "(?s:.+)")
        other = f"[^{MARK}{alone}]"
        return re.compile(f"{MARK}+{other}*|{other}+" + (f"|[{alone}]" if alone else ""))

    def compatible(self, left: str, right: str) -> bool:
        """True if the encoding of ``left + right`` by merging, best score first and leftmost on ties, is those two pieces.

        It ends at the first merge across the boundary.
        """
        parts = [*left, *right]
        border = len(left)  # index of the first part of the right piece
        score = self.score
        none = float("-inf")
        gains = [score.get(x + y, none) for x, y in zip(parts, parts[1:])]
        while gains:
            best = max(gains)
            if best == none:
                break
            i = gains.index(best)
            if i == border - 1:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            border -= i < border
            if i:
                gains[i - 1] = score.get(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = score.get(parts[i] + parts[i + 1], none)
        return len(parts) == (2 if left else 1)

    def tokens(self, segment: str) -> list[int]:
        """The piece ids of a segment, by the table of last tokens; -1 for a character outside the vocabulary.

        Matches that end at one place come longest first. Id 0, the unknown piece, stands for the start and for
        characters outside: nothing merges across either.
        """
        n = len(segment)
        last, pairs, lengths, text = [0] * (n + 1), self.pairs, self.lengths, self.text
        for stop, piece in self.automaton.iter(segment):
            at = stop + 1
            if last[at]:
                continue
            before = last[at - lengths[piece]]
            key = before << 20 | piece
            fits = pairs.get(key)
            if fits is None:
                if len(pairs) >= _CACHED_PAIRS:
                    pairs.clear()
                fits = pairs[key] = self.compatible(text[before] if before else "", text[piece])
            if fits:
                last[at] = piece
        out = []
        while n:
            piece = last[n]
            out.append(piece or -1)
            n -= lengths[piece] if piece else 1
        return out[::-1]

    def ids_of(self, segment: str) -> list[int]:
        """Ids of a segment, with byte pieces, or one unknown id for a run, where the vocabulary has no piece."""
        tokens = self.tokens(segment)
        if -1 not in tokens:
            return tokens
        ids: list[int] = []
        at = 0
        for piece in tokens:
            size = self.lengths[piece] if piece >= 0 else 1
            if piece >= 0:
                ids.append(piece)
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in segment[at : at + 1].encode("utf-8"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            at += size
        return ids

    def marked(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for segment in self.segments.findall(self.marked(text or "")):
            ids += self.ids_of(segment)
        return ids

    def _joined(self, ids: list[int]) -> str:
        """Pieces and byte runs as text, with marks turned into spaces."""
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i < 0 or self.kind[i] == _CONTROL:
                continue
            out.append(" ⁇ " if self.kind[i] == _UNKNOWN else self.text[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the space that encoding puts in front."""
        first = next((i for i in ids if self.kind[i] != _CONTROL), None)
        text = self._joined(ids)
        starts = first is not None and self.kind[first] == _NORMAL and self.text[first].startswith(MARK)
        return text[1:] if starts else text

    def digest_parts(self, text: str) -> tuple[list[str], int, list[str]]:
        """Ids joined by commas and decoded text, segment by segment, and the number of ids."""
        ids, plain, count, known = [], [], 0, self.known
        for segment in self.segments.findall(self.marked(text)):
            found = known.get(segment)
            if found is None:
                own = self.ids_of(segment)
                found = (",".join(map(str, own)), len(own), self._joined(own))
                if len(segment) <= _SHORT:
                    if len(known) >= _CACHED_SEGMENTS:
                        known.clear()
                    known[segment] = found
            ids.append(found[0])
            count += found[1]
            plain.append(found[2])
        return ids, count, plain


def _utf8(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is not part of a character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The tables of a model file, built once in each Python worker."""
    return Pieces(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids and the text decoded from them."""
    picked = docs.select(id_col, text_col)
    kind = picked.schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            ids = [p.encode(t) for t in b.column(1).to_pylist()]
            plain = [p.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(plain, pa.string())],
                names=[id_col, "ids", "decoded"],
            )

    return picked.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and the SHA-256 of the ids and of the decoded text.

    The same tables as ``encode_texts``; ids and text of a segment are looked up together, and only digests leave the worker.
    """
    from hashlib import sha256

    picked = docs.select(id_col, text_col)
    kind = picked.schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            counts, of_ids, of_text = [], [], []
            for t in b.column(1).to_pylist():
                ids, count, plain = p.digest_parts(t or "")
                text = "".join(plain)
                counts.append(count)
                of_ids.append(sha256(",".join(ids).encode()).hexdigest())
                of_text.append(sha256((text[1:] if text.startswith(" ") else text).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
