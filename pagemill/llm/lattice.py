"""Forward and backward recursions over all segmentations of words into vocabulary pieces."""

from __future__ import annotations

import numpy as np

MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words up to this length go through arrays, many at once; longer ones one by one.
_WIDE = 64
_BLOCK = 400_000


class Lattice:
    """Pieces of a vocabulary with their log scores (natural logarithm).

    A character that is no piece is spelled in bytes, each at ``byte_score``, so every word has a segmentation. ``scores`` may be
    replaced; the tables of pieces stay.
    """

    def __init__(self, pieces: list[str], scores: np.ndarray, byte_score: float) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.index = {p: i for i, p in enumerate(pieces)}
        hashes = np.array([_hash(p) for p in pieces], dtype=np.uint64)
        self._order = np.argsort(hashes)
        self._hashes = hashes[self._order]
        self._powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], dtype=np.uint64)
        self.set_scores(scores, byte_score)

    def set_scores(self, scores: np.ndarray, byte_score: float) -> None:
        self.scores = np.append(scores, -np.inf)
        self.byte_score = byte_score

    def _found(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; the number of pieces where there is none."""
        at = np.minimum(np.searchsorted(self._hashes, h), len(self._hashes) - 1)
        return np.where(self._hashes[at] == h, self._order[at], len(self.pieces))

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, over all its segmentations."""
        return self._run(words, None)[0]

    def expected(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected uses of every piece, and of bytes, in words that occur ``counts`` times."""
        return self._run(words, counts)[1:]

    def _run(self, words, counts):
        total = np.zeros(len(words))
        uses, in_bytes = np.zeros(len(self.pieces) + 1), 0.0
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, edges) if len(words) else []:
            size = int(lengths[same[0]])
            if size > _WIDE:
                for w in same:
                    own = self._long(words[w], None if counts is None else float(counts[w]), uses)
                    total[w] = own[0]
                    in_bytes += own[1]
                continue
            step = max(1, _BLOCK // max(1, size))
            for lo in range(0, len(same), step):
                block = same[lo : lo + step]
                text = "".join([words[w] for w in block])
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(block), size)
                own = self._block(codes, None if counts is None else counts[block], uses)
                total[block] = own[0]
                in_bytes += own[1]
        return total, uses[:-1], in_bytes

    def _block(self, codes: np.ndarray, counts: np.ndarray | None, uses: np.ndarray):
        n, size = codes.shape
        prefix = np.zeros((size + 1, n), dtype=np.uint64)
        for k in range(size):
            prefix[k + 1] = prefix[k] * _BASE + codes[:, k] + np.uint64(1)
        width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
        forward = np.zeros((size + 1, n))
        arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        none = len(self.pieces)
        for j in range(1, size + 1):
            terms = []
            for i in range(max(0, j - self.longest), j):
                piece = self._found(prefix[j] - prefix[i] * self._powers[j - i])
                score = self.scores[piece]
                if i == j - 1:
                    score = np.where(piece == none, width[:, i] * self.byte_score, score)
                elif (piece == none).all():
                    continue
                terms.append(forward[i] + score)
                if counts is not None:
                    arcs.append((i, j, piece, score))
            forward[j] = _log_sum(terms)
        if counts is None:
            return forward[size], 0.0
        backward = np.full((size + 1, n), -np.inf)
        backward[size] = 0.0
        by_start: list[list] = [[] for _ in range(size)]
        for i, j, _, score in arcs:
            by_start[i].append((j, score))
        for i in range(size - 1, -1, -1):
            backward[i] = _log_sum([score + backward[j] for j, score in by_start[i]])
        in_bytes = 0.0
        for i, j, piece, score in arcs:
            use = counts * np.exp(forward[i] + score + backward[j] - forward[size])
            uses += np.bincount(piece, use, minlength=none + 1)
            if i == j - 1:
                lost = piece == none
                in_bytes += float((use * width[:, i])[lost].sum())
        return forward[size], in_bytes

    def _long(self, word: str, count: float | None, uses: np.ndarray) -> tuple[float, float]:
        n = len(word)
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        scores, index = self.scores, self.index

        def arc(i: int, j: int) -> tuple[int | None, float | None]:
            piece = index.get(word[i:j])
            if piece is not None:
                return piece, float(scores[piece])
            return None, (len(word[i].encode("utf-8", "surrogatepass")) * self.byte_score if j == i + 1 else None)

        for j in range(1, n + 1):
            terms = [(forward[i] + s) for i in range(max(0, j - self.longest), j) if (s := arc(i, j)[1]) is not None]
            forward[j] = float(np.logaddexp.reduce(terms))
        in_bytes = 0.0
        if count is not None:
            for i in range(n - 1, -1, -1):
                terms = []
                for j in range(i + 1, min(n, i + self.longest) + 1):
                    piece, s = arc(i, j)
                    if s is None:
                        continue
                    terms.append(s + backward[j])
                    use = count * float(np.exp(forward[i] + s + backward[j] - forward[n]))
                    if piece is None:
                        in_bytes += use * len(word[i].encode("utf-8", "surrogatepass"))
                    else:
                        uses[piece] += use
                backward[i] = float(np.logaddexp.reduce(terms))
        return forward[n], in_bytes


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    stack = np.stack(terms)
    top = stack.max(axis=0)
    return top + np.log(np.exp(stack - top).sum(axis=0))


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h
