"""A SentencePiece vocabulary read as a unigram model: matches, forced cuts and best paths.

A unigram segmentation is the path of vocabulary pieces with the highest sum of scores. Scores of the public model are
whole numbers, so sums are exact. Tie rules are the tokenizer's own: of equal paths to a position the one whose last
piece starts earliest wins; a character that is no piece by itself may be covered by one unknown, which costs ten more
than the worst piece and is written as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import sentencepiece

SPACE = "▁"
UNKNOWN_PENALTY = 10
NEVER = -(1 << 60)


class Vocabulary:
    """Pieces of a model file, found in texts by an Aho-Corasick automaton."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        self.surface: list[bytes] = []  # what each id decodes to
        scores = {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.surface.append(b"")
            else:
                self.ids[piece] = k
                self.surface.append(piece.replace(SPACE, " ").encode())
                scores[piece] = model.get_score(k)
        if any(s != int(s) for s in scores.values()):
            raise ValueError("scores must be whole numbers, so that sums are exact")
        self.longest = max(map(len, self.ids))
        self.singles = {p for p in self.ids if len(p) == 1}
        self.unknown = int(min(scores.values())) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), int(score), self.ids[piece]))
        self.automaton.make_automaton()
        # No piece holds a space mark after another character: every path is cut before a mark that follows one.
        spaced = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if spaced else r"(?s).+")
        self.cut = re.compile(f"(?<=[^{SPACE}])(?={SPACE})") if spaced else re.compile(r"(?!)")

        #: Neighbouring characters within pieces: between any others every path is cut.
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}

    def parts(self, segment: str) -> list[str]:
        """``segment`` cut wherever no piece holds both characters."""
        joined, out, at = self.joined, [], 0
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in joined:
                out.append(segment[at:k])
                at = k
        return [*out, segment[at:]]

    @staticmethod
    def escaped(text: str | None) -> str:
        """The text as the model sees it: a leading space mark, and marks for spaces."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def forward(self, text: str, start: int, limit: int) -> tuple[list[int], list[int], list[int]]:
        """Best scores, first characters and ids (-1: unknown) of the last piece, for paths from ``start``.

        Pieces start before ``limit``; a path may end past it, as far as the longest piece.
        """
        size = len(text)
        best, begin, last = [NEVER] * (size + 1), [-1] * (size + 1), [-1] * (size + 1)
        best[start] = 0
        covered, ids = start, self.ids

        def unknowns(until: int) -> None:
            """A character that no piece covers alone may follow whatever ends before it."""
            nonlocal covered
            while covered < until:
                at, covered = covered, covered + 1
                if at < limit and best[at] > NEVER and text[at] not in ids and best[at] + self.unknown > best[at + 1]:
                    best[at + 1], begin[at + 1], last[at + 1] = best[at] + self.unknown, at, -1

        for end, (length, score, piece) in self.automaton.iter(text, start):
            at = end + 1 - length
            if at < start or at >= limit:
                continue
            unknowns(end)  # all paths to positions before this end are settled
            if best[at] > NEVER and best[at] + score > best[end + 1]:
                best[end + 1], begin[end + 1], last[end + 1] = best[at] + score, at, piece
        unknowns(min(limit, size))
        return best, begin, last

    def trace(self, text: str, end: int, start: int, begin: list[int], last: list[int]) -> list[int]:
        """Ids of the best path from ``start`` to ``end``."""
        out: list[int] = []
        while end > start:
            at = begin[end]
            if last[end] >= 0:
                out.append(last[end])
            else:
                out.extend(self.bytes[b] for b in reversed(text[at].encode("utf-8", "surrogatepass")))
            end = at
        return out[::-1]

    def segment(self, text: str) -> tuple[int, list[int]]:
        """Best score and ids of one segment."""
        size = len(text)
        if not self.singles.issuperset(text):
            best, begin, last = self.forward(text, 0, size)
            return best[size], self.trace(text, size, 0, begin, last)
        # Every character is a piece, so every position is reached and no unknown is needed.
        best, begin, last = [0] + [NEVER] * size, [0] * (size + 1), [0] * (size + 1)
        for end, (length, score, piece) in self.automaton.iter(text):
            end += 1
            score += best[end - length]
            if score > best[end]:
                best[end], begin[end], last[end] = score, end - length, piece
        out, end = [], size
        while end:
            out.append(last[end])
            end = begin[end]
        return best[size], out[::-1]


@lru_cache(maxsize=4)
def vocabulary(model_file: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(model_file)


class Memo(dict):
    """Results by segment. Words repeat, so few are worked out twice.

    At most twice ``size`` results are held: when the table is full it becomes the old one, and what is asked again
    comes back from there, so that frequent words stay.
    """

    def __init__(self, compute, size: int = 250_000):
        super().__init__()
        self._compute, self._size, self._old = compute, size, {}

    def __missing__(self, key: str):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        if len(key) <= 64:
            if len(self) >= self._size:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value
