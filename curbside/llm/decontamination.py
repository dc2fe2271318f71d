"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may appear in a document with up to k edits (``errors_allowed``). It is cut into k + 1
pieces; k edits touch k pieces at most, so one piece at least appears unchanged. An Aho-Corasick automaton finds the
pieces of many items in a document, and the stretches of text they point to are verified by Myers' bit-parallel edit
distance. An item without an error budget is one piece, and its hits need no verification.

Both sides are compared in lower case with every run of other characters than letters and digits as one space, and with
one space at each end, so that an item begins and ends where words do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import with_long_id

#: One edit for so many characters of an item.
CHARS_PER_ERROR = 20
#: The benchmark is a stated query set: it is sent to the tasks in blocks of at most so many characters.
BLOCK_CHARS = 8 << 20
#: Where there are several blocks, each is read anew for so many characters of documents.
HELD_CHARS = 48 << 20
_WORD = re.compile(r"[^\W_]+")


def normalise(text: str | None) -> str:
    """Words between single spaces, with one at each end; empty if there is no word."""
    words = _WORD.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def errors_allowed(item: str) -> int:
    """Edits that the normalised ``item`` may have; its two outer spaces do not count as characters of it."""
    return (len(item) - 2) // CHARS_PER_ERROR


def least_distance(size: int, masks: dict[str, int], text: str, limit: int) -> int | None:
    """Least edit distance of an item of ``size`` characters to any substring of ``text``; None above ``limit``."""
    full, high = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best = full, 0, size, limit + 1
    for char in text:
        equal = masks.get(char, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return best if best <= limit else None


class Items:
    """Pieces of all items of a block in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in ((i, normalise(t)) for i, t in items) if t]
        self.masks: list[dict[str, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            masks: dict[str, int] = {}
            parts = errors_allowed(text) + 1
            if parts > 1:
                for p, char in enumerate(text):
                    masks[char] = masks.get(char, 0) | 1 << p
            self.masks.append(masks)
            for j in range(parts):
                lo, hi = j * len(text) // parts, (j + 1) * len(text) // parts
                pieces.setdefault(text[lo:hi], []).append((k, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, int]:
        """Smallest distance by item_id of every item in the normalised ``text``."""
        exact: set[int] = set()
        near: dict[int, list[int]] = {}  # where items may start
        if text and len(self.automaton):
            for end, (length, places) in self.automaton.iter(text):
                for k, offset in places:
                    if self.masks[k]:
                        near.setdefault(k, []).append(end + 1 - length - offset)
                    else:
                        exact.add(k)
        found: dict[int, int] = {}

        def keep(k: int, distance: int) -> None:
            key = self.items[k][0]
            found[key] = min(distance, found.get(key, distance))

        for k in exact:
            keep(k, 0)
        for k, starts in near.items():
            item = self.items[k][1]
            limit = errors_allowed(item)
            reach = len(item) + limit
            starts = sorted(set(starts))
            at = 0
            while at < len(starts):  # stretches that overlap are read once
                lo, hi = max(0, starts[at] - limit), starts[at] + reach
                while at < len(starts) and starts[at] - limit <= hi:
                    hi = starts[at] + reach
                    at += 1
                if (distance := least_distance(len(item), self.masks[k], text[lo : max(0, hi)], limit)) is not None:
                    keep(k, distance)
                    if not distance:
                        break
        return found


def _blocks(benchmark: DataFrame, block_chars: int) -> list[Broadcast]:
    """The query set sent in blocks of bounded size. The driver's Python holds one block at a time."""
    session = benchmark.sparkSession.sparkContext
    sent: list[Broadcast] = []
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().toLocalIterator():
        if block and size + len(row["text"]) > block_chars:
            sent.append(session.broadcast(block))
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    return [*sent, session.broadcast(block)] if block else sent


def _searcher(sent: list[Broadcast]) -> Callable[[list[str]], list[dict[int, int]]]:
    """A function from texts to their items. One block is kept as an automaton, of several one at a time is built."""
    kept = Items(sent[0].value) if len(sent) == 1 else None

    def search(texts: list[str]) -> list[dict[int, int]]:
        found: list[dict[int, int]] = [{} for _ in texts]
        for block in sent:
            items = kept or Items(block.value)
            for own, text in zip(found, texts, strict=True):
                for key, distance in items.matches(text).items():
                    own[key] = min(distance, own.get(key, distance))
        return found

    return search


def _held(batches: Iterator[tuple], chars: int) -> Iterator[list[tuple]]:
    """Batches (anything, normalised texts), as many together as hold ``chars`` characters."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(map(len, batch[1]))
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each contaminated row of ``docs`` (doc_id, text, ...): doc_id, contaminated (true), item_ids (sorted),
    distances (edits of each), n_items. Clean documents give no row.

    ``benchmark`` (item_id, text, ...) may hold nulls and items without a word, which match nothing, and repeated rows;
    of several texts under one item_id the nearest counts. A null or empty text is clean. Texts are searched whole, the
    shortest items included. Either table may be empty; repeated documents appear again, with or without a doc_id.
    Documents are read once, however many blocks the benchmark has. Other columns are ignored.
    """
    sent = _blocks(benchmark, block_chars)
    held_chars = HELD_CHARS if len(sent) > 1 else 0

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _searcher(sent)
        batches = ((frame["doc_id"], [normalise(t) for t in frame["text"]]) for frame in frames)
        for held in _held(batches, held_chars):
            ids = [i for own, _ in held for i in own]
            found = find([t for _, texts in held for t in texts])
            rows = [(i, sorted(m.items())) for i, m in zip(ids, found, strict=True) if m]
            if rows:
                yield pd.DataFrame(
                    {
                        "doc_id": [i for i, _ in rows],
                        "item_ids": [[i for i, _ in m] for _, m in rows],
                        "distances": [[d for _, d in m] for _, m in rows],
                    }
                )

    found = with_long_id(docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(search, "doc_id string, item_ids array<long>, distances array<int>"))
    return found.select("doc_id", F.lit(True).alias("contaminated"), "item_ids", "distances", F.size("item_ids").cast("long").alias("n_items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` (text, ...), all columns, whose text holds no test item.

    Nulls, empty and long texts, items and tables as in :func:`contaminated`; repeated rows stay or go together, and no
    column is added, so none can clash.
    """
    sent = _blocks(benchmark, block_chars)
    if not sent:
        return docs
    held_chars = HELD_CHARS if len(sent) > 1 else 0

    @F.pandas_udf("boolean")
    def clean(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _searcher(sent)
        for held in _held(((None, [normalise(t) for t in own]) for own in series), held_chars):
            for _, texts in held if len(held) == 1 else [(None, [t for _, texts in held for t in texts])]:
                yield pd.Series([not m for m in find(texts)], dtype=bool)

    return docs.filter(clean(F.col("text").cast("string")))
