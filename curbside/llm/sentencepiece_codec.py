"""SentencePiece encoding and decoding of whole texts; giant texts by a max-plus parallel scan over chunks.

A text longer than a chunk is cut at fixed positions. A piece may cross a cut, so a chunk is a linear map over the
max-plus semiring: entry state a (how many of its first characters the piece before has taken) and exit state b (how
many characters past its end its last piece takes) give the best score M[a][b]. Such maps combine associatively. The
scan works on rows of Spark, one for each chunk, in groups of at most FAN_IN:

1. every chunk gives its transfer matrix, on its own;
2. going up, the matrices of each group are multiplied to one matrix; so are those, until a text has FAN_IN
   matrices at most;
3. going down, the states at both ends of a group give the states at the ends of its members, from those of the whole
   text (0 at both ends) to those of every chunk;
4. every chunk is traced back on its own between its two states.

Equal scores: of two paths into the same exit state the tokenizer keeps the one whose pieces, read from the right,
start earlier. So a matrix carries, for each exit state, the order of the entries by that rule; the product of two
orders compares by the right factor first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import with_long_id
from curbside.llm.pieces import NEVER, SPACE, Memo, Vocabulary, vocabulary
from curbside.llm.token_counts import MODEL_FILE

CHUNK_CHARS = 32_768
#: Matrices of one group; with LEVELS levels of groups a text may have FAN_IN ** LEVELS chunks, more than a string can hold.
FAN_IN, LEVELS = 64, 3
#: Segments, and parts of them, whose ids a worker remembers; at times twice as many. More save time and take memory.
REMEMBERED = (250_000, 100_000)
Maps = tuple[np.ndarray, np.ndarray]  # best scores and, by exit state, the rank of each entry among equals


def _packed(words: Vocabulary, remembered: tuple[int, int] = REMEMBERED) -> Memo:
    """Ids by segment. A segment met for the first time is put together from the parts that no piece crosses."""
    parts = Memo(lambda part: np.array(words.segment(part)[1], "<i4").tobytes(), remembered[1])
    return Memo(lambda segment: b"".join(map(parts.__getitem__, words.parts(segment))), remembered[0])


@lru_cache(maxsize=2)
def packed_memo(model_file: str, remembered: tuple[int, int] = REMEMBERED) -> Memo:
    """Ids by segment, kept for all tasks of a Python worker."""
    return _packed(vocabulary(model_file), remembered)


def encode(words: Vocabulary, memo: Memo, text: str | None) -> bytes:
    """Ids of a text that fits a chunk, as little-endian 32-bit integers."""
    return b"".join(map(memo.__getitem__, words.segments.findall(words.escaped(text))))


def surface(words: Vocabulary, ids: np.ndarray) -> bytes:
    """What ``ids`` stand for, with spaces for marks."""
    return b"".join(map(words.surface.__getitem__, ids.tolist()))


def decode(words: Vocabulary, ids: np.ndarray) -> str:
    """The text of ``ids``: spaces for marks, without the leading one, and bytes joined to characters."""
    joined = surface(words, ids)
    return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


def transfer(words: Vocabulary, memo: Memo, text: str, size: int) -> Maps:
    """Matrix of best scores and, by exit state, the rank of each entry among equals. ``text`` reaches past ``size``.

    ``memo`` holds best scores by segment.
    """
    states = words.longest
    scores = np.full((states, states), NEVER, np.int64)
    ranks = np.zeros((states, states), np.int64)
    cuts = [m.start() for m in words.cut.finditer(text, 0, size) if m.start() > 0]
    first, last = (cuts[0], cuts[-1]) if cuts else (size, 0)
    masks: dict[int, list[int]] = {}
    exits: list[tuple[int, int]] = []
    if cuts:  # all paths meet at the first cut and leave from the last
        middle = sum(map(memo.__getitem__, words.segments.findall(text[first:last])))
        best, _, _ = words.forward(text[last:], 0, size - last)
        exits = [(b, middle + best[size - last + b]) for b in range(states) if size - last + b < len(best) and best[size - last + b] > NEVER]
    for a in range(min(states, first + 1)):
        if cuts:
            best, begin, _ = words.forward(text[:first], a, first)
            found = [(b, best[first] + s, first) for b, s in exits] if best[first] > NEVER else []
        else:
            best, begin, _ = words.forward(text, a, size)
            found = [(b, best[size + b], size + b) for b in range(states) if size + b < len(best) and best[size + b] > NEVER]
        for b, score, end in found:
            scores[a, b] = score
            mask = 1 << end  # where pieces meet; later characters weigh more
            while end > a:
                end = begin[end]
                mask |= 1 << end
            masks.setdefault(b, [0] * states)[a] = mask
    for b, of in masks.items():
        ranks[:, b] = np.argsort(np.argsort(np.array(of, dtype=object), kind="stable"), kind="stable")
    return scores, ranks


def trace_chunk(words: Vocabulary, memo: Memo, text: str, size: int, enter: int, leave: int) -> bytes:
    """Ids of a chunk between two states. ``memo`` holds ids by segment; only both ends need a pass of their own."""

    def between(text: str, start: int, size: int, end: int) -> bytes:
        _, begin, last = words.forward(text, start, size)
        return np.array(words.trace(text, end, start, begin, last), "<i4").tobytes()

    cuts = [m.start() for m in words.cut.finditer(text, 0, size) if m.start() > 0]
    if not cuts:
        return between(text, enter, size, size + leave)
    middle = b"".join(map(memo.__getitem__, words.segments.findall(text[cuts[0] : cuts[-1]])))
    return between(text[: cuts[0]], enter, cuts[0], cuts[0]) + middle + between(text[cuts[-1] :], 0, size - cuts[-1], size - cuts[-1] + leave)


def product(left: Maps, right: Maps) -> Maps:
    """The map of two neighbouring stretches of text. Associative."""
    (first, first_ranks), (second, second_ranks) = left, right
    sums = first[:, :, None] + second[None, :, :]
    sums[(first <= NEVER)[:, :, None] | (second <= NEVER)[None, :, :]] = NEVER
    scores = sums.max(axis=1)
    # Of equal paths the one whose part on the right is first wins.
    order = np.where(sums == scores[:, None, :], second_ranks[None, :, :], np.iinfo(np.int64).max)
    middle = order.argmin(axis=1)
    entry, leave = np.indices(scores.shape)
    key = second_ranks[middle, leave] * len(first) + first_ranks[entry, middle]
    return scores, np.argsort(np.argsort(key, axis=0, kind="stable"), axis=0, kind="stable")


def states_between(maps: list[Maps], enter: int, leave: int) -> list[int]:
    """State at every boundary of ``maps`` on the best path from ``enter`` to ``leave``."""
    reached = np.full(len(maps[0][0]), NEVER, np.int64)
    reached[enter] = 0
    back = []
    for scores, ranks in maps:
        sums = np.where((reached[:, None] > NEVER) & (scores > NEVER), reached[:, None] + scores, NEVER)
        top = sums.max(axis=0)
        back.append(np.where(sums == top, ranks, np.iinfo(np.int64).max).argmin(axis=0))
        reached = top
    states = [leave]
    for before in reversed(back):
        states.append(int(before[states[-1]]))
    return states[::-1]


def _maps(frame: pd.DataFrame) -> list[Maps]:
    states = int(round((len(frame["scores"].iloc[0]) // 8) ** 0.5))
    return [tuple(np.frombuffer(x, np.int64).reshape(states, states) for x in pair) for pair in zip(frame["scores"], frame["ranks"], strict=True)]


_MAPS = "key binary, k int, scores binary, ranks binary"
_STATES = "key binary, k int, enter int, leave int"


def _scan(maps: DataFrame, fan_in: int) -> DataFrame:
    """The states at both ends of every chunk, from the maps (key, k, scores, ranks) of all chunks."""

    def combined(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        scores, ranks = reduce(product, _maps(frame))
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "k": [frame["k"].iloc[0] // fan_in], "scores": [scores.tobytes()], "ranks": [ranks.tobytes()]})

    def placed(frame: pd.DataFrame, enter: int, leave: int) -> pd.DataFrame:
        frame = frame.sort_values("k")
        path = states_between(_maps(frame), enter, leave)
        return pd.DataFrame({"key": frame["key"], "k": frame["k"], "enter": path[:-1], "leave": path[1:]})

    def below(frame: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        return placed(frame, int(ends["enter"].iloc[0]), int(ends["leave"].iloc[0]))

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        return placed(frame, 0, 0)

    group = F.floor(F.col("k") / fan_in).cast("int").alias("group")
    levels = [maps]
    for _ in range(LEVELS - 1):
        levels.append(levels[-1].groupBy("key", group).applyInPandas(combined, _MAPS))
    states = levels.pop().groupBy("key").applyInPandas(whole, _STATES)
    for level in reversed(levels):
        ends = states.groupBy("key", F.col("k").alias("group"))
        states = level.groupBy("key", group).cogroup(ends).applyInPandas(below, _STATES)
    return states


def _encode_giants(giants: DataFrame, model_file: str, chunk: int, fan_in: int, remembered: tuple[int, int]) -> DataFrame:
    """key and parts (k and ids of each chunk) of ``giants`` (key, text)."""

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(model_file)
        for frame in frames:
            for key, text in zip(frame["key"], frame["text"], strict=True):
                whole = words.escaped(text)
                for k, at in enumerate(range(0, len(whole), chunk)):
                    size = min(chunk, len(whole) - at)
                    piece = whole[at : at + size + words.longest - 1]
                    yield pd.DataFrame({"key": [key], "k": [k], "size": [size], "piece": [piece]})

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(model_file)
        memo = Memo(lambda segment: words.segment(segment)[0])
        for frame in frames:
            made = [transfer(words, memo, t, n) for t, n in zip(frame["piece"], frame["size"], strict=True)]
            yield pd.DataFrame({"key": frame["key"], "k": frame["k"], "scores": [m.tobytes() for m, _ in made], "ranks": [r.tobytes() for _, r in made]})

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, memo = vocabulary(model_file), packed_memo(model_file, remembered)
        for frame in frames:
            columns = (frame[c] for c in ("piece", "size", "enter", "leave"))
            yield pd.DataFrame({"key": frame["key"], "k": frame["k"], "ids": [trace_chunk(words, memo, *row) for row in zip(*columns, strict=True)]})

    chunks = giants.select("key", "text").mapInPandas(cut_up, "key binary, k int, size int, piece string").repartition("key", "k")
    states = _scan(chunks.mapInPandas(matrices, _MAPS), fan_in)
    traced = chunks.join(states, ["key", "k"]).mapInPandas(trace, "key binary, k int, ids binary")
    return traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))


def _checked(words: Vocabulary, text: str, ids: bytes) -> tuple:
    """What :func:`encoded` tells of a text and its ids, which are decoded again."""
    raw = text.encode("utf-8", "surrogatepass")
    own = hashlib.sha256(raw).hexdigest()
    joined = surface(words, np.frombuffer(ids, "<i4"))
    back = joined[1:] if joined[:1] == b" " else joined
    if back != raw:  # bytes that are no UTF-8 become the replacement character
        back = back.decode("utf-8", "replace").encode()
    return ids, len(ids) // 4, len(raw), own, own if back == raw else hashlib.sha256(back).hexdigest(), back == raw


def encoded(docs: DataFrame, model_file: str = MODEL_FILE, chunk: int = CHUNK_CHARS, fan_in: int = FAN_IN, remembered: tuple[int, int] = REMEMBERED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, ids (little-endian 32-bit integers), n_pieces, n_bytes,
    text_sha256, decoded_sha256, round_trip.

    ``ids`` are the unigram segmentation of the vocabulary; of equal scores the tokenizer's rule decides. Null and empty
    texts have none. ``round_trip`` says whether decoding gives the text again, which fails only for texts that hold the
    space mark U+2581 itself. Texts of ``chunk`` characters and more go through the scan over chunks, the others through
    one pass, with the same result. Repeated rows appear again, an empty table gives no rows, other columns are ignored.
    """
    # Giants are known by the SHA-256 of their text; repeated giants are worked out once.
    texts = docs.select(F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.when(F.char_length("text") >= chunk, F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    giants = texts.filter("key IS NOT NULL").groupBy("key").agg(F.max("text").alias("text"))
    ids = _encode_giants(giants, model_file, chunk, fan_in, remembered)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, memo = vocabulary(model_file), packed_memo(model_file, remembered)
        for frame in frames:
            found = [encode(words, memo, t) if parts is None else b"".join(p["ids"] for p in parts) for t, parts in zip(frame["text"], frame["parts"], strict=True)]
            out = [_checked(words, text, ids) for text, ids in zip(frame["text"], found, strict=True)]
            made = pd.DataFrame(out, columns=["ids", "n_pieces", "n_bytes", "text_sha256", "decoded_sha256", "round_trip"])
            made.insert(0, "doc_id", frame["doc_id"])
            yield made

    schema = "doc_id string, ids binary, n_pieces long, n_bytes long, text_sha256 string, decoded_sha256 string, round_trip boolean"
    short = texts.filter("key IS NULL").select("doc_id", "text", F.lit(None).cast("array<struct<k:int,ids:binary>>").alias("parts"))
    long = texts.filter("key IS NOT NULL").join(ids, "key").select("doc_id", "text", "parts")
    return with_long_id(short.unionAll(long).mapInPandas(finish, schema))


def decoded(rows: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """Texts of ``rows`` (doc_id, ids, ...) as written by :func:`encoded`: doc_id, text.

    Null and empty ids give an empty text, bytes that are no UTF-8 the replacement character. Long rows are decoded whole,
    repeated rows appear again, an empty table gives no rows, other columns are ignored.
    """

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(model_file)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": [decode(words, np.frombuffer(x or b"", "<i4")) for x in frame["ids"]]})

    return with_long_id(rows.select(F.col("doc_id").cast("string"), "ids").mapInPandas(back, "doc_id string, text string"))
