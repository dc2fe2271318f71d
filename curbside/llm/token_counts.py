"""Token counts of whole texts by a Viterbi pass that carries only the best score and its number of pieces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import with_long_id
from curbside.llm.pieces import NEVER, Memo, Vocabulary, vocabulary

#: Where the public vocabulary lies on the cluster's machines, unless the session names another or a caller does.
MODEL_FILE, MODEL_SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.curbside.tokenizer"
_COUNT_BITS = 44


def model_path(spark: SparkSession) -> str:
    return spark.conf.get(MODEL_SETTING, MODEL_FILE)


@lru_cache(maxsize=2)
def counts_memo(model_file: str) -> Memo:
    """Score and number of ids by segment in one number, kept for all tasks of a Python worker."""
    words = vocabulary(model_file)

    def packed(segment: str) -> int:
        score, number = score_and_count(words, segment)
        return (score << _COUNT_BITS) + number

    return Memo(packed)


def score_and_count(words: Vocabulary, text: str) -> tuple[int, int]:
    """Best score of ``text`` and the number of ids on its path (an unknown counts its UTF-8 bytes).

    The automaton lists matches by where they end, longest first, so the first of equal paths to a position is the one
    that starts earliest, which is the tokenizer's rule.
    """
    size = len(text)
    best, count = [0] + [NEVER] * size, [0] * (size + 1)
    if words.singles.issuperset(text):  # every character is a piece, so every position is reached
        for end, (length, score, _) in words.automaton.iter(text):
            end += 1
            score += best[end - length]
            if score > best[end]:
                best[end], count[end] = score, count[end - length] + 1
        return best[size], count[size]
    done = 0

    def settle(until: int) -> None:
        nonlocal done
        while done < until:
            at, done = done, done + 1
            if text[at] not in words.ids and best[at] > NEVER and best[at] + words.unknown > best[at + 1]:
                best[at + 1] = best[at] + words.unknown
                count[at + 1] = count[at] + len(text[at].encode("utf-8", "surrogatepass"))

    for end, (length, score, _) in words.automaton.iter(text):
        settle(end)
        at = end + 1 - length
        if best[at] > NEVER and best[at] + score > best[end + 1]:
            best[end + 1], count[end + 1] = best[at] + score, count[at] + 1
    settle(size)
    return best[size], count[size]


def token_counts(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_chars (code points), n_tokens, score.

    Null and empty texts have no tokens and score 0. Texts are counted whole, and of equal paths the tokenizer's rule
    names the one that counts. Paths are cut at every space mark, where
    no piece can cross, and the segments between cuts are worked out once and remembered in a bounded table. Repeated
    rows appear again, an empty table gives no rows, other columns are ignored.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, memo = vocabulary(model_file), counts_memo(model_file)
        for frame in frames:
            sums = [sum(map(memo.__getitem__, words.segments.findall(words.escaped(t)))) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "n_chars": [len(t or "") for t in frame["text"]],
                    "n_tokens": [s & ((1 << _COUNT_BITS) - 1) for s in sums],
                    "score": [s >> _COUNT_BITS for s in sums],
                }
            )

    return with_long_id(docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInPandas(count, "doc_id string, n_chars long, n_tokens long, score long"))
