"""Toxicity by weak supervision.

Many voters look at a text: lexicon voters (are so many of its words ones that start with a given stem?) and pattern
voters (shape of the writing). A generative label model estimates, without trusting any of them, how often each voter fires on
toxic and on clean texts, and which voters fire together beyond that; correlated voters share one vote. Its posteriors,
not the labels, train a linear classifier over the voters' counts, which then scores every text.

The lexicon is found in the training rows: stems that are far denser in texts marked toxic. How dense a stem must be for
its voter to fire is found there, too. The marks themselves enter the label model as one more noisy voter, whose accuracy
is estimated with the others.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import cut, labelled_texts, with_long_id
from curbside.llm.linear import Logistic, fit_logistic

#: Bounded sample of labelled rows: the first of each label by a hash of doc_id.
SAMPLE_PER_LABEL = 5000
FOLDS, HELD_OUT_FOLD = 3, 1
TOXIC_AT = 0.7
STEM_LENGTHS = (4, 5, 6, 7, 8)
MOST_VOTERS = 160
#: A stem votes if it is in so many toxic texts at least, and these have this share of its density over all texts.
LEAST_TEXTS, LEAST_SHARE = 4, 0.8
#: Words added to a text's length, so that one word of a tiny text is no great density.
SMOOTH_WORDS = 50
#: Densities above which a voter may fire.
LEVELS = (0.0, 0.001, 0.002, 0.004, 0.008, 0.016)
#: How far the label model believes a mark at first.
MARK_ACCURACY = 0.95
#: Correlations of voters within a class count by what they exceed so many standard errors.
ERRORS = 3.0
_WORD = re.compile(r"[^\W\d_]+")
#: Pattern voters: shouting, exclamation runs, masked words, address in the second person with an insult's rhythm.
PATTERNS = [re.compile(p) for p in (r"!{2,}|\?!", r"\b[A-Z]{4,}\b", r"\w[*@#$]{2,}\w?", r"(?i)\byou\b[^.]{0,40}!", r"(?i)\b(shut up|hate|kill|stupid)\b")]


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT_FOLD


class Voters:
    """Counts of each voter's matches in a text, and the text's number of words."""

    def __init__(self, stems: list[str]):
        self.stems = {s: k for k, s in enumerate(stems)}
        self.heads = {s[: STEM_LENGTHS[0]] for s in stems}
        self.size = len(stems) + len(PATTERNS)

    def counts(self, text: str | None) -> np.ndarray:
        """Matches of each voter, then the number of words."""
        text, out = text or "", np.zeros(self.size + 1)
        words = _WORD.findall(text.lower())
        heads, head = self.heads, STEM_LENGTHS[0]
        for word in [w for w in words if w[:head] in heads]:
            for n in STEM_LENGTHS:
                if n <= len(word) and (k := self.stems.get(word[:n])) is not None:
                    out[k] += 1
        for k, pattern in enumerate(PATTERNS):
            out[len(self.stems) + k] = len(pattern.findall(text))
        out[-1] = len(words)
        return out


def features(counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Of rows of counts: which voters fire, how often each matches and how densely, then lexicon matches together."""
    votes, words = counts[:, :-1], counts[:, -1:] + SMOOTH_WORDS
    lexicon = votes[:, : votes.shape[1] - len(PATTERNS)]
    found, dense = (lexicon > 0).sum(axis=1, keepdims=True), lexicon.sum(axis=1, keepdims=True)
    return np.hstack([votes / words > levels, np.log1p(votes), np.log1p(200 * votes / words), np.log1p(found), np.log1p(dense), np.log1p(200 * dense / words), np.log1p(words) / 10])


def firing_levels(counts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The density above which each voter fires: the one that tells most about the marks."""
    dense = counts[:, :-1] / (counts[:, -1:] + SMOOTH_WORDS)
    p = marks.mean()

    def told(on: np.ndarray) -> np.ndarray:
        """Mutual information of each voter and the marks."""
        n1, n0 = on[marks > 0].sum(axis=0) + 0.5, on[marks == 0].sum(axis=0) + 0.5
        share, rate = (n1 + n0) / (len(on) + 1), n1 / (n1 + n0)
        rest = np.clip((p * len(on) - n1) / np.maximum(1, len(on) - n1 - n0), 1e-6, 1 - 1e-6)
        entropy = lambda q: -q * np.log(q) - (1 - q) * np.log(1 - q)
        return -share * entropy(rate) - (1 - share) * entropy(rest)

    return np.array(LEVELS)[np.argmax([told(dense > level) for level in LEVELS], axis=0)]


def vote_odds(fired: np.ndarray, marks: np.ndarray, rates: np.ndarray, mark_rates: np.ndarray, share: np.ndarray, prior: float) -> np.ndarray:
    """Posterior of each row under the model: rates of firing by class (clean, toxic), of marks likewise, and the share
    of a vote that each voter has."""
    x, m = fired.astype(float), (marks > 0).astype(float)
    on, off = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
    mark = m * np.log(mark_rates[1] / mark_rates[0]) + (1 - m) * np.log((1 - mark_rates[1]) / (1 - mark_rates[0]))
    odds = np.log(prior / (1 - prior)) + mark + x @ (share * on) + (1 - x) @ (share * off)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def vote_shares(fired: np.ndarray, p: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Shares of a vote from what is left of the voters' correlations within the classes: of k voters that always fire
    together each has 1 / k. Each correlation is shrunk by ERRORS standard errors, so that chance takes no share."""
    left = fired - np.outer(p, rates[1]) - np.outer(1 - p, rates[0])
    spread = np.sqrt((left**2).sum(axis=0) + 1e-9)
    near = np.abs(left.T @ left) / np.outer(spread, spread)
    near = np.maximum(0, near - ERRORS / np.sqrt(len(fired))) / max(1e-9, 1 - ERRORS / np.sqrt(len(fired)))
    np.fill_diagonal(near, 1.0)
    return 1 / np.maximum(1.0, near.sum(axis=1))


def label_model(fired: np.ndarray, marks: np.ndarray, prior: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior that each row is toxic, the share of a vote that each voter has, and the rates at which clean and toxic
    rows are marked.

    Expectation-maximisation over voters that fire or not. The marks are one more voter: how often they are right is
    estimated like the rates of all others, from MARK_ACCURACY on. Voters that fire together more than their class
    explains share their votes.
    """
    x = fired.astype(float)
    m = (marks > 0).astype(float)
    p, share = np.where(marks > 0, 0.9, 0.02), np.ones(fired.shape[1])
    mark_rates = np.array([1 - MARK_ACCURACY, MARK_ACCURACY])
    for turn in range(rounds):
        rates = np.stack([(x.T @ (1 - p) + 0.5) / ((1 - p).sum() + 20), (x.T @ p + 0.5) / (p.sum() + 20)])
        if turn:  # the first guess of p is the marks themselves
            mark_rates = np.clip(np.array([m @ (1 - p) + 1, m @ p + 19]) / np.array([(1 - p).sum() + 20, p.sum() + 20]), 1e-3, 1 - 1e-3)
        if turn % 10 == 0:
            share = vote_shares(x, p, rates)
        new = vote_odds(fired, marks, rates, mark_rates, share, prior)
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done and turn % 10:
            break
    return p, share, mark_rates


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(fold != HELD_OUT_FOLD)
    known = known.select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    shares = dict(known.groupBy("y").count().collect())  # two numbers
    return cut(labelled_texts(docs, known, per_label)), shares


def _stems(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number of toxic texts with each stem, and its summed density in toxic and clean texts, combined within the task."""
    texts, dense = Counter(), {0: Counter(), 1: Counter()}
    for frame in frames:
        for text, y in zip(frame["text"], frame["y"], strict=True):
            words = _WORD.findall((text or "").lower())
            stems = Counter(w[:n] for w in words for n in STEM_LENGTHS if n <= len(w))
            own = dense[int(y)]
            for stem, n in stems.items():
                own[stem] += n / (len(words) + SMOOTH_WORDS)
            if y:
                texts.update(stems.keys())
    stems = list(texts)  # what no toxic text holds cannot vote
    for k in range(0, len(stems), 20_000):
        part = stems[k : k + 20_000]
        yield pd.DataFrame({"stem": pd.Series(part, dtype=object), "texts": [texts[s] for s in part], "toxic": [dense[1][s] for s in part], "clean": 0.0})
    stems = list(dense[0])
    for k in range(0, len(stems), 20_000):
        part = stems[k : k + 20_000]
        yield pd.DataFrame({"stem": pd.Series(part, dtype=object), "texts": 0, "toxic": 0.0, "clean": [dense[0][s] for s in part]})


def _lexicon(sample: DataFrame, shares: dict[int, int], sizes: dict[int, int]) -> list[str]:
    """The stems that vote: the shortest of those that say the same, the most telling first."""
    weight = (shares[0] / sizes[0]) / (shares[1] / sizes[1])  # clean rows are sampled more thinly
    stems = sample.mapInPandas(_stems, "stem string, texts long, toxic double, clean double").groupBy("stem")
    # Sums of doubles depend on the order of rows in their last digits; rounded, they do not.
    stems = stems.agg(F.sum("texts").alias("t"), F.round(F.sum("toxic"), 6).alias("on"), F.round(F.sum("clean"), 6).alias("off"))
    share = F.round(F.col("on") / (F.col("on") + weight * F.col("off")), 4)
    rows = stems.filter((F.col("t") >= LEAST_TEXTS) & (share >= LEAST_SHARE)).orderBy(F.desc(F.col("t") * share), F.length("stem"), "stem").limit(20 * MOST_VOTERS).collect()
    chosen: dict[str, int] = {}
    for row in rows:
        if any(chosen.get(row["stem"][:n], 0) >= row["t"] for n in STEM_LENGTHS if n < len(row["stem"])):
            continue
        chosen[row["stem"]] = row["t"]
        if len(chosen) == MOST_VOTERS:
            break
    return list(chosen)


def _constant(stems: list[str], log_odds: float) -> tuple[list[str], np.ndarray, Logistic]:
    voters = len(stems) + len(PATTERNS)
    levels = np.zeros(voters)
    return stems, levels, Logistic.constant(features(np.zeros((1, voters + 1)), levels).shape[1], log_odds)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[list[str], np.ndarray, Logistic]:
    """The lexicon, the levels at which voters fire and the linear model. Only rows outside the held-out fold are read for labels."""
    sample, shares = _sample(docs, labels, per_label)
    if set(shares) != {0, 1}:
        return _constant([], -4.0 if shares.get(1, 0) == 0 else 4.0)
    sizes = {y: min(per_label, n) for y, n in shares.items()}
    stems = _lexicon(sample, shares, sizes)

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters = Voters(stems)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "x": [voters.counts(t) for t in frame["text"]]})

    rows = sample.mapInPandas(vote, "doc_id long, y int, x array<double>").toPandas()
    rows = rows.sort_values(["doc_id", "y"])  # sums of doubles depend on the order
    if rows["y"].nunique() < 2:  # no texts for the marks of one kind
        return _constant(stems, -4.0)
    counts, y = np.array(rows["x"].tolist()), rows["y"].to_numpy()
    levels = firing_levels(counts, y)
    fired = counts[:, :-1] / (counts[:, -1:] + SMOOTH_WORDS) > levels
    posterior, _, _ = label_model(fired, y, shares[1] / (shares[0] + shares[1]))
    weight = np.where(y > 0, shares[1] / max(1, (y > 0).sum()), shares[0] / max(1, (y == 0).sum()))
    return stems, levels, fit_logistic(features(counts, levels), posterior, weight, ridge=0.5)


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, held_out, score, predicted.

    Null texts count as empty and are scored like any other, long ones are read whole; a score of exactly TOXIC_AT is
    predicted toxic. Rows of ``labels`` (doc_id, toxic, ...) with other marks
    than 0 and 1 are ignored; with no marks of one kind every text has the same score. A null doc_id is not held out.
    Repeated rows appear again, an empty table gives no rows, other columns are ignored.
    """
    stems, levels, model = train(docs, labels, per_label)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters = Voters(stems)
        for frame in frames:
            ids = frame["doc_id"]
            counts = np.array([voters.counts(t) for t in frame["text"]]).reshape(-1, voters.size + 1)
            p = np.round(model.probability(features(counts, levels)), 9)
            yield pd.DataFrame({"doc_id": ids, "held_out": [held_out(i) for i in ids], "score": p, "predicted": (p >= TOXIC_AT).astype("int32")})

    return with_long_id(docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(score, "doc_id string, held_out boolean, score double, predicted int"))
