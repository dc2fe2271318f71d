"""Alignment of two tokenizers' tokens by the bytes they cover.

Tokenizer A is a byte-level BPE, B a BPE of pieces with byte fallback. A text is encoded by both, and a two-pointer merge
of the two sequences of token ends finds the offsets at which tokens of both end. These cut the tokens into groups,
and the A and B tokens that end there are a link. The merge runs in the tasks, on whole arrays; each row keeps its different links
with how often they occur. Spark then counts each pair of ids over the corpus, takes the maximum for each B id, and joins both back.

How many pairs there can be does not depend on the corpus: two tokens that end together in one text are suffixes of
one another, so there are at most as many pairs as bytes in both vocabularies (times the few ids that share one spelling).
The table of counts is nevertheless broadcast only after its rows were counted.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curbside.llm.common import stored
from curbside.llm.pieces import SPACE

#: Where the public vocabularies lie on the cluster's machines, unless a caller names others.
FILE_A, FILE_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Rows of the table of counts up to which it is broadcast.
MOST_BROADCAST = 2_000_000
_CHARS_AT_ONCE, _REMEMBERED_CHARS = 1 << 20, 32 << 20
#: The splitting expression backtracks over white space; texts with longer runs go to the slower library.
_LONG_GAP = re.compile(r"\s{20000}")
# Fixed value: how byte-level BPE vocabularies of this kind split a text before they merge bytes.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the
    other bytes in order for the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Tokenizer A: ids and bytes of ordinary text, in which the strings of special tokens mean nothing."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            described = json.load(f)
        special = {t["content"] for t in described["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): k for token, k in described["model"]["vocab"].items() if token not in special}
        self.surface = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.surface[k] = token
        # Ids of such a vocabulary are in the order of its merges, so they serve as ranks; the library is four times as fast.
        self.fast = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(file)
        self.slow.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        if len(text) >= 20_000 and _LONG_GAP.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """Tokenizer B: ids by segment. No piece holds a space mark behind another character, so no merge crosses the start of a
    word, and words that repeat are encoded once."""

    def __init__(self, file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.surface = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        crossing = any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.segments = re.compile("(?s).+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, bytes] = {}
        self.size = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.segments.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if self.size > _REMEMBERED_CHARS:
            self.known, self.size = {}, 0
        new = list({s for own in cut for s in own if s not in self.known})
        ids = self.model.encode([s[1:].replace(SPACE, " ") if len(s) > 1 else "" for s in new], num_threads=1)
        mark = self.model.piece_to_id(SPACE)
        for s, found in zip(new, ids, strict=True):  # a mark alone is what an empty text has before it
            self.known[s] = np.array(found if len(s) > 1 else [mark], "<i4").tobytes()
            self.size += len(s)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, own)), "<i4") for own in cut]


def merged_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both ascending arrays of the values that they share, by one merge of the two."""
    both = np.concatenate([ends_a, ends_b])
    order = np.argsort(both, kind="stable")  # merges two ascending runs; of equal ends the one of A comes first
    ends = both[order]
    at = np.flatnonzero(ends[1:] == ends[:-1])
    return order[at], order[at + 1] - len(ends_a)


class Aligner:
    def __init__(self, file_a: str, file_b: str):
        self.a, self.b = ByteLevel(file_a), Pieces(file_b)
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x.surface)), np.int64) for x in (self.a, self.b))
        self.most = max(len(self.a.surface), len(self.b.surface))
        self.spelt = [f"{k}{mark}" for mark in ",|;" for k in range(self.most)]

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and B of each text; none where the tokens do not spell it."""
        texts = [t or "" for t in texts]
        for text, ids_b in zip(texts, self.b.encode(texts), strict=True):
            list_a, list_b = self.a.encode(" " + text) if text else [], ids_b.tolist()
            raw = (" " + text).encode("utf-8", "surrogatepass")
            if b"".join(map(self.a.surface.__getitem__, list_a)) != raw or b"".join(map(self.b.surface.__getitem__, list_b)) != raw:
                list_a, ids_b = [], ids_b[:0]
            yield np.array(list_a, np.int32), ids_b

    def aligned(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
        """Positions of the tokens that end each group, and the groups written out."""
        at_a, at_b = merged_ends(self.sizes_a[ids_a].cumsum(), self.sizes_b[ids_b].cumsum())
        if not len(at_a):
            return at_a, at_b, ""
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        before_b = np.concatenate([[0], at_b[:-1] + 1])[last_a.cumsum() - last_a]  # tokens of B in earlier groups
        before_a = (at_a + 1)[last_b.cumsum() - last_b]  # tokens of A in this group and earlier ones
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + before_b] = ids_a + last_a * self.most
        out[np.arange(len(ids_b)) + before_a] = ids_b + last_b * 2 * self.most
        return at_a, at_b, "".join(map(self.spelt.__getitem__, out.tolist()))[:-1]


@lru_cache(maxsize=1)
def _aligner(file_a: str, file_b: str) -> Aligner:
    """Read once in each Python worker."""
    return Aligner(file_a, file_b)


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= _CHARS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


_LINKS = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())])


def _aligned(file_a: str, file_b: str, with_groups: bool):
    """Batches (row, doc_id, text) with counts, the digest of the groups, the groups if wanted, and the different links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = _aligner(file_a, file_b)
        for batch in batches:
            counts, digests, groups, links = [], [], [], [np.empty((3, 0), np.int64)]
            for part in _parts(batch.column(2).to_pylist()):
                for ids_a, ids_b in aligner.tokens(part):
                    at_a, at_b, spelt = aligner.aligned(ids_a, ids_b)
                    pairs, times = np.unique(ids_a[at_a].astype(np.int64) << 32 | ids_b[at_b], return_counts=True)
                    counts.append((len(ids_a), len(ids_b), len(at_a), len(at_a), len(pairs)))
                    digests.append(hashlib.sha256(spelt.encode()).hexdigest() if spelt else "")
                    groups.append(spelt if with_groups else None)
                    links.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF, times]))
            flat = np.concatenate(links, axis=1).astype(np.int32)
            numbers = np.array(counts, np.int64).reshape(-1, 5)
            offsets = pa.array(np.concatenate([[0], numbers[:, 4].cumsum()]).astype(np.int32))
            pairs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(_LINKS)))
            columns = [batch.column(0), batch.column(1), *[pa.array(numbers[:, k]) for k in range(4)], pa.array(digests, pa.string()), pa.array(groups, pa.string()), pairs]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "links"])

    return run


_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links array<struct<a:int,b:int,times:int>>"


def encoded_pairs(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, with_groups: bool = True) -> DataFrame:
    """One row per row of ``docs``: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (if wanted,
    as `a1,a2|b1;a3|b2`), links (array of a, b, times); written in the shared folder. See :func:`aligned`."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return stored(texts.mapInArrow(_aligned(file_a, file_b, with_groups), _SCHEMA), "alignment")


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, total (links of the corpus that hold the pair) and best (whether no other A id is linked more often with ``b``)."""
    links = rows.select(F.inline("links"))
    counts = links.groupBy("a", "b").agg(F.sum("times").alias("total"))
    counts = stored(counts, "alignment-counts")
    most = counts.groupBy("b").agg(F.max("total").alias("most"))
    return stored(counts.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best")), "alignment-best")


def aligned(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, whose first piece has that space. Where the bytes of either are not those
    of the space and the text (it holds the space mark U+2581 itself), and for null and empty texts, there are no tokens,
    all numbers are 0 and the digest is ''. ``n_best`` counts the links whose pair occurs most often for its B id, ties included; ``count_sum``
    adds up the counts of all links. Strings of special tokens are ordinary text. Long texts are encoded whole, repeated
    rows are rows of their own and count each, rows without doc_id as well. An empty table gives no rows; other columns are ignored.
    """
    rows = encoded_pairs(docs, file_a, file_b, with_groups=False)
    counts = pair_counts(rows)
    if counts.count() <= MOST_BROADCAST:
        counts = F.broadcast(counts)
    own = rows.select("row", F.inline("links")).join(counts, ["a", "b"])
    sums = own.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("total")).alias("count_sum"))
    found = rows.drop("links", "groups").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
