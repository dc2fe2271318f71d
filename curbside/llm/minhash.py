"""MinHash near-duplicates: banded candidates, pruned by a sequential Bayesian test, confirmed on the full sets.

A document is its set of word shingles. Documents with equal sets are one class, and only one row of each class goes on.

* **Bands.** A signature of BANDS * ROWS hashes is cut into bands. Sets of similarity 0.8 agree on a band of four hashes
  with probability 0.41, so that with 32 bands one pair in 20 million is never met.
* **Sequential test.** Hashes agree with the probability of the similarity s. With a uniform prior, after m agreements
  among n hashes s is at least t with probability P(Bin(n + 1, t) <= m). Candidates are compared batch by batch, and
  dropped as soon as this falls below MISS.
* **Exact test.** The texts of the survivors, packed, are brought together and their sets compared whole.

No bucket is ever written out as all its pairs. First every member meets one leader of each of its buckets, which is
linear in the members. The links found that way join classes to components; a bucket whose members all lie in one
component has nothing left to find. Only the other buckets are read whole: each is cut into blocks of bounded size, and every
pair of blocks meets in a group of its own, with signatures and texts. There members of different components are
compared, each pair in the first band that it shares only, the likeliest first; a link joins their components at once, so that
what it makes needless is not compared. Only such links leave the task: fewer than there were components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import components, stored

SHINGLE_WORDS, PERCENT = 2, 80
BANDS, ROWS = 32, 4
#: Hashes compared at a time, and how improbable it must be that a pair is similar for the test to drop it.
BATCH, MISS = 16, 1e-9
#: About so many members of a bucket, and shingles of theirs, make up a block; two blocks meet at a time.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20
SALTS = 8
_SIZE = BANDS * ROWS
_AT_ONCE = 512
_MOST_WORDS = 1 << 20


class Words(dict):
    """A number for each different word, and two hashes of it by number."""

    def __init__(self):
        super().__init__()
        self.hashes = np.empty((2, 1 << 12), np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        if k == self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)], axis=1)
        both = xxhash.xxh3_128_intdigest(word)
        self.hashes[0, k], self.hashes[1, k] = both >> 64, both & 0xFFFFFFFFFFFFFFFF
        return k


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: Words, text: str | bytes | None, width: int) -> np.ndarray:
    """Two hashes (rows) of each different shingle of ``text`` in an order that depends on the set alone."""
    found = words_of(text)
    if not found:
        return np.empty((2, 0), np.uint64)
    width = min(width, len(found))
    numbers = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
    n = len(numbers) - width + 1
    codes = numbers[:n]
    for k in range(1, width):  # codes stay exact: pairs of 31-bit numbers, numbered anew where another word follows
        codes = codes << 32 | numbers[k : k + n]
        if k < width - 1:
            codes = np.unique(codes, return_inverse=True)[1]
    first = np.unique(codes, return_index=True)[1]
    hashes = _mixed(words.hashes[:, numbers[first]] + np.uint64(width))
    for k in range(1, width):
        hashes = _mixed(hashes + words.hashes[:, numbers[first + k]])
    return hashes[:, np.lexsort(hashes[::-1])]


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20120907).integers(0, 2**64, (2, _SIZE, 1), dtype=np.uint64)
    return draw[0], draw[1] | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of each hash function over a set, as 32-bit numbers."""
    seeds, factors = _functions()
    least = np.full(_SIZE, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), _AT_ONCE):
        np.minimum(least, ((hashes[None, k : k + _AT_ONCE] ^ seeds) * factors).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def buckets(signatures: np.ndarray) -> np.ndarray:
    """Bucket of every signature (rows) in every band (columns)."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


@lru_cache(maxsize=4)
def prune_levels(percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """By batch, the largest number of agreements so far with which a pair is dropped (-1: with none)."""
    t, levels = percent / 100, []
    for n in range(BATCH, _SIZE + 1, BATCH):
        below, most = 0.0, -1
        for m in range(n + 1):
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            most = m
        levels.append(most)
    return tuple(levels)


def passing(left: np.ndarray, right: np.ndarray, levels: tuple[int, ...]) -> np.ndarray:
    """Positions at which the signatures ``left`` and ``right`` (rows; one of them may be a single row) pass the test."""
    alive = np.arange(max(len(left), len(right)))
    agreed = np.zeros(len(alive), np.int64)
    for k, most in enumerate(levels):
        part = slice(k * BATCH, (k + 1) * BATCH)
        a, b = (x[:, part] if len(x) == 1 else x[alive, part] for x in (left, right))
        agreed = agreed + (a == b).sum(axis=1)
        keep = agreed > most
        alive, agreed = alive[keep], agreed[keep]
        if not len(alive):
            break
    return alive


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(len(column), _SIZE)


def _signed(width: int):
    """Batches (row, doc_id, text) as row, doc_id, the text packed, the size of the set, its digest and its signature; null
    where there is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = Words(), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed, sizes, digests, signatures = [], [], [], []
            for text in batch.column(2).to_pylist():
                if len(words) > _MOST_WORDS:
                    words = Words()
                raw = (text or "").encode("utf-8", "surrogatepass")
                hashes = shingle_hashes(words, raw, width)
                some = hashes.shape[1] > 0
                packed.append(pack(raw) if some else None)
                sizes.append(hashes.shape[1])
                digests.append(hashlib.sha256(hashes.tobytes()).digest() if some else None)
                signatures.append(signature(hashes[0]).tobytes() if some else None)
            columns = [*batch.columns[:2], pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "packed", "n_shingles", "digest", "signature"])

    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = buckets(_matrix(pd.Series(batch.column(1).to_pylist()))) if batch.num_rows else np.empty((0, BANDS), np.int64)
        nodes = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(nodes)], names=["bucket", "node"])


def _similar(width: int, percent: int):
    """Pairs (a, b, packed_a, packed_b) whose full sets are similar. Rows come in the order of ``a``, whose set is kept."""

    def shingles(packed: bytes) -> set:
        found = words_of(zstandard.decompress(packed))
        return set(zip(*(found[k:] for k in range(min(width, len(found)))), strict=False))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, set()
        for frame in frames:
            keep = []
            for a, packed_a, packed_b in zip(frame["a"], frame["packed_a"], frame["packed_b"], strict=True):
                if a != last:
                    last, left = a, shingles(packed_a)
                right = shingles(packed_b)
                both = len(left & right)
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield frame.loc[keep, ["a", "b"]]

    return run


def _tested(percent: int, miss: float):
    levels = prune_levels(percent, miss)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.iloc[passing(_matrix(frame["sig_a"]), _matrix(frame["sig_b"]), levels)][["a", "b"]]

    return run


def _codes(numbers: dict[bytes, int], text: str | bytes, width: int) -> np.ndarray:
    """The different shingles of ``text`` as sorted numbers that mean the same for all texts of one ``numbers``."""
    found = words_of(text)
    width = min(width, len(found))
    known = np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int64)
    codes = known[: len(known) - width + 1]
    if width == 2:
        return np.unique(codes << 32 | known[1:])
    parts = [known[k : k + len(codes)].tolist() for k in range(width)]
    return np.unique(np.array([numbers.setdefault(p, len(numbers)) for p in zip(*parts, strict=True)], np.int64))


def _compared(width: int, percent: int, miss: float):
    """Rows of groups (bucket, i, j), sorted by them and by ``side``: links between members of different components, of the two
    blocks i and j or, where i = j, within one."""
    levels = prune_levels(percent, miss)
    key = ["bucket", "i", "j"]

    def solve(group: pd.DataFrame) -> Iterator[tuple[int, int]]:
        sigs, nodes, labels = _matrix(group["signature"]), group["node"].tolist(), group["label"].to_numpy(copy=True)
        texts, own = group["packed"].tolist(), buckets(sigs)
        band = int((own[0] == group["bucket"].iloc[0]).argmax())
        within = group["i"].iloc[0] == group["j"].iloc[0]
        start = 0 if within else int((group["side"] == 0).sum())
        numbers, sets = {}, {}

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = _codes(numbers, zstandard.decompress(texts[k]), width)
            return sets[k]

        for k in range(len(nodes) - 1 if within else start):
            lo = k + 1 if within else start
            other = np.flatnonzero(labels[lo:] != labels[k]) + lo
            other = other[passing(sigs[k : k + 1], sigs[other], levels)] if len(other) else other
            other = other[(own[other] == own[k]).argmax(axis=1) == band] if len(other) else other
            for c in other[np.argsort(-(sigs[other] == sigs[k]).sum(axis=1), kind="stable")].tolist():
                if labels[c] != labels[k]:
                    left, right = shingles(k), shingles(c)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    if 100 * both >= percent * (len(left) + len(right) - both):
                        yield nodes[k], nodes[c]
                        labels[labels == labels[c]] = labels[k]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def links(rows: pd.DataFrame) -> pd.DataFrame:
            found = [x for _, group in rows.groupby(key, sort=False) for x in solve(group)]
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        for frame in frames:
            if not len(frame):
                continue
            ends = frame[key].iloc[-1]
            whole = ~(frame[key] == ends).all(axis=1)  # the last group of a batch may go on in the next one
            if held and whole.any() or held and not (held[-1][key].iloc[-1] == ends).all():
                yield links(pd.concat([*held, frame[whole]]))
                held = []
            elif whole.any():
                yield links(frame[whole])
            held.append(frame[~whole])
        if held:
            yield links(pd.concat(held))

    return run


def _links(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar."""
    left, right = (rows.select(F.col("row").alias(c), F.col("packed").alias(f"packed_{c}")) for c in "ab")
    texts = pairs.join(right, "b").join(left, "a").select("a", "b", "packed_a", "packed_b").sortWithinPartitions("a")
    return texts.mapInPandas(_similar(width, percent), "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _linked(rows: DataFrame, classes: DataFrame, width: int, percent: int, miss: float, block_rows: int) -> DataFrame:
    """node and component of every class that is linked with another."""
    signed = rows.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "signature")
    bands = stored(signed.mapInArrow(_banded, "bucket long, node long"), "minhash-bands")
    # The leader of a bucket is a member drawn by the bucket, so that members of several buckets meet several leaders.
    drawn = bands.groupBy("bucket").agg(F.min(F.col("node").bitwiseXOR(F.col("bucket"))).alias("drawn"), F.count("*").alias("members"))
    leaders = drawn.filter("members > 1").select("bucket", F.col("drawn").bitwiseXOR(F.col("bucket")).alias("leader"))
    shared = stored(bands.join(leaders, "bucket"), "minhash-shared")

    led = shared.filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    left, right = (rows.select(F.col("row").alias(c), F.col("signature").alias(f"sig_{c}")) for c in "ab")
    likely = led.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInPandas(_tested(percent, miss), "a long, b long")
    first = stored(_links(stored(likely, "minhash-likely"), rows, width, percent), "minhash-links")
    found = stored(_labels(first), "minhash-labels")

    labelled = shared.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("bucket")
    members = labelled.join(mixed, "bucket").join(rows.select(F.col("row").alias("node"), "signature", "packed"), "node")
    sizes = labelled.join(mixed, "bucket").join(rows.select(F.col("row").alias("node"), "n_shingles"), "node").groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    parts = F.ceil(F.greatest(F.col("members") / block_rows, F.col("shingles") / BLOCK_SHINGLES))
    dealt = members.join(sizes.select("bucket", parts.alias("parts")), "bucket").withColumn("own", F.pmod(F.xxhash64("node"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "label", "signature", "packed")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    second = dealt.mapInPandas(_compared(width, percent, miss), "a long, b long")
    return _labels(stored(first.unionAll(second), "minhash-all"))


def minhash_components(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT, miss: float = MISS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Documents link whose sets of ``width``-word shingles have a similarity of ``percent`` or more; a text with fewer words
    is one shingle. ``component_id`` is the smallest doc_id reachable over links, itself included, and ``kept`` says
    whether it is the row's own. Null texts and texts without words have no shingle, link with nothing and are kept.
    Long texts are read whole. Repeated rows appear again, all kept if theirs is the smallest id; rows that share an id
    are compared by their own texts. A row without doc_id gets the smallest id of its component; it is kept only where
    the component has no id at all. An empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    schema = "row long, doc_id long, packed binary, n_shingles long, digest binary, signature binary"
    rows = stored(texts.mapInArrow(_signed(width), schema), "minhash-rows")
    # A class of equal sets is named by its first row.
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = stored(classes, "minhash-classes")
    found = stored(_linked(rows, classes, width, percent, miss, block_rows), "minhash-components")

    linked = classes.join(found, "node").select("node", "least", "component")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    spread = ids.withColumn("salt", F.explode(salts))  # members of a large component are spread
    placed = linked.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(spread, ["component", "salt"]).select("node", "component_id", F.lit(True).alias("linked"))
    named = classes.join(placed, "node", "left").select("digest", "node", "copies", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    # So are the rows of a large class; a row that is alone in its class is the node itself.
    own_salt = F.pmod("node", F.lit(SALTS)).cast("int")
    named = named.withColumn("salt", F.explode(F.when(F.col("copies") > 1, salts).otherwise(F.array(own_salt)))).select("digest", "salt", "component_id", F.lit(True).alias("named"))
    members = rows.select("doc_id", "n_shingles", "digest", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    out = members.join(named, ["digest", "salt"], "left")
    component_id = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))
