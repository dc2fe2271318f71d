"""SimHash near-duplicates linked through a forest of vantage-point trees.

Fingerprints of unrelated texts lie about 32 bits apart with a spread of 4 bits, so a vantage-point tree over whole
fingerprints sends nearly every query for distance 4 to both sides of each node (measured: 1.7 copies a level). The
pigeonhole principle sharpens the triangle bound: cut the 64 bits into six blocks; two fingerprints that differ in at
most four bits agree on at least two whole blocks. So there is one tree for each of the 15 pairs of blocks, over the
Hamming distance on these bits only, which is a pseudo-metric: near fingerprints have distance 0 in one tree at least.
There |d(x, v) - d(y, v)| <= 0 for every vantage point v, so a query visits one branch at each node, and the distances
to the vantage points name the leaf (the shard). A fingerprint lies in 15 shards, which is all the overlap there is.

Shards are split by size. One that a sample shows to have more than SPLIT_ROWS fingerprints grows 15 subtrees in the same
way over the bits that its own tree left out, and so do those, up to three levels. Within a task a large shard is split
likewise. What is left, few or dense fingerprints, is searched with the distance on all 64 bits, in the order of the
distance to one more vantage point, where the triangle bound cuts off what is too far.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import components, cut, named_rows, with_long_id

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
_BLOCKS = RADIUS + 2
_VANTAGE_POINTS = 10
#: Shards of more fingerprints are split before they are dealt to tasks; found in one of SAMPLED fingerprints.
SPLIT_ROWS, SAMPLED, LEVELS = 1_000_000, 64, 3
#: Shards up to _SMALL fingerprints are compared by shifting, those above _LARGE are split within the task.
_SMALL, _LARGE = 24, 2048
_COUNT_AT_ONCE = 1 << 17
SALTS = 8


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones, total, digest = np.zeros(64, np.int64), len(starts), xxhash.xxh64_intdigest
    for k in range(0, total, _COUNT_AT_ONCE):
        part = zip(starts[k : k + _COUNT_AT_ONCE].tolist(), ends[k : k + _COUNT_AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        values = np.array([fingerprint(t) for t in frame["text"]], dtype=np.uint64)
        yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": values.view(np.int64), "own": frame["own"]})


def _subtrees(taken: int) -> list[int]:
    """Masks of the trees below one that already took the bits ``taken``: each takes two blocks of the others.

    Fingerprints that differ in RADIUS bits at most agree on two of RADIUS + 2 blocks at least.
    """
    free = [1 << k for k in range(64) if not taken >> k & 1]
    ends = [k * len(free) // _BLOCKS for k in range(_BLOCKS + 1)]
    blocks = [sum(free[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return [taken | a | b for a, b in combinations(blocks, 2)]


def _leaves(fps: np.ndarray, mask: int) -> np.ndarray:
    """The leaf of each fingerprint in the tree over ``mask``: its distances to the vantage points, joined to a number.

    Vantage points come from a fixed rule, so every task draws the same. Leaves whose numbers happen to be equal are
    searched together, which finds no less.
    """
    points = np.random.default_rng([SEED, mask & 0xFFFFFFFF, mask >> 32]).integers(0, 2**64, _VANTAGE_POINTS, dtype=np.uint64)
    path = np.full(len(fps), mask, np.uint64)
    for point in points:
        path = (path ^ np.bitwise_count((fps ^ point) & np.uint64(mask)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        path ^= path >> np.uint64(29)
    return path.view(np.int64)


def _shards(split: list[np.ndarray], level: int | None = None):
    """Batches of fingerprints as (shard, fp), each once for each tree; shards named in ``split[k]`` go on at level k + 1.

    With ``level`` only shards of that level are given.
    """

    def below(fps: np.ndarray, taken: int, depth: int) -> Iterator[pd.DataFrame]:
        for mask in _subtrees(taken):
            leaves = _leaves(fps, mask)
            large = np.isin(leaves, split[depth]) if depth < len(split) else np.zeros(len(fps), bool)
            if level is None or level == depth:
                yield pd.DataFrame({"shard": leaves[~large], "fp": fps[~large].view(np.int64)})
            if large.any():
                yield from below(fps[large], mask, depth + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from below(frame["fp"].to_numpy().view(np.uint64), 0, 0)

    return run


def _star(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of one shard as a spanning forest: each fingerprint is linked once to one found before it.

    A breadth-first search over what is still unvisited, kept in the order of the distance to a vantage point: only
    those whose distance differs from the query's by RADIUS or less can be near it.
    """
    far = np.bitwise_count(fps ^ fps[0]).astype(np.int64)
    order = np.argsort(far, kind="stable")
    fps, far = fps[order], far[order]
    left, links = np.arange(len(fps)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            lo, hi = np.searchsorted(far[left], [far[at] - RADIUS, far[at] + RADIUS + 1])
            near = np.bitwise_count(fps[left[lo:hi]] ^ fps[at]) <= RADIUS
            if near.any():
                found = left[lo:hi][near]
                links.append((np.full(len(found), fps[at]), fps[found]))
                queue.extend(found.tolist())
                left = np.concatenate([left[:lo], left[lo:hi][~near], left[hi:]])
    return links


def _groups_linked(leaf: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within each of the leaves, which come sorted."""
    starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(leaf)]]))
    links = []
    for s, n in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        links += _linked(fps[s : s + n])
    small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
    leaf, fps = leaf[small], fps[small]
    for step in range(1, _SMALL):
        near = (leaf[step:] == leaf[:-step]) & (np.bitwise_count(fps[step:] ^ fps[:-step]) <= RADIUS)
        if near.any():
            links.append((fps[:-step][near], fps[step:][near]))
    return links


def _linked(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of one shard that connect what is connected in it. Large ones are split by the bits in which they differ."""
    differing = int(np.bitwise_or.reduce(fps ^ fps[0]))
    if len(fps) <= _LARGE or differing.bit_count() <= 2 * _BLOCKS:
        return _star(fps)
    if (np.bitwise_count(fps ^ fps[len(fps) // 2]) <= RADIUS).sum() > len(fps) // 64:  # dense: one step of a search takes many
        return _star(fps)
    links = []
    for mask in _subtrees(~differing & 0xFFFFFFFFFFFFFFFF):
        leaves = _leaves(fps, mask)
        order = np.argsort(leaves, kind="stable")
        links += _groups_linked(leaves[order], fps[order])
    return links


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within shards; rows arrive sorted by shard, and the last shard of a batch waits for the next batch."""
    held: list[np.ndarray] = []

    def solve(shard: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        links = _groups_linked(shard, fps.view(np.uint64))
        src, dst = (np.concatenate([np.zeros(0, np.uint64), *side]) for side in (zip(*links, strict=True) if links else ((), ())))
        return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    for frame in frames:
        shard, fps = (frame[c].to_numpy() for c in ("shard", "fp"))
        held.append(np.stack([shard, fps]))
        if held[0][0, 0] == shard[-1]:
            continue
        rows = np.concatenate(held, axis=1)
        last = int(np.searchsorted(rows[0], rows[0, -1]))
        held = [rows[:, last:]]
        yield solve(rows[0, :last], rows[1, :last])
    if held:
        rows = np.concatenate(held, axis=1)
        yield solve(rows[0], rows[1])


def _large_shards(fps: DataFrame, split_rows: int, sampled: int) -> list[np.ndarray]:
    """By level, the shards that hold more than about ``split_rows`` fingerprints.

    They are found in a sample and serve the balance only. A level has one for each ``split_rows`` entries at most, so
    for 10^10 fingerprints some 150,000 numbers are sent.
    """
    some = cut(fps.filter(F.pmod(F.xxhash64("fp"), F.lit(sampled)) == 0))
    split: list[np.ndarray] = []
    for level in range(LEVELS - 1):
        shards = some.mapInPandas(_shards(split, level), "shard long, fp long").groupBy("shard").count()
        found = [r["shard"] for r in shards.filter(F.col("count") * sampled > split_rows).select("shard").toLocalIterator()]
        if not found:
            break
        split.append(np.array(found, np.int64))
    return split


def _members(docs: DataFrame, with_text: bool, split_rows: int = SPLIT_ROWS, sampled: int = SAMPLED) -> DataFrame:
    """doc_id, fp, own (SHA-256 of the text, if wanted), component (a fingerprint that names it) and component_id of every row."""
    own = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)) if with_text else F.lit(None).cast("binary")
    texts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"), own.alias("own"))
    rows = cut(with_long_id(texts.mapInPandas(_fingerprints, "doc_id string, fp long, own binary")))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    shards = nodes.select("fp").mapInPandas(_shards(_large_shards(nodes.select("fp"), split_rows, sampled)), "shard long, fp long")
    links = shards.repartition("shard").sortWithinPartitions("shard").mapInPandas(_links, "src long, dst long")
    found = components(links)
    linked = nodes.join(found, F.col("fp") == F.col("node")).select("fp", "least", "component")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    spread = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # members of a large component are spread
    placed = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(spread, ["component", "salt"])
    named = nodes.join(placed.select("fp", "component", "component_id"), "fp", "left")
    alone = F.col("component").isNull()
    named = named.select("fp", F.coalesce("component", "fp").alias("component"), F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # so are the rows of one fingerprint
    return rows.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(named, ["fp", "salt"]).drop("salt")


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, fingerprint, component_id.

    ``fingerprint`` is 16 lowercase hex digits; fingerprints link at RADIUS or fewer differing bits, and
    ``component_id`` is the smallest doc_id reachable over links, itself included. A null text counts as empty; texts
    without words have fingerprint zero and link like any other; shorter texts than a shingle are one shingle; long ones
    are read whole. A bit that is set in exactly half the hashes is 0. Repeated rows appear again. A row without doc_id
    gets the component of its fingerprint. Rows are told apart by their texts, whatever ids they share. An empty table gives no rows; other columns are ignored.
    """
    return _members(docs, False).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that stay, with all their columns: one row of each group of near-duplicates.

    It is the row with the smallest doc_id, of several under that id the one with the least fingerprint and then the
    least SHA-256, and any one of rows that repeat both id and text. A row without doc_id stays only where its group has
    none with one. Nulls, empty and long texts and empty tables as in :func:`simhash_components`.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "own")).alias("least")
    chosen = _members(docs, True).groupBy("component").agg(least)
    return named_rows(docs, chosen.select("least.doc_id", "least.own"))
