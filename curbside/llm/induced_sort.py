"""External induced suffix sorting with common-prefix values, to a bounded depth.

Suffixes are L (greater than the suffix after them) or S (smaller); an S suffix after an L one is a seed (S*). The seeds
are sorted first. Then one scan in ascending order places all L suffixes: the suffix before a placed one goes to the
queue of its first byte. A scan in descending order places all S suffixes the same way. The queues hold (position, common
prefix with the entry before) and together are the priority queue of the scan: bytes in order, and first come, first
served within a byte. They spill to disk beyond ``memory`` bytes; the text and a few arrays of its length stay in memory,
so a shard must fit there. Scans only append and read in sequence.

Common-prefix values are carried along: two suffixes that enter a queue one after the other agree on one byte more than
the suffixes that brought them in, which agree on the least value passed by the scan in between. They are capped at
``depth``: beyond it order does not matter here, so the seeds are sorted directly to that depth, without recursion.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

_READ = 1 << 20


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])


class SpillingQueues:
    """256 first-in-first-out queues of (position, common prefix), on disk beyond ``memory`` bytes."""

    def __init__(self, folder: str, name: str, memory: int):
        self._path = os.path.join(folder, name)
        self._memory, self._held = memory, 0
        self._parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(256)]
        self._spilled = [0] * 256

    def push(self, queue: int, positions: np.ndarray, common: np.ndarray) -> None:
        self._parts[queue].append((positions, common))
        self._held += positions.nbytes + common.nbytes
        if self._held > self._memory:
            for k, parts in enumerate(self._parts):
                if parts:
                    self._spilled[k] += sum(len(p) for p, _ in parts)
                    for suffix, column in (("p", 0), ("c", 1)):
                        with open(f"{self._path}-{k}{suffix}", "ab") as file:
                            for part in parts:
                                part[column].tofile(file)
                    parts.clear()
            self._held = 0

    def _blocks(self, queue: int) -> list[tuple[int, int]]:
        return [(at, min(_READ, self._spilled[queue] - at)) for at in range(0, self._spilled[queue], _READ)]

    def _read(self, queue: int, at: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        return (
            np.fromfile(f"{self._path}-{queue}p", np.int64, size, offset=8 * at),
            np.fromfile(f"{self._path}-{queue}c", np.uint8, size, offset=at),
        )

    def take(self, queue: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Empties the queue, oldest first, block by block; what is pushed meanwhile comes last."""
        at = 0
        while True:
            if at < self._spilled[queue]:
                size = min(_READ, self._spilled[queue] - at)
                yield self._read(queue, at, size)
                at += size
                continue
            if at:
                os.remove(f"{self._path}-{queue}p")
                os.remove(f"{self._path}-{queue}c")
                self._spilled[queue] = at = 0
            parts, self._parts[queue] = self._parts[queue], []
            if not parts:
                return
            self._held -= sum(p.nbytes + c.nbytes for p, c in parts)
            yield _joined(parts)

    def latest_first(self, queue: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Reads the queue backwards and leaves it as it is."""
        if self._parts[queue]:
            positions, common = _joined(self._parts[queue])
            yield positions[::-1], common[::-1]
        for block in reversed(self._blocks(queue)):
            positions, common = self._read(queue, *block)
            yield positions[::-1], common[::-1]

    def whole(self, queue: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._read(queue, *b) for b in self._blocks(queue)] + self._parts[queue]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return _joined(parts)


def common_prefix(text: np.ndarray, a: int, b: int, depth: int) -> int:
    x, y = text[a : a + depth], text[b : b + depth]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def sorted_seeds(text: np.ndarray, seeds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by their first ``depth`` bytes, eight bytes at a time, and the common prefix of each with the one before."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    order, common = np.asarray(seeds, np.int64), np.full(len(seeds), depth, np.uint8)
    group = np.zeros(len(seeds), np.int64)  # first slot of the run of still equal seeds
    slots = np.arange(len(seeds))
    for at in range(0, depth, 8):
        if not len(slots):
            break
        rows = padded[order[slots][:, None] + np.arange(at, at + 8)]
        words = np.ascontiguousarray(rows).view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((words, group[slots]))
        order[slots], words = order[slots][by], words[by]
        same = group[slots][1:] == group[slots][:-1]
        apart = words[1:] ^ words[:-1]
        split = same & (apart != 0)
        equal = sum((apart < (np.uint64(1) << np.uint64(64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        common[slots[1:][split]] = np.minimum(depth, at + equal[split])
        starts = np.concatenate([[True], ~same | split])
        group[slots] = slots[np.maximum.accumulate(np.where(starts, np.arange(len(slots)), 0))]
        sizes = np.diff(np.concatenate([np.flatnonzero(starts), [len(slots)]]))
        slots = slots[np.repeat(sizes > 1, sizes)]
    if len(common):
        common[0] = 0
    return order, common


def induced_suffixes(text: np.ndarray, depth: int, folder: str, memory: int = 96 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of ``text`` (bytes) in the order of their suffixes, in parts by first byte, each position with the
    length of its common prefix with the one before it (0 at the start of a part), capped at ``depth``.
    """
    size = len(text)
    if not size:
        return
    step = np.zeros(size, np.int16)
    step[:-1] = text[1:].astype(np.int16) - text[:-1]
    following = np.where(step != 0, np.arange(size), size)
    following = np.minimum.accumulate(following[::-1])[::-1]  # where the run of equal bytes ends
    is_s = np.concatenate([step, [-1]])[following] > 0
    seeds = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    seeds, seed_common = sorted_seeds(text, seeds, depth)
    bounds = np.searchsorted(text[seeds], np.arange(257))
    queues, large = SpillingQueues(folder, "queue", memory // 2), SpillingQueues(folder, "large", memory // 2)

    def induce(positions: np.ndarray, common: np.ndarray, carried: np.ndarray, wanted: bool, into: SpillingQueues) -> None:
        """Queues the suffixes before ``positions`` that are S (``wanted``) or L."""
        if not len(positions):
            return
        before = positions - 1
        ok = (before >= 0) & (is_s[before] == wanted)
        if wanted:
            ok &= text[before] <= text[positions]
        else:
            ok &= text[before] >= text[positions]
        at = np.flatnonzero(ok)
        chars = text[before[at]]
        by = np.argsort(chars, kind="stable")
        chars, at = chars[by], at[by]
        cuts = np.concatenate([[0], np.flatnonzero(chars[1:] != chars[:-1]) + 1, [len(chars)]]) if len(chars) else [0]
        reached = np.zeros(256, bool)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            char, own = int(chars[lo]), at[lo:hi]
            starts = np.concatenate([[0], own + 1])
            tail = starts[-1] < len(common)
            least = np.minimum.reduceat(common, starts if tail else starts[:-1])
            entering = least[: hi - lo].copy()
            entering[0] = min(entering[0], carried[char])
            carried[char] = least[-1] if tail else depth
            reached[char] = True
            into.push(char, before[own], np.minimum(entering, depth - 1) + np.uint8(1))
        carried[~reached] = np.minimum(carried[~reached], common.min())

    # Ascending scan. Nothing entered a queue yet, so the first entry of each shares nothing with one before it.
    carried = np.zeros(256, np.uint8)
    queues.push(int(text[-1]), np.array([size - 1]), np.zeros(1, np.uint8))
    last_large = [-1] * 256
    for char in range(256):
        first = True
        for positions, common in queues.take(char):
            common = common.copy()
            if first:
                common[0], first = 0, False
            large.push(char, positions, common)
            last_large[char] = int(positions[-1])
            induce(positions, common, carried, False, queues)
        lo, hi = bounds[char], bounds[char + 1]
        if lo < hi:
            common = seed_common[lo:hi].copy()
            common[0] = 0 if first else common_prefix(text, last_large[char], int(seeds[lo]), depth)
            induce(seeds[lo:hi], common, carried, False, queues)

    # Descending scan over all suffixes; it places the S suffixes, the greatest first.
    small = SpillingQueues(folder, "small", memory // 2)
    carried = np.zeros(256, np.uint8)
    last_small = [-1] * 256
    for char in range(255, -1, -1):
        first = True
        for positions, common in queues.take(char):
            common = common.copy()
            if first:
                common[0], first = 0, False
            small.push(char, positions, common)
            last_small[char] = int(positions[-1])
            induce(positions, common, carried, True, queues)
        # Backwards each entry is met with its common prefix to the entry before, that is, to the one met next.
        coming = 0 if first or last_large[char] < 0 else common_prefix(text, last_small[char], last_large[char], depth)
        for positions, common in large.latest_first(char):
            met = np.concatenate([[np.uint8(coming)], common[:-1]])
            coming = int(common[-1])
            induce(positions, met, carried, True, queues)

    for char in range(256):
        positions, common = large.whole(char)
        downwards, shared = small.whole(char)
        if len(downwards):
            upwards = np.concatenate([[np.uint8(0)], shared[:0:-1]])
            if len(positions):
                upwards[0] = common_prefix(text, int(positions[-1]), int(downwards[-1]), depth)
            positions, common = np.concatenate([positions, downwards[::-1]]), np.concatenate([common, upwards])
        if len(positions):
            yield positions, common
