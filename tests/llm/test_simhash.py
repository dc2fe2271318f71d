import random
import time

import numpy as np
import pandas as pd
import xxhash

from curbside.llm import simhash


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    fps = [(i, brute_fingerprint(t)) for i, t in pairs]
    label = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, f in fps:
            for j, g in fps:
                if bin(f ^ g).count("1") <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return sorted((i, f"{f:016x}", label[i]) for i, f in fps)


def near_texts(n=120, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    pairs = []
    for k in range(n):
        if k % 3 or not pairs:
            words = [word() for _ in range(rng.choice([0, 1, 3, 4, 5, 200]))]
        else:
            words = (rng.choice(pairs)[1] or "").split()
            for _ in range(2):
                if words:
                    words[rng.randrange(len(words))] = word()
        pairs.append((k, rng.choice([" ", "\n", " \t"]).join(words)))
    return [*pairs, (500, None), (501, "  "), (502, "É É É É"), (503, "é É É É"), (503, "é É É É")]


def test_matches_brute_force(make_docs):
    pairs = near_texts()
    found = sorted(tuple(r) for r in simhash.simhash_components(make_docs(pairs, extra=True)).collect())
    assert found == brute_components(pairs)
    assert len({c for _, _, c in found}) < len(pairs) - 20


def test_split_shards_change_nothing(make_docs):
    """Shards of more than two fingerprints are split before they are dealt."""
    pairs = near_texts(200, 5)
    found = simhash._members(make_docs(pairs), False, split_rows=2, sampled=1).select("doc_id", "fp", "component_id").collect()
    assert sorted((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found) == brute_components(pairs)


def labels_of(fps, links):
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert (x ^ y).bit_count() <= 4
            root[max(find(x), find(y))] = min(find(x), find(y))
    return [find(int(f)) for f in fps]


def test_dense_shard_is_linked_without_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = np.unique(np.array([b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i in range(40) for j in range(40)], np.uint64))
    links = simhash._linked(fps)
    assert sum(len(a) for a, _ in links) == len(fps) - 3 and len(set(labels_of(fps, links))) == 3


def test_sparse_shard_is_split():
    """A shard of 100,000 unlike fingerprints that share 22 bits, a few of them near: no work on all pairs."""
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**42, 100_000, dtype=np.uint64) | np.uint64(5 << 60))
    flips = np.array([sum(1 << int(b) for b in rng.choice(42, n, replace=False)) for n in rng.integers(1, 6, 500)], np.uint64)
    fps = np.unique(np.concatenate([fps, fps[:500] ^ flips]))
    began = time.process_time()
    links = simhash._linked(fps)
    took = time.process_time() - began
    assert took < 10
    near = np.concatenate([np.flatnonzero(np.bitwise_count(fps ^ f) <= 4) for f in (fps[:300] ^ np.uint64(0))])
    labels = dict(zip(fps.tolist(), labels_of(fps, links), strict=True))
    for f in np.concatenate([fps[:300], (fps[near])]):
        others = fps[np.bitwise_count(fps ^ f) <= 4].tolist()
        assert {labels[o] for o in others} == {labels[int(f)]}


def test_leaves_meet_every_near_pair():
    """At each of three levels two fingerprints within the radius share a shard."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    b = a ^ np.array([sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for n in rng.integers(0, 5, 400)], np.uint64)
    split = []
    for level in range(3):
        shards = [pd.concat(simhash._shards(split)(iter([pd.DataFrame({"fp": x.view(np.int64)})]))) for x in (a, b)]
        held = [set(zip(f["shard"], f["fp"], strict=True)) for f in shards]
        by_fp = [{}, {}]
        for k in range(2):
            for shard, fp in held[k]:
                by_fp[k].setdefault(fp, set()).add(shard)
        assert all(by_fp[0][int(x)] & by_fp[1][int(y)] for x, y in zip(a.view(np.int64), b.view(np.int64), strict=True))
        split.append(np.unique(np.concatenate([f["shard"] for f in shards]))[::2])


def test_kept_rows(make_docs):
    near = " ".join(f"w{k}" for k in range(300))
    pairs = [(5, near), (9, near + " x"), (9, "other"), (9, "other"), (3, "something else here now"), (5, "something else here now"), (None, "lonely"), (None, "lonely"), (None, "other")]
    got = simhash.kept(make_docs(pairs, extra=True))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(5, near), (9, "other"), (3, "something else here now"), (None, "lonely")], key=str)
    assert got.columns == make_docs([], extra=True).columns
    assert simhash.kept(make_docs([])).count() == 0


def test_empty_table(make_docs):
    assert simhash.simhash_components(make_docs([])).count() == 0
