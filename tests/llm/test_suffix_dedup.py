import hashlib
import random
import tempfile

import numpy as np
import pytest

from curbside.llm import suffix_dedup
from curbside.llm.induced_sort import induced_suffixes


@pytest.mark.parametrize("memory", [64, 1 << 20])
def test_induced_order_and_common_prefixes(memory):
    rng = random.Random(memory)
    for trial in range(60):
        text = bytes(rng.choice(rng.choice([b"a", b"ab", b"abc", bytes(range(256))])) for _ in range(rng.choice([1, 2, 50, 200])))
        text += text[: len(text) // 2] + b"z" + text
        depth = rng.choice([5, 50])
        with tempfile.TemporaryDirectory() as folder:
            parts = list(induced_suffixes(np.frombuffer(text, np.uint8), depth, folder, memory))
        order, common = (np.concatenate(c) for c in zip(*parts))
        heads = [text[p : p + depth] for p in order]
        assert sorted(order) == list(range(len(text))) and heads == sorted(heads)
        for a, b, n in zip(heads, heads[1:], common[1:]):
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or n == min(len(a), len(b))


def brute(pairs):
    first = {}
    data = [(i, (t or "").encode()) for i, t in pairs]
    for i, b in data:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i)) if i is not None else first.get(b[p : p + 50], 1 << 60)
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        left = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=2, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(12)]
    pairs = []
    for k in range(n):
        parts = [rng.choice(passage) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        pairs.append((k, rng.choice(["", " ", "\n"]).join(parts)))
    pairs += [(300 + k, pairs[k][1]) for k in range(20)] + [(400, None), (401, ""), (402, "a" * 49), (403, "a" * 49), (404, "a" * 500), (405, "b" + "a" * 70), (406, "ab" * 100), (407, "ba" * 90)]
    return pairs + [(404, "a" * 500), (407, "ba" * 90), (None, "a" * 200)]


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_matches_brute_force(make_docs):
    pairs = corpus()
    assert rows(suffix_dedup.without_repeats(make_docs(pairs, extra=True))) == brute(pairs)


def test_giant_texts_and_small_blocks(make_docs, monkeypatch):
    pairs = corpus(5, 60)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 400)
    parts = list(suffix_dedup._portions([1, 2], [b"x" * 1000, b"y" * 30]))
    assert sum(max(0, len(p) - 49) for _, _, ps in parts for p in ps) == 951
    found = [x for ids, offsets, ps in parts for x in offsets.tolist()]
    assert found[:3] == [0, 200, 400]
    assert rows(suffix_dedup.without_repeats(make_docs(pairs))) == brute(pairs)


def test_blocks_keep_their_arrays():
    arrays = [np.arange(5, dtype="<u8"), np.zeros(0, "<i8"), np.frombuffer(b"abc", np.uint8)]
    back = suffix_dedup._unpack(suffix_dedup._pack(*arrays), "<u8", "<i8", "u1")
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, back))


def test_empty_table(make_docs):
    assert suffix_dedup.without_repeats(make_docs([])).count() == 0


def test_repeats_of_a_giant_text_settled_in_one_part(spark):
    """One part of document 5 shares a batch with document 9, another part does not; both hold the anchor."""
    where = np.arange(2, dtype=np.int64) << 8 | 4
    block = suffix_dedup._pack(np.array([7, 7], "<u8"), np.array([5, 5], "<i8"), np.zeros(2, "<i8"), where | [suffix_dedup._FIRST_KNOWN, suffix_dedup._FIRST])
    rows = [b for b in suffix_dedup._repeated_anchors(iter([suffix_dedup.pa.RecordBatch.from_arrays([suffix_dedup.pa.array([0]), suffix_dedup.pa.array([block])], names=["bucket", "block"])]))]
    assert sum(b.num_rows for b in rows) == 2


def test_parts_are_cut_in_the_workers(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 400)
    header = "a running header of some twenty bytes or more that stands on every page "
    rng = random.Random(3)
    page = lambda: header + "".join(rng.choice("abcdefgh ") for _ in range(130))
    book = "".join(page() for _ in range(12))
    pairs = [(5, book), (9, book[400:700]), (10, "x" + book[1500:1640])]
    assert rows(suffix_dedup.without_repeats(make_docs(pairs))) == brute(pairs)


def test_different_texts_under_one_id(make_docs):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    x, y, z = text(300), text(400), text(90)
    pairs = [(3, x), (7, x), (7, y), (8, y[100:300] + z), (8, z[:60]), (8, text(500) + y[50:200]), (9, z + text(40)), (9, z + text(40)), (7, x)]
    assert rows(suffix_dedup.without_repeats(make_docs(pairs))) == brute(pairs)
