import random

import numpy as np
import pytest
import zstandard

from curbside.llm import minhash


def brute_set(text, width=2):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(pairs, width=2):
    sets = [brute_set(t, width) for _, t in pairs]
    label = list(range(len(pairs)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    out = []
    for (i, _), own, shingles in zip(pairs, label, sets, strict=True):
        least = min((d for (d, _), k in zip(pairs, label, strict=True) if k == own and d is not None), default=None)
        out.append((i, len(shingles), least, i == least))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_texts(n, seed, words=120):
    """Texts of which two thirds are earlier ones with a few words changed, so that similarities lie around 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = []
    for k in range(n):
        if k % 3 == 0:
            own = [word() for _ in range(rng.choice([1, 2, 5, 11, words]))]
        else:
            own = list(rng.choice(texts))
            for _ in range(rng.randrange(0, 9) if len(own) > 20 else rng.randrange(2)):
                own[rng.randrange(len(own))] = word()
        texts.append(own)
    return [(k, rng.choice([" ", "\n", " \t"]).join(t)) for k, t in enumerate(texts)]


ODD = [(900, None), (901, " \n"), (902, ""), (903, "Word"), (904, "wORD "), (905, "É é"), (906, "é É"), (907, "a b"), (908, "b a"), (None, "a B"), (None, "nowhere else"), (7, "a b"), (907, "other text here"), (907, "other text here")]


def test_matches_brute_force(make_docs):
    pairs = near_texts(260, 4) + ODD
    got = found(minhash.minhash_components(make_docs(pairs, extra=True)))
    assert got == brute(pairs)
    assert len({c for _, _, c, _ in got}) < len(pairs) - 60


def test_small_blocks_and_other_widths_change_nothing(make_docs):
    """Buckets are cut into blocks of three members; shingles of five words."""
    pairs = near_texts(150, 9)
    assert found(minhash.minhash_components(make_docs(pairs), block_rows=3)) == brute(pairs)
    assert found(minhash.minhash_components(make_docs(pairs), width=5)) == brute(pairs, 5)


def test_codes_of_any_width():
    for width in (1, 2, 3, 5):
        numbers = {}
        for text in ("a b a b c", "b a b a", "a", "c d e f g a b a b c"):
            assert len(minhash._codes(numbers, text, width)) == len(brute_set(text, width))
        a, b = (minhash._codes(numbers, t, width) for t in ("a b a b c", "x a b a b"))
        assert len(np.intersect1d(a, b)) == len(brute_set("a b a b c", width) & brute_set("x a b a b", width))


def test_links_that_no_leader_sees(make_docs):
    """A ring in which every text is near its neighbours only: leaders meet few links, the blocks find the others."""
    rng = random.Random(2)
    own = [f"w{k}" for k in range(100)]
    pairs = []
    for k in range(60):
        for _ in range(5):
            own[rng.randrange(100)] = f"n{k}x{rng.randrange(10**6)}"
        pairs.append((k, " ".join(own)))
    want = brute(pairs)
    assert found(minhash.minhash_components(make_docs(pairs), block_rows=4)) == want


def test_a_group_is_compared_without_all_pairs():
    """Of 600 near copies that leaders left apart, links that join them leave the task, one fewer than there are."""
    import pandas as pd

    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base[: k % 60], f"n{k}", *base[k % 60 + 1 :]]) for k in range(600)]
    words = minhash.Words()
    sigs = np.array([minhash.signature(minhash.shingle_hashes(words, t, 2)[0]) for t in texts])
    keys = minhash.buckets(sigs)
    values, counts = np.unique(keys[:, 0], return_counts=True)
    own = np.flatnonzero(keys[:, 0] == values[counts.argmax()])
    frame = pd.DataFrame({"bucket": values[counts.argmax()], "i": 0, "j": 0, "side": 0, "node": own, "label": own, "signature": [s.tobytes() for s in sigs[own]], "packed": [zstandard.compress(texts[k].encode()) for k in own]})
    parts = [frame.iloc[:100], frame.iloc[100:]]
    links = pd.concat(minhash._compared(2, 80, minhash.MISS)(iter(parts)))
    assert len(own) > 200 and len(links) == len(own) - 1
    assert all(100 * len(brute_set(texts[a]) & brute_set(texts[b])) >= 80 * len(brute_set(texts[a]) | brute_set(texts[b])) for a, b in zip(links["a"], links["b"], strict=True))


def test_signatures_tell_similarity():
    words = minhash.Words()
    rng = random.Random(1)
    for similarity in (0.3, 0.8, 0.95):
        gaps = []
        for _ in range(20):
            union = [f"{rng.random()} {rng.random()}" for _ in range(400)]
            shared = int(400 * similarity)
            rest = (400 - shared) // 2
            a, b = union[: shared + rest], union[:shared] + union[shared + rest :]
            sig = [minhash.signature(np.unique(np.concatenate([minhash.shingle_hashes(words, t, 2)[0] for t in side]))) for side in (a, b)]
            gaps.append((sig[0] == sig[1]).mean() - similarity)
        assert abs(np.mean(gaps)) < 0.03


def test_prune_levels():
    """A level is the largest count whose posterior stays below the miss probability (checked by integration)."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    for k, most in enumerate(minhash.prune_levels()):
        n = (k + 1) * minhash.BATCH
        for m in range(max(0, most), most + 2):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            assert (density[grid >= 0.8].sum() / density.sum() < minhash.MISS) == (m <= most)


def test_equal_sets_of_other_order_are_one_class():
    words, other = minhash.Words(), minhash.Words()
    minhash.shingle_hashes(other, "z y x b a", 2)
    assert minhash.shingle_hashes(words, "A b a b", 2).tobytes() == minhash.shingle_hashes(other, "b a B", 2).tobytes()
    assert minhash.shingle_hashes(words, "a", 2).tobytes() != minhash.shingle_hashes(words, "a a", 2).tobytes()


@pytest.mark.parametrize("pairs", [[], [(1, None), (2, "a"), (2, "a")]])
def test_tiny_tables(make_docs, pairs):
    assert found(minhash.minhash_components(make_docs(pairs))) == brute(pairs)
