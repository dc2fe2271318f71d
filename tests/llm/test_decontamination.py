import random

import numpy as np

from curbside.llm import decontamination as d


def distance_within(item, text):
    """Least edit distance of ``item`` to any substring of ``text``."""
    chars, steps = np.array([ord(c) for c in text], np.int32), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, a in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (chars != ord(a)), row[1:] + 1)])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        kind = rng.choice("sid")
        if kind == "s":
            chars[k] = rng.choice("abcxyz")
        elif kind == "i":
            chars.insert(k, rng.choice("abcxyz"))
        elif len(chars) > 1:
            del chars[k]
    return "".join(chars)


def fixture():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.choice([6, 12, 40])))) for k in range(12)]
    items += [(50, "Tiny one"), (51, ""), (52, None), (53, "?!"), (54, "What is two plus two?"), (55, "zed"), (None, "tiny"), (50, "Tiny one")]
    items += [(3, "another text, under the same id: abc abd abe"), (3, "another text, under the same id: abc abd abf")]
    docs = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        if k % 2:
            parts.append(edited(rng, rng.choice([t for _, t in items[:12]]).upper(), rng.choice([0, 1, 2, 4, 9])))
            parts.append(" ".join(word() for _ in range(5)))
        docs.append((k, rng.choice([" ", " -- ", "\n"]).join(parts)))
    docs += [(100, None), (101, ""), (102, "tiny, one!"), (103, "a tiny one more"), (104, "a tiny onerous"), (105, "Well: what is  two plus two? four"), (106, "what is twoplus two"), (107, "what was two plus one")]
    docs += [(108, "zed"), (109, "zeds amazed"), (110, "x " * 5000 + "under the same id, another text under the same id abc abd abx" + " y" * 5000), (111, "another text under the same id abc abd abe"), (112, "¿?")]
    return items, docs + [(1, docs[1][1]), (1, docs[1][1]), (None, docs[1][1]), (None, docs[3][1]), (None, "zed and"), (1, "nothing")]


def brute(items, docs):
    """(doc_id, [(item_id, distance), ...]) of every contaminated row."""
    out = []
    for i, text in docs:
        hits = {}
        for key, item in items:
            a, b = d.normalise(item), d.normalise(text)
            if a and key is not None and (n := distance_within(a, b)) <= (len(a) - 2) // 20:
                hits[key] = min(n, hits.get(key, n))
        if hits:
            out.append((i, sorted(hits.items())))
    return sorted(out, key=str)


def test_matches_brute_force(spark, make_docs, monkeypatch):
    """Every item of one word or more, in every row; neither the number of blocks nor of texts held at once can show."""
    items, docs = fixture()
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, contaminated int")
    want = brute(items, docs)
    assert len(want) > 20 and {102, 103, 105, 106, 108} <= {i for i, _ in want} and not {104, 107, 109} & {i for i, _ in want}
    for size, held in ((d.BLOCK_CHARS, d.HELD_CHARS), (200, 5000), (1, 1), (500, d.HELD_CHARS)):
        monkeypatch.setattr(d, "HELD_CHARS", held)
        rows = d.contaminated(make_docs(docs, extra=True), benchmark, block_chars=size).collect()
        assert sorted(((r.doc_id, list(zip(r.item_ids, r.distances))) for r in rows), key=str) == want
        assert all(r.contaminated and r.n_items == len(r.item_ids) for r in rows)
        clean = d.without_contaminated(make_docs(docs, extra=True), benchmark, block_chars=size)
        left = [(i, t) for i, t in docs if not brute(items, [(i, t)])]
        assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(left, key=str)
        assert clean.columns == make_docs([], extra=True).columns


def test_myers_distance():
    rng = random.Random(5)
    for _ in range(300):
        item = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 90)))
        masks = {}
        for p, char in enumerate(item):
            masks[char] = masks.get(char, 0) | 1 << p
        n = distance_within(item, text)
        assert d.least_distance(len(item), masks, text, len(item) - 1) == (n if n < len(item) else None)


def test_empty_tables(spark, make_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(make_docs([(1, "some text")]), nothing).count() == 0
    assert d.without_contaminated(make_docs([(1, "some text"), (None, None)]), nothing).count() == 2
    assert d.contaminated(make_docs([]), nothing).count() == 0
