import hashlib
import os
import random
from collections import Counter
from pathlib import Path

import pytest

from curbside.llm import alignment

pytestmark = pytest.mark.skipif(not Path(alignment.FILE_A).is_file(), reason="vocabularies are not here")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = Tokenizer.from_file(alignment.FILE_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.FILE_B)


def tokens(libraries, text):
    """Ids and bytes of a text by both libraries, each text encoded whole."""
    a, b = libraries
    if not text:
        return [], []
    alphabet = alignment.byte_alphabet()
    of_a = [(k, bytes(alphabet[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
    of_b = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
    raw = (" " + text).encode()
    return (of_a, of_b) if b"".join(x for _, x in of_a) == raw == b"".join(x for _, x in of_b) else ([], [])


def brute(libraries, pairs):
    rows, totals = [], Counter()
    for i, text in pairs:
        of_a, of_b = tokens(libraries, text)
        ends_a, ends_b, at = [], [], 0
        for side, ends in ((of_a, ends_a), (of_b, ends_b)):
            at = 0
            for _, x in side:
                at += len(x)
                ends.append(at)
        links = [(a[0], b[0]) for a, e in zip(of_a, ends_a, strict=True) for b, f in zip(of_b, ends_b, strict=True) if e == f]
        cuts = [0, *sorted(set(ends_a) & set(ends_b))]
        inside = lambda side, ends, lo, hi: ",".join(str(t[0]) for t, e in zip(side, ends, strict=True) if lo < e <= hi)
        groups = ";".join(f"{inside(of_a, ends_a, lo, hi)}|{inside(of_b, ends_b, lo, hi)}" for lo, hi in zip(cuts, cuts[1:], strict=False))
        totals.update(links)
        rows.append((i, len(of_a), len(of_b), len(cuts) - 1, links, groups))
    most = Counter()
    for (_, b), n in totals.items():
        most[b] = max(most[b], n)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return sorted(((i, na, nb, ng, len(x), sum(totals[p] == most[p[1]] for p in x), sum(totals[p] for p in x), digest(g)) for i, na, nb, ng, x, g in rows), key=str)


def texts():
    rng = random.Random(5)
    words = ["the", "of", "Internationalization", "naïve", "日本語", "x", "  ", "\n", "\t", "123456", "don't", "I'LL", "🙂", "é", "é", "-", "...", "<|endoftext|>", "<s>", " ", "ÉÉ"]
    made = [(k, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.choice([1, 3, 30])))) for k in range(60)]
    odd = [None, "", " ", "   ", "a▁b", "\x00", "a b\u0085c", "<|endoftext|>", "ends with space ", " starts with it", "\n\n\n", "the the the", "the the the", "<0x41>", "a  b   c"]
    return made + [(100 + k, t) for k, t in enumerate(odd)] + [(None, "the of"), (2**53 + 1, "the x"), (2**62, "x"), (3, "repeated id")]


def test_matches_brute_force(libraries, make_docs):
    pairs = texts()
    got = sorted((tuple(r) for r in alignment.aligned(make_docs(pairs, extra=True)).collect()), key=str)
    assert got == brute(libraries, pairs)


def test_groups_and_links(libraries, make_docs):
    row = alignment.encoded_pairs(make_docs([(1, "Internationalization naïve")])).first()
    of_a, of_b = tokens(libraries, "Internationalization naïve")
    assert [int(x) for g in row.groups.split(";") for x in g.split("|")[0].split(",")] == [k for k, _ in of_a]
    assert [int(x) for g in row.groups.split(";") for x in g.split("|")[1].split(",")] == [k for k, _ in of_b]
    assert sum(x.times for x in row.links) == row.n_links == row.n_groups


def test_long_texts_equal_the_libraries(libraries):
    """Runs without a space, long white space, and a long text of ordinary words; encoded whole by both libraries."""
    rng = random.Random(6)
    aligner = alignment.Aligner(alignment.FILE_A, alignment.FILE_B)
    for text in ("a" * 50_000, "\n" * 30_000 + "x", "日本" * 9_000, " ".join("".join(rng.choices("abcdeé.,", k=rng.randrange(1, 9))) for _ in range(20_000))):
        (a, b), = aligner.tokens([text])
        of_a, of_b = tokens(libraries, text)
        assert a.tolist() == [k for k, _ in of_a] and b.tolist() == [k for k, _ in of_b]


def test_every_character_splits_alike(libraries):
    """The fast library and the one that the vocabulary is made for cut every assigned character alike (one in 37 tried)."""
    fast = alignment.ByteLevel(alignment.FILE_A)
    found = [f" a{chr(c)}1 {chr(c)}{chr(c)} b{chr(c)}\n" for c in range(1, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    assert [fast.encode(t) for t in found] == [e.ids for e in libraries[0].encode_batch(found, add_special_tokens=False)]


def test_empty_table(make_docs):
    assert alignment.aligned(make_docs([])).count() == 0
    assert [r.n_links for r in alignment.aligned(make_docs([(1, None)])).collect()] == [0]
