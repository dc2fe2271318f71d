import hashlib
import random
import struct
from functools import reduce

import numpy as np
import pytest
import sentencepiece

from curbside.llm import sentencepiece_codec as codec
from curbside.llm.pieces import Memo, vocabulary
from curbside.llm.token_counts import MODEL_FILE, score_and_count, token_counts


def _varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The library's own unigram decoder over the same pieces: a copy of the model with its type set to unigram.

    Runs of spaces have the score -1e9, beside which the library's 32-bit sums lose all smaller scores. The copy gives
    them -40000, so that both sides add whole numbers exactly.
    """
    data = open(MODEL_FILE, "rb").read()
    out, at = b"", 0
    while at < len(data):
        tag, body = _varint(data, at)
        size, body = _varint(data, body)
        field = data[at : body + size]
        if tag >> 3 == 2:  # trainer_spec; a later value of a field (3: model_type) replaces the earlier one
            spec = data[body : body + size] + b"\x18\x01"
            length, n = b"", len(spec)
            while n > 127:
                length, n = length + bytes([n & 127 | 128]), n >> 7
            field = b"\x12" + length + bytes([n]) + spec
        elif tag >> 3 == 1:
            field = field.replace(struct.pack("<f", -1e9), struct.pack("<f", -4e4))
        out, at = out + field, body + size
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(out)
    return str(path)


ALPHABET = ["the", " ", " ", "tion", "é", "ß", "ab", "x", "\n", "日", "😀", "▁", "ing", "  ", "q", "0", "%%%"]


def texts(n=300, seed=5):
    rng = random.Random(seed)
    return ["", " ", "  ", "▁", "a", *("".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 40))) for _ in range(n))]


def test_same_ids_as_the_library(unigram):
    words, model = vocabulary(unigram), sentencepiece.SentencePieceProcessor(model_file=unigram)
    memo = codec._packed(words)
    for text in texts():
        ids = np.frombuffer(codec.encode(words, memo, text), "<i4").tolist()
        assert ids == model.encode(text), text
        if text:
            assert score_and_count(words, words.escaped(text))[1] == len(ids)
        assert codec.decode(words, np.array(ids)) == model.decode(ids)


@pytest.mark.parametrize("chunk", [17, 40, 64])
def test_chunks_give_the_same_ids(chunk):
    words = vocabulary(MODEL_FILE)
    scores, memo = Memo(lambda s: words.segment(s)[0]), codec._packed(words)
    rng = random.Random(chunk)
    for k in range(40):
        alphabet = [a for a in ALPHABET if k % 2 or " " not in a]
        text = "".join(rng.choice(alphabet) for _ in range(200))
        if k == 0:
            text = "a" * 500
        if k == 1:
            text = " " * 300
        whole = words.escaped(text)
        parts = [(whole[at : at + chunk + words.longest - 1], min(chunk, len(whole) - at)) for at in range(0, len(whole), chunk)]
        path = codec.states_between([codec.transfer(words, scores, *p) for p in parts], 0, 0)
        got = b"".join(codec.trace_chunk(words, memo, *p, a, b) for p, a, b in zip(parts, path, path[1:]))
        assert got == codec.encode(words, memo, text), text


def test_products_are_associative():
    """Any bracketing gives the same map, and its order of entries is the one of the whole stretch."""
    words = vocabulary(MODEL_FILE)
    scores = Memo(lambda s: words.segment(s)[0])
    rng = random.Random(12)
    for text in ("a" * 160, "".join(rng.choice(["the", "ing", "x", "日", "tt"]) for _ in range(80)), " the ab" * 30):
        whole = words.escaped(text)
        tail = words.longest - 1
        maps = [codec.transfer(words, scores, whole[at : at + 30 + tail], 30) for at in range(0, 120, 30)]
        left = reduce(codec.product, maps)
        right = codec.product(maps[0], codec.product(maps[1], codec.product(maps[2], maps[3])))
        paired = codec.product(codec.product(maps[0], maps[1]), codec.product(maps[2], maps[3]))
        direct = codec.transfer(words, scores, whole[: 120 + tail], 120)
        for other in (right, paired, direct):
            assert (left[0] == other[0]).all()
            reached = left[0] > codec.NEVER
            for b in range(len(left[0])):
                on = np.flatnonzero(reached[:, b])
                assert (np.argsort(left[1][on, b]) == np.argsort(other[1][on, b])).all()


@pytest.mark.parametrize("fan_in", [2, 3])
def test_levels_of_the_scan(make_docs, fan_in):
    """Texts of many chunks go up and down several levels, with the ids of the single pass."""
    pairs = [(1, "ing" * 3000), (2, "the ab " * 1500), (3, "a" * 4100), (4, "▁x y" * 1200), (5, None), (6, "short"), (7, "a" * 4095)]
    rows = codec.encoded(make_docs(pairs), chunk=256, fan_in=fan_in).collect()
    words = vocabulary(MODEL_FILE)
    memo = codec._packed(words)
    assert {r.doc_id: bytes(r.ids) for r in rows} == {i: codec.encode(words, memo, t) for i, t in pairs}
    assert {r.doc_id for r in rows if not r.round_trip} == {4}
    marked = codec.decode(words, np.frombuffer(codec.encode(words, memo, pairs[3][1]), "<i4"))
    assert {r.decoded_sha256 for r in rows if r.doc_id == 4} == {hashlib.sha256(marked.encode()).hexdigest()}


def test_query_rows(make_docs):
    pairs = list(enumerate(texts(40))) + [(900, None), (901, "the ab " * 9000), (902, "the ab " * 9000), (902, "ing" * 20000), (None, "x")]
    rows = codec.encoded(make_docs(pairs, extra=True), chunk=4096).collect()
    words = vocabulary(MODEL_FILE)
    memo = codec._packed(words)
    want = sorted((str(i), codec.encode(words, memo, t)) for i, t in pairs)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in rows) == want
    assert all(r.round_trip == ("▁" not in (dict(pairs)[r.doc_id] or "")) for r in rows if r.doc_id != 902)
    counts = {(str(r.doc_id), r.n_tokens) for r in token_counts(make_docs(pairs, extra=True)).collect()}
    assert counts == {(i, len(b) // 4) for i, b in want}
    back = {(r.doc_id, r.text) for r in codec.decoded(codec.encoded(make_docs(pairs), chunk=4096)).collect()}
    assert all((i, t or "") in back for i, t in pairs if "▁" not in (t or ""))


def test_damage_shows():
    """Every row is decoded from its own ids: one that is wrong, lost or doubled is seen."""
    words = vocabulary(MODEL_FILE)
    memo = codec._packed(words)
    text = "the ab and naïve 日本"
    ids = np.frombuffer(codec.encode(words, memo, text), "<i4")
    assert codec._checked(words, text, ids.tobytes())[-1]
    for wrong in (np.concatenate([ids[:3], [words.ids["x"]], ids[4:]]), np.delete(ids, 2), np.repeat(ids, [2, *[1] * (len(ids) - 1)])):
        row = codec._checked(words, text, wrong.astype("<i4").tobytes())
        assert not row[-1] and row[3] == hashlib.sha256(text.encode()).hexdigest() != row[4]


def test_parts_are_where_paths_are_cut():
    words = vocabulary(MODEL_FILE)
    memo = codec._packed(words)
    for segment in ("▁the.\nOther", "▁▁日本x", "\n\n", "▁qzxjw"):
        assert "".join(words.parts(segment)) == segment
        assert np.frombuffer(memo[segment], "<i4").tolist() == words.segment(segment)[1]


def test_empty_table(make_docs):
    assert codec.encoded(make_docs([])).count() == 0
    assert token_counts(make_docs([])).count() == 0
