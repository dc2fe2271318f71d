"""Ids beyond 2**53 come through every operator unchanged, also where a row of the same batch has none."""

import zlib

import pytest

from curbside.llm import decontamination, html_text, sentencepiece_codec, simhash, token_counts, toxicity

IDS = [2**53 + 1, 2**62 + 1, -(2**60) - 1, None, 7]


@pytest.fixture
def docs(make_docs):
    return make_docs([(i, "the same words for every row of them") for i in IDS]).coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=str)


WANT = sorted(IDS, key=str)


def test_token_counts(docs):
    assert ids(token_counts.token_counts(docs)) == WANT


def test_sentencepiece(docs):
    rows = sentencepiece_codec.encoded(docs, chunk=20).unionAll(sentencepiece_codec.encoded(docs))
    assert ids(rows) == sorted(IDS * 2, key=str) == ids(sentencepiece_codec.decoded(rows))


def test_simhash(docs):
    rows = simhash.simhash_components(docs)
    assert ids(rows) == WANT and {r.component_id for r in rows.collect()} == {-(2**60) - 1}


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(2**53 + 1, "same words for every"), (2**62 + 1, "row of them")], "item_id long, text string")
    rows = decontamination.contaminated(docs, items)
    assert ids(rows) == WANT and {tuple(r.item_ids) for r in rows.collect()} == {(2**53 + 1, 2**62 + 1)}


def test_html(spark):
    pages = spark.createDataFrame([(i, "u", "<p>Some words of a page that are long enough to be its text.</p>") for i in IDS], "page_id long, url string, html string").coalesce(1)
    assert ids(html_text.extracted(pages), "page_id") == WANT


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(2**62 + 1, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels)
    assert ids(rows) == WANT
    assert {r.doc_id: r.held_out for r in rows.collect()} == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in IDS}
