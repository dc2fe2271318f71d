import numpy as np
import pytest
from test_decontamination import brute as brute_leaks
from test_exact_dedup import brute as brute_copies
from test_simhash import brute_components

import corpus_pipeline
from curbside.llm import sentencepiece_codec as codec
from curbside.llm.pieces import vocabulary
from curbside.llm.token_counts import MODEL_FILE


@pytest.fixture
def folder(spark, tmp_path):
    """A small data folder: part of the synthetic documents with copies, near copies, leaks, nulls and repeated rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()
    rows = [tuple(r) for r in docs]
    rows += [(1000 + k, r.text.upper() if k % 2 else r.text, r.lang, r.source, r.n_chars) for k, r in enumerate(docs[:15])]
    rows += [(2000 + k, r.text.rsplit(" ", 1)[0] + " xx", r.lang, r.source, r.n_chars) for k, r in enumerate(docs[15:30])]
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    rows += [(3000, docs[40].text + " " + item, "en", "src1", 0), (3001, None, None, None, None), (3001, None, None, None, None), (3002, "", "en", "src2", 0)]
    spark.createDataFrame(rows, docs and "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    benchmark = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        pairs = [(r.doc_id, r.text) for r in before]
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        got = sorted(r.doc_id for r in docs.collect())
        if name == "exact_dedup":
            assert got == sorted({r[0] for r in brute_copies(pairs) if r[3]})
        elif name == "simhash_near_dedup":
            assert got == [i for i, _, c in brute_components(pairs) if i == c]
        elif name == "benchmark_decontamination":
            leaks = {i for i, _ in brute_leaks(benchmark, pairs)}
            assert leaks and got == sorted(i for i, _ in pairs if i not in leaks)
        elif name == "sentencepiece":
            words = vocabulary(MODEL_FILE)
            memo = codec._packed(words)
            assert {r.doc_id: bytes(r.ids) for r in docs.collect()} == {i: codec.encode(words, memo, t) for i, t in pairs}
            assert all(np.frombuffer(r.ids, "<i4").max(initial=0) < 32_000 for r in docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and len(got) > 20
    assert len(got) == corpus_pipeline.run(spark, folder).count()


def rewritten(spark, folder, tmp_path, docs):
    """A data folder like ``folder`` with other documents."""
    docs.write.parquet(str(tmp_path / "other" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / "other" / f"{name}.parquet"))
    return str(tmp_path / "other")


def test_rows_that_share_an_id(spark, folder, tmp_path):
    """Each row is judged by its own text; columns with the names of inner ones come through."""
    good = [r for r in spark.read.parquet(f"{folder}/documents.parquet").filter("n_chars > 400").limit(12).collect()]
    a, b, c = (r.text for r in good[:3])
    rows = [(5, a), (5, b), (9, b), (9, c.upper()), (9, c), (9, c), (None, c), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS keep", "2 AS host", "3 AS _own", "4 AS row", "5 AS digest", "6 AS component", "7 AS p_text", "8 AS key")
    other = rewritten(spark, folder, tmp_path, docs)
    exact = corpus_pipeline.exact_dedup_stage(spark, docs, other)
    left = sorted(((r.doc_id, r.text.lower()) for r in exact.collect()), key=str)
    assert left == sorted([(5, a.lower()), (9, b.lower()), (9, c.lower())], key=str) and exact.columns == docs.columns
    near = corpus_pipeline.simhash_stage(spark, docs, other)
    assert sorted((r.doc_id, r.text.lower()) for r in near.collect()) == sorted([(5, a.lower()), (5, b.lower()), (9, c.lower())]) and near.columns == docs.columns
    assert corpus_pipeline.run(spark, other).count() <= 3


def test_empty_table(spark, folder, tmp_path):
    other = rewritten(spark, folder, tmp_path, spark.read.parquet(f"{folder}/documents.parquet").limit(0))
    assert corpus_pipeline.run(spark, other).count() == 0
