import random

import numpy as np
import pytest

from curbside.llm import quality, toxicity
from curbside.llm.linear import fit_logistic

SF = "/root/testdata/sf0.01"
BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return lambda name, sf=SF: spark.read.parquet(f"{sf}/{name}.parquet")


def test_logistic_recovers_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 3))
    y = (rng.random(5000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    model = fit_logistic(x, y, ridge=0.01)
    raw = model.weights[:-1] / model.scale
    assert np.allclose(raw, [2, -1, 0], atol=0.2) and abs(model.weights[-1] - raw @ model.mean - 0.5) < 0.2


def test_toxicity_on_held_out_rows(tables):
    labels = tables("labels", BIG)
    rows = toxicity.toxicity(tables("documents", BIG), labels).join(labels, "doc_id").filter("held_out").toPandas()
    hit = (rows.predicted == 1) & (rows.toxic == 1)
    print(f"precision {hit.sum() / (rows.predicted == 1).sum():.3f}, recall {hit.sum() / (rows.toxic == 1).sum():.3f}")
    assert hit.sum() / (rows.predicted == 1).sum() > 0.95 and hit.sum() / (rows.toxic == 1).sum() > 0.75
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def test_toxicity_never_reads_held_out_labels(spark, tables):
    """Flipping the labels of the held-out fold changes no score."""
    from pyspark.sql import functions as F

    docs, labels = tables("documents"), tables("labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert a == b
    assert {r.doc_id for r in toxicity.toxicity(docs, labels).filter("held_out").collect()} == {r.doc_id for r in docs.filter(fold).collect()}


def test_label_model_finds_the_reliable_voter():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    good, copy = np.where(rng.random(4000) < 0.9, y, ~y), None
    copy = good.copy()
    noise = rng.random(4000) < 0.2
    marks = np.where(rng.random(4000) < 0.9, y, ~y).astype(int)
    p, share, _ = toxicity.label_model(np.stack([good, copy, noise], axis=1), marks, 0.2)
    assert ((p > 0.5) == y).mean() > 0.88
    assert share[0] < 0.7 and share[2] > 0.9  # the copy shares its vote


def test_label_model_finds_how_often_marks_are_right():
    rng = np.random.default_rng(7)
    y = rng.random(20_000) < 0.3
    fired = np.stack([np.where(rng.random(20_000) < a, y, ~y) for a in (0.85, 0.8, 0.9, 0.85)], axis=1)
    marks = np.where(rng.random(20_000) < 0.9, y, ~y).astype(int)
    _, share, mark_rates = toxicity.label_model(fired, marks, 0.3)
    assert abs(mark_rates[1] - 0.9) < 0.03 and abs(mark_rates[0] - 0.1) < 0.03 and share.min() > 0.8


def test_posteriors_by_enumeration():
    """The posterior of a row is the joint probability of its votes under each class, multiplied out vote by vote."""
    rng = np.random.default_rng(4)
    fired, marks = rng.random((50, 6)) < 0.4, (rng.random(50) < 0.5).astype(int)
    rates, mark_rates, share, prior = rng.uniform(0.1, 0.9, (2, 6)), np.array([0.1, 0.8]), rng.uniform(0.3, 1, 6), 0.15
    got = toxicity.vote_odds(fired, marks, rates, mark_rates, share, prior)
    for row, mark, p in zip(fired, marks, got, strict=True):
        joint = [1 - prior, prior]
        for y in (0, 1):
            joint[y] *= mark_rates[y] if mark else 1 - mark_rates[y]
            for k in range(6):
                joint[y] *= (rates[y][k] if row[k] else 1 - rates[y][k]) ** share[k]
        assert abs(p - joint[1] / sum(joint)) < 1e-9


def test_shares_of_correlated_voters():
    rng = np.random.default_rng(5)
    y = rng.random(5000) < 0.5
    votes = [np.where(rng.random(5000) < 0.8, y, ~y) for _ in range(3)]
    fired = np.stack([votes[0], votes[0], votes[0], votes[1], votes[2]], axis=1).astype(float)
    rates = np.stack([fired[~y].mean(axis=0), fired[y].mean(axis=0)])
    share = toxicity.vote_shares(fired, y.astype(float), rates)
    assert np.allclose(share, [1 / 3, 1 / 3, 1 / 3, 1, 1], atol=0.05)


def test_toxicity_of_long_texts_and_repeats(make_docs, tables):
    long = " ".join(r.text for r in tables("documents").limit(50).collect()) * 30
    pairs = [(1, long), (1, long), (2, None), (2, ""), (None, "x")]
    rows = toxicity.toxicity(make_docs(pairs, extra=True), tables("labels")).collect()
    assert len(rows) == 5 and len({r.score for r in rows if r.doc_id == 1}) == 1 and len({r.score for r in rows if r.doc_id == 2}) == 1


def test_quality_on_held_out_rows(tables):
    """Fitted on two folds of the labels by a hash of the id, measured on the third."""
    from pyspark.sql import functions as F

    labels = tables("labels", BIG)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = quality.decisions(tables("documents", BIG), labels.filter(~fold)).join(labels.filter(fold), "doc_id").toPandas()
    assert len(rows) > 1000 and rows[rows.quality == 1].keep.mean() > 0.99 and rows[rows.quality == 0].keep.mean() < 0.05


def test_site_posteriors_against_plain_sums(spark):
    rng = random.Random(6)
    rows = [(f"h{k % 4}", f"p{k % 3}", round(min(1.0, max(0.0, rng.gauss(0.3 + 0.15 * (k % 4), 0.2))), 9)) for k in range(997)] + [("h9", "p0", 0.0), ("", "", 1.0)]
    found, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p_text double"))
    total = sum(p for *_, p in rows) / len(rows)
    assert abs(mean - total) < 1e-8

    def sums(key):
        out = {}
        for row in rows:
            n, s = out.get(key(row), (0, 0.0))
            out[key(row)] = n + 1, s + row[2]
        return out

    def strength(groups):
        n, spread = sum(g[0] for g in groups), sum(g[0] * (g[1] / g[0] - total) ** 2 for g in groups)
        noise = total * (1 - total)
        between = (spread - noise * (len(groups) - 1)) / (n - sum(g[0] ** 2 for g in groups) / n)
        return min(1e4, max(10.0, noise / between - 1)) if between > 0 else 1e4

    hosts, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    a, b = strength(list(hosts.values())), strength(list(paths.values()))
    host = {h: (s + a * total) / (n + a) for h, (n, s) in hosts.items()}
    want = {p: (host[p[0]], (s + b * host[p[0]]) / (n + b)) for p, (n, s) in paths.items()}
    got = {(r.host, r.path): (r.host_posterior, r.path_posterior) for r in found.collect()}
    assert set(got) == set(want) and all(abs(x - y) < 1e-6 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_quality_leaves_other_columns_alone(spark, tables):
    """Columns named like scores or like inner names come through; empty and long texts, repeats and nulls are judged."""
    rows = [(1, "short", "en", "src0"), (2, None, None, None), (2, "", None, None), (3, "word and text. " * 100_000, "en", "src0"), (3, "word and text. " * 100_000, "en", "src0"), (None, "x", "en", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", "'mine' AS p_text", "7 AS _host", "8 AS row", "9 AS `a.b`", "10 AS path", "11 AS keep", "12 AS quality_keep", "13 AS host", "array(1) AS text_")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.kept(docs, none)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    assert quality.kept(docs.limit(0), tables("labels")).count() == 0
    scores = quality.scored(docs, tables("labels"))
    assert scores.count() == len(rows) and {"_host", "row", "a.b", "path", "keep", "host"} <= set(scores.columns)
    assert scores.select("p_text").dtypes == [("p_text", "double")]


def test_sites_shrink_towards_their_parents(spark, tables):
    """A sparse bad site stays near the global rate, a large bad one does not, and no site outweighs a clear text."""
    good = [r.text for r in tables("documents").join(tables("labels"), "doc_id").filter("quality = 1").limit(60).collect()]
    bad = [r.text for r in tables("documents").join(tables("labels"), "doc_id").filter("quality = 0").limit(40).collect()]
    rng = random.Random(3)
    rows = [(k, rng.choice(good), "en", "large good") for k in range(300)] + [(1000 + k, rng.choice(bad), "en", "large bad") for k in range(300)]
    rows += [(2000, bad[0], "en", "sparse bad"), (3000, good[0], "en", "large bad"), (None, None, None, None), (3000, good[0], "en", "large bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "9 AS p_text", "9 AS posterior", "9 AS n")
    out = quality.scored(docs, tables("labels"))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    mean = sum(r.p_text for r in out.collect()) / len(rows)
    assert abs(got[2000].path_posterior - mean) < abs(got[1000].path_posterior - mean)
    assert got[3000].quality_keep and got[0].quality_keep and not got[1000].quality_keep
    assert quality.kept(docs, tables("labels")).columns == docs.columns


def test_empty_tables(spark, make_docs, tables):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.decisions(make_docs([]), tables("labels")).count() == 0
    assert quality.decisions(make_docs([(1, "a"), (2, None)]), none).filter("keep").count() == 2
    assert toxicity.toxicity(make_docs([]), tables("labels")).count() == 0
    assert [r.predicted for r in toxicity.toxicity(make_docs([(1, "a"), (None, None)], extra=True), none).collect()] == [0, 0]
