import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from curbside.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
DATA = "/root/testdata/sf0.001"


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, top=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort()
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scores[:top])]
    return sorted(out, key=str)


def texts(n, seed):
    """Texts over a vocabulary with frequent and rare terms; copies make equal scores."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(80)]
    weights = [1 / (k + 1) for k in range(80)]
    made = [" ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 300]))) for _ in range(n)]
    return [(k, t if k % 7 else rng.choice(made)) for k, t in enumerate(made)]


ODD_DOCS = [(None, "w3 w70"), (None, None), (5000, ""), (5001, "  -- "), (5002, "É é W3,w3"), (5003, "é\x00w3\x7fw70"), (5, "w70 w3 unlike"), (6, "w70"), (6, "w70")]
ODD_ITEMS = [(90, None), (91, "?!"), (92, "É"), (93, "w70 w70 W70 w3"), (94, "nowhere"), (None, "w5 w71"), (95, "w1"), (95, "w2"), (95, "w2"), (96, "w0")]


def make_items(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS doc_id")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("block_chars", "shard_postings"), [(lexical.BLOCK_CHARS, lexical.SHARD_POSTINGS), (40, 60)])
def test_matches_brute_force(spark, make_docs, block_chars, shard_postings):
    """Whole, and with queries in many blocks and documents in many shards."""
    docs = texts(400, 1) + ODD_DOCS
    rng = random.Random(2)
    items = ODD_ITEMS + ([(k, " ".join(f"w{min(79, int(rng.expovariate(0.05)))}" for _ in range(12))) for k in range(20)] if block_chars > 40 else [])
    frame = make_docs(docs, extra=True).repartition(3)
    assert found(lexical.ranked(frame, make_items(spark, items), block_chars=block_chars, shard_postings=shard_postings)) == brute(docs, items)


def test_non_essential_lists_are_only_probed():
    """A frequent term's list is not read whole once a rare one has named the candidates, and the result is the same."""
    rng = np.random.default_rng(3)
    n = 20_000
    has = [np.array([0, *([1] if k % 400 == 0 else []), *([2] if k % 3 == 0 else [])], "<i4") for k in range(n)]
    times = [np.ones(len(t), "<i4") for t in has]
    lengths = rng.integers(1, 900, n)
    weights = np.array([60, 6000, 900], np.int64)
    shard = lexical.Shard(pa.array(np.arange(n)), lengths, [t.tobytes() for t in has], [t.tobytes() for t in times], weights, n, int(lengths.sum()))
    docs, sums = shard.best(Counter({0: 1, 1: 1, 2: 2}), 20)
    scale = 75 + 25 * lengths * n // int(lengths.sum())
    full = np.array([sum(q * weights[t] * (10**9 // (1000 + 12 * scale[k])) for t, q in ((0, 1), (1, 1), (2, 2)) if t in has[k]) for k in range(n)])
    order = np.lexsort((np.arange(n), -full))[:20]
    assert docs.tolist() == order.tolist() and sums.tolist() == full[order].tolist()
    assert 0 < shard.probed < n // 10 and not shard.sums.any()


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="test tables are not here")
def test_same_rows_as_sql(spark):
    import duckdb

    from curbside.llm import queries

    got = queries.op13_lexical_search(spark, DATA)
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    want = connection.execute(lexical.ORACLE_SQL)
    assert [c[0] for c in want.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_empty_tables(spark, make_docs):
    assert lexical.ranked(make_docs([]), make_items(spark, [(1, "w1")])).count() == 0
    assert lexical.ranked(make_docs([(1, "w1")]), make_items(spark, [])).count() == 0
    assert lexical.ranked(make_docs([(1, None)]), make_items(spark, [(1, "w1")])).columns == ["item_id", "rank", "doc_id", "score"]
