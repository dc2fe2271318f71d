import hashlib
import random

from curbside.llm.exact_dedup import exact_dedup, kept


LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(pairs):
    texts = [(t or "").translate(LOWER) for _, t in pairs]
    out = []
    for (i, _), own in zip(pairs, texts, strict=True):
        ids = [j for (j, _), other in zip(pairs, texts, strict=True) if other == own]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(own.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(make_docs):
    rng = random.Random(1)
    texts = [None, "", "A", "a", "É", "é", " a", "x" * 50_000, "X" * 50_000, "b\nB", "ß"]
    pairs = [(k, rng.choice(texts)) for k in range(200)] + [(7, "a"), (7, "a"), (None, "only null id"), (None, "É")]
    found = sorted((tuple(r) for r in exact_dedup(make_docs(pairs, extra=True)).collect()), key=str)
    assert found == brute(pairs)


def test_empty_table(make_docs):
    assert exact_dedup(make_docs([])).count() == 0


def test_kept_rows(make_docs):
    """Rows are judged by their texts, whatever ids they share; one row of each group stays."""
    pairs = [(5, "alpha"), (5, "beta"), (9, "beta"), (9, "BETA"), (9, "gamma"), (9, "gamma"), (None, "alpha"), (None, "x"), (None, "x"), (None, None), (None, "")]
    got = kept(make_docs(pairs, extra=True))
    rows = [(r.doc_id, r.text) for r in got.collect()]
    beta = max(("beta", "BETA"), key=lambda t: hashlib.sha256(t.encode()).digest())
    assert sorted((r for r in rows if r[1]), key=str) == sorted([(5, "alpha"), (9, beta), (9, "gamma"), (None, "x")], key=str)
    assert len(rows) == 5 and got.columns == make_docs([], extra=True).columns
    assert kept(make_docs([])).count() == 0


def test_contents_are_combined_by_hash(spark, make_docs):
    """No map task sorts its rows by their contents."""
    from curbside.llm import exact_dedup as module

    plans = []
    real = module.cut
    try:
        module.cut = lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1]
        module.groups(make_docs([(1, "a"), (2, "A")]))
    finally:
        module.cut = real
    assert "HashAggregate" in plans[0] and "SortAggregate" not in plans[0]
