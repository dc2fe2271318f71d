"""Ranked lexical search of many queries by MaxScore over shards of documents.

1. One pass over the documents counts the terms that some query holds: a row for each document, kept in the shared folder.
2. Two numbers for the whole corpus and one document count for each query term give the weights.
3. A shard is what a task holds of those rows, up to SHARD_POSTINGS postings. There every term has a list of documents with
   its integer contributions, and their maximum is the list's upper bound. A query takes its lists by falling bound. As
   long as the bounds of the lists not yet taken add up to the k-th best sum so far or more, the next list is essential:
   it is read whole, and its documents become candidates. From then on no new document can qualify; the other lists are
   non-essential and are probed for the candidates only, which leave as soon as their sum and the bounds still to come
   cannot reach the k-th best.
4. The best of every shard are merged by query.

Queries are a stated set. They are sent to the tasks in blocks of bounded size, one block at a time, and what a block
found is written before the next one is read; so neither the driver nor a task ever holds more than one block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbside.llm.common import stored

TOP = 20
#: Postings of one shard, and characters of the queries sent at once.
SHARD_POSTINGS, BLOCK_CHARS = 4 << 20, 4 << 20
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_NO_ID = np.iinfo(np.int64).max
_FOUND = "key int, item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


class Numbers(dict):
    """A number for each query term; -1 for any other."""

    def __missing__(self, term: bytes) -> int:
        return -1


class Block:
    """Queries (item_id, text) with the numbers of their terms."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.numbers = Numbers()
        self.items = [(i, Counter(self.numbers.setdefault(t, len(self.numbers)) for t in terms_of(text))) for i, text in items]


def _counted(sent):
    """Batches (doc_id, text) as doc_id, number of terms, and the query terms among them with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value.numbers
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in batch.column(1).to_pylist():
                found = terms_of(text)
                known = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                term, tf = np.unique(known[known >= 0], return_counts=True)
                sizes.append(len(found))
                terms.append(term.astype("<i4").tobytes())
                times.append(tf.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], names=["doc_id", "n", "terms", "times"])

    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a batch by term."""
    for batch in batches:
        term, df = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df, pa.int64())], names=["term", "df"])


class Shard:
    """Postings of a part of the documents, with contributions and upper bounds by term."""

    def __init__(self, doc_ids: pa.Array, lengths: np.ndarray, terms: list[bytes], times: list[bytes], weights: np.ndarray, n_docs: int, n_terms: int):
        self.doc_ids = doc_ids
        order = doc_ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        self.rank = np.empty(len(order), np.int64)  # place of each document by its id
        self.rank[np.argsort(order, kind="stable")] = np.arange(len(order))
        scale = 75 + 25 * lengths * n_docs // n_terms
        term = np.frombuffer(b"".join(terms), "<i4")
        tf = np.frombuffer(b"".join(times), "<i4").astype(np.int64)
        doc = np.repeat(np.arange(len(order), dtype=np.int32), np.array([len(t) // 4 for t in terms], np.int64))
        by_term = np.argsort(term, kind="stable")
        term, self.docs, tf = term[by_term], doc[by_term], tf[by_term]
        self.gains = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * scale[self.docs]))
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        ends = np.concatenate([starts[1:], [len(term)]]).astype(np.int64)
        tops = np.maximum.reduceat(self.gains, starts) if len(term) else starts
        self.lists = {t: (a, b, top) for t, a, b, top in zip(term[starts].tolist(), starts.tolist(), ends.tolist(), tops.tolist(), strict=True)}
        self.sums = np.zeros(len(order), np.int64)
        self.probed = 0  # candidates looked up in non-essential lists

    def best(self, query: Counter, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with the ``top`` highest scores above 0, equal ones by ascending doc_id, and their scores."""
        lists = sorted(((times * self.lists[t][2], times, *self.lists[t][:2]) for t, times in query.items() if t in self.lists), reverse=True)
        rest = np.concatenate([np.cumsum([bound for bound, *_ in lists][::-1], dtype=np.int64)[::-1], [0]]) if lists else np.zeros(1, np.int64)
        level, k = 0, 0
        while k < len(lists) and rest[k] >= level:  # essential
            _, times, a, b = lists[k]
            self.sums[self.docs[a:b]] += times * self.gains[a:b]
            k += 1
            if len(self.sums) >= top and self.sums.max() > rest[k]:
                level = int(np.partition(self.sums, -top)[-top])
        docs = np.flatnonzero(self.sums)
        sums = self.sums[docs]
        self.sums[docs] = 0
        while True:
            keep = sums + rest[k] >= level
            docs, sums = docs[keep], sums[keep]
            if k == len(lists):
                break
            _, times, a, b = lists[k]
            self.probed += len(docs)
            at = np.searchsorted(self.docs[a:b], docs)
            hit = np.flatnonzero(self.docs[a:b][np.minimum(at, b - a - 1)] == docs)
            sums[hit] += times * self.gains[a:b][at[hit]]
            k += 1
            if len(sums) >= top:
                level = max(level, int(np.partition(sums, -top)[-top]))
        docs, sums = docs[sums > 0], sums[sums > 0]
        order = np.lexsort((self.rank[docs], -sums))[:top]
        return docs[order], sums[order]


def _searched(sent, weights, n_docs: int, n_terms: int, top: int, shard_postings: int):
    """Counted rows as the best documents of each query in each shard."""

    def best(held: list[pa.RecordBatch], block: Block) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, lengths, terms, times = (table.column(k) for k in range(4))
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        shard = Shard(ids, lengths.to_numpy(), terms.to_pylist(), times.to_pylist(), weights.value, n_docs, n_terms)
        keys, items, docs, scores = [], [], [], []
        for key, (item_id, query) in enumerate(block.items):
            found, sums = shard.best(query, top)
            keys += [key] * len(found)
            items += [item_id] * len(found)
            docs.append(found)
            scores.append(sums)
        at = np.concatenate([np.empty(0, np.int64), *docs])
        own = [pa.array(keys, pa.int32()), pa.array(items, pa.int64()), shard.doc_ids.take(pa.array(at)), pa.array(np.concatenate([np.empty(0, np.int64), *scores]))]
        return pa.RecordBatch.from_arrays(own, names=["key", "item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(2).nbytes // 4
            if size >= shard_postings:
                yield best(held, sent.value)
                held, size = [], 0
        if held:
            yield best(held, sent.value)

    return run


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row["text"] or "") > block_chars:
            yield held
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
    if held:
        yield held


def _search_block(docs: DataFrame, items: list[tuple], top: int, shard_postings: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    block = Block(items)
    sent = context.broadcast(block)
    counted = stored(docs.mapInArrow(_counted(sent), "doc_id long, n long, terms binary, times binary"), "lexical-counts").filter("n > 0")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = counted.select("terms").mapInArrow(_holders, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(max(1, len(block.numbers)), np.int64)
    for row in holders.toLocalIterator():  # at most one row for each term of the block
        weights[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
    weighed = context.broadcast(weights)
    found = counted.mapInArrow(_searched(sent, weighed, n_docs, n_terms, top, shard_postings), _FOUND)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = stored(ranked.select("item_id", "rank", "doc_id", "score"), "lexical-found")
    sent.unpersist()
    weighed.unpersist()
    return out


def ranked(docs: DataFrame, queries: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The ``top`` documents of ``docs`` (doc_id, text, ...) for each row of ``queries`` (item_id, text, ...): item_id, rank
    (from 1), doc_id, score. Documents without a score above 0 give no row.

    Terms, weights and scores are those of the module's contract: N documents with a term, L terms in all; a term of df
    documents weighs floor(1000 * ln((2N + 2) / (2df + 1))), and tf occurrences among n terms give
    weight * (10^9 * tf div (1000 * tf + 12 * (75 + 25nN div L))); a term that a query repeats counts again. Equal scores go by ascending doc_id,
    rows without one last. A null or empty text has no terms, long texts are read whole, every row is a document of its
    own, also where rows repeat. Queries that repeat item_id and text count once; different texts under one item_id are
    ranked each on its own. Either table may be empty; other columns are ignored.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = queries.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    found = [_search_block(texts, block, top, shard_postings) for block in _blocks(items, block_chars)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
  s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
  m AS (SELECT r, doc_id, 100 - 25 + (25 * CAST(len(terms) AS BIGINT) * n_docs) // n_terms AS m FROM d, s WHERE len(terms) > 0),
  p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
  i AS (SELECT row_number() OVER () AS k, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
  q AS (SELECT k, item_id, term, count(*) AS times FROM (SELECT k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY ALL),
  f AS (SELECT k, item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL),
  o AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""
