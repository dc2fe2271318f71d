"""Removal of repeated strings of 50 bytes by suffix sorting.

A string of 50 bytes is removed from a document when it also starts in a document with a smaller doc_id. All strings of
the corpus cannot be sorted in one place, nor moved (each byte starts one), so they are dealt to shards by content:

1. Every 50-byte window picks one anchor: of its 20-byte grams the one with the least hash. Equal windows pick equal
   anchors, so a window can repeat only where its anchor does. Anchors, one for about 16 bytes, are shuffled by hash and
   only those that occur in two documents go on. Documents that repeat a whole earlier text are settled beforehand.
2. The windows of an anchor lie side by side; the text that covers them (about 65 bytes) goes to the shard of the anchor.
3. A shard sorts the suffixes of its texts by external induced sorting (``induced_sort``), which also carries the common
   prefixes. Runs of suffixes that share 50 bytes are equal windows; each run knows its smallest doc_id.
4. The removed windows of each document are merged and cut from its text.

Hot strings: before each shuffle a task settles what it can by itself. Of equal anchors (or texts) in one batch only the
first document's takes part in the shuffle by key; of the others it is already known that they repeat, and they are dealt
out evenly. So a key has one entry for each batch at most, however common it is. Anchors travel in compressed blocks, one
for each batch and bucket.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.induced_sort import induced_suffixes

WINDOW, GRAM = 50, 20
_GRAMS = WINDOW - GRAM + 1
#: Bytes of text whose anchors are found at once, and bytes of texts that a shard sorts at once unless one anchor has more.
BATCH_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20
_BASE = 0x9E3779B97F4A7C15
_KEY = np.uint64((1 << 48) - 1)  # bits of a hash that travel besides its bucket; what they confuse, the sort tells apart
_PLACE_BITS = 23
_FIRST, _FIRST_KNOWN, _KNOWN = 0, 1, 2
SALTS = 8


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte by byte, all first bytes of an array's numbers first, and compressed."""
    sizes = np.array([a.nbytes for a in arrays], "<i8")
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(planes))


def _unpack(block: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    sizes = np.frombuffer(raw, "<i8", len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, sizes, strict=True):
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of every GRAM bytes."""

    def joined(left: np.ndarray, width: int, right: np.ndarray, more: int) -> np.ndarray:
        size = len(right) - width
        return left[:size] * np.uint64(pow(_BASE, more, 1 << 64)) + right[width:]

    sums = {1: text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)}
    width = 1
    while 2 * width <= GRAM:
        sums[2 * width] = joined(sums[width], width, sums[width], width)
        width *= 2
    out, have = sums[width], width
    for width in sorted(sums, reverse=True):
        while have + width <= GRAM:
            out, have = joined(out, have, sums[width], width), have + width
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def anchors(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, part, start of the first window, number of windows) of each anchor of ``parts``, in order."""
    lengths = np.array([len(p) for p in parts], np.int64)
    text = np.frombuffer(b"".join(parts), np.uint8)
    if len(text) < WINDOW:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    hashes = gram_hashes(text)
    place = np.uint64((1 << _PLACE_BITS) - 1)
    least, width = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64), 1
    while 2 * width <= _GRAMS:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < _GRAMS:
        least = np.minimum(least[: width - _GRAMS], least[_GRAMS - width :])
    owner = np.repeat(np.arange(len(parts)), lengths)[: len(least)]
    ends = np.cumsum(lengths)
    windows = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends[owner])
    if not len(windows):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    at, owner = (least[windows] & place).astype(np.int64), owner[windows]
    fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    runs = np.flatnonzero(fresh)
    owner = owner[runs]
    return hashes[at[runs]], owner, windows[runs] - (ends - lengths)[owner], np.diff(np.concatenate([runs, [len(windows)]]))


def _portions(ids: list[int], texts: list[bytes], batch_bytes: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, offsets, parts) of at most BATCH_BYTES. A giant text is cut so that no window is lost or met twice."""
    batch_bytes = batch_bytes or BATCH_BYTES
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in zip(ids, texts, strict=True):
        for at in range(0, max(1, len(text) - WINDOW + 1), batch_bytes // 2):
            part = text[at : at + batch_bytes // 2 + WINDOW - 1]
            if held and size + len(part) > batch_bytes:
                yield np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held]
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal sorted keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(keys)]]))


def _dealt(buckets: np.ndarray, pack) -> pa.RecordBatch:
    """One row for each bucket: ``pack`` makes the block of the entries it is given."""
    order = np.argsort(buckets, kind="stable")
    starts, sizes = _groups(buckets[order])
    blocks = [pack(order[s : s + n]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(buckets[order][starts], pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])


def _anchor_blocks(buckets: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (np.asarray(batch.column(k)) for k in (0, 2))
            for row, offsets, parts in _portions(list(range(len(ids))), batch.column(1).to_pylist(), batch_bytes):
                keys, owner, starts, counts = anchors(parts)
                if not len(keys):
                    continue
                home, keys = (keys >> np.uint64(40)) % np.uint64(buckets), keys & _KEY
                doc, own, starts = ids[row[owner]], texts[row[owner]], starts + offsets[owner]
                order = np.lexsort((doc, keys))
                first, sizes = _groups(keys[order])
                least, most = doc[order][first], doc[order][first + sizes - 1]
                flag = np.empty(len(keys), np.int64)
                flag[order] = np.where(doc[order] > np.repeat(least, sizes), _KNOWN, np.where(np.repeat(most > least, sizes), _FIRST_KNOWN, _FIRST))
                bucket = np.where(flag == _KNOWN, np.arange(len(keys)) % buckets, home.astype(np.int64))
                where = starts << 8 | counts << 2 | flag
                yield _dealt(bucket, lambda rows: _pack(keys[rows], doc[rows], own[rows], where[rows]))

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The entries of one bucket after the other; rows come sorted by bucket."""
    held, current = [], None
    for batch in batches:
        for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and bucket != current:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            current = bucket
            held.append(_unpack(block, *kinds))
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, doc, text, where in _by_bucket(batches, ("<u8", "<i8", "<i8", "<i8")):
        passed = where & 3 != _FIRST
        own = np.flatnonzero(where & 3 != _KNOWN)
        own = own[np.argsort(keys[own], kind="stable")]
        starts, sizes = _groups(keys[own])
        if len(own):
            repeated = np.minimum.reduceat(doc[own], starts) != np.maximum.reduceat(doc[own], starts)
            repeated |= np.maximum.reduceat(where[own] & 3, starts) == _FIRST_KNOWN  # others of a giant text may share its batch
            passed[own] |= np.repeat(repeated, sizes)
        found = np.flatnonzero(passed)
        for k in range(0, len(found), 100_000):
            part = found[k : k + 100_000]
            columns = [pa.array(doc[part]), pa.array(keys[part].view(np.int64)), pa.array(where[part] >> 2), pa.array(text[part])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "place", "text_key"])


def _window_texts(buckets: int):
    """Texts that cover the windows of repeated anchors, dealt to shards; repeats within a batch are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, named, starts, texts = [], [], [], [], []
            first: dict[bytes, int] = {}
            for doc, text, text_key, found in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                key, places, of = (np.asarray(found.values.field(k)) for k in range(3))
                places = places[of == text_key]
                keys.append(key[of == text_key])
                for place in places.tolist():
                    start = place >> 6
                    own = text[start : start + (place & 63) + WINDOW - 1]
                    if first.setdefault(own, doc) > doc:
                        first[own] = doc
                    texts.append(own)
                starts.append(places >> 6)
                docs.append(np.full(len(places), doc, np.int64))
                named.append(np.full(len(places), text_key, np.int64))
            if not texts:
                continue
            key, doc, start, text_keys = np.concatenate(keys).view(np.uint64), np.concatenate(docs), np.concatenate(starts), np.concatenate(named)
            known = doc > np.array([first[t] for t in texts])
            bucket = np.where(known, np.arange(len(doc)) % buckets, (key % np.uint64(buckets)).astype(np.int64))

            def pack(rows, key=key, doc=doc, start=start, known=known, texts=texts, text_keys=text_keys) -> bytes:
                rows = rows[np.argsort(key[rows], kind="stable")]
                size = np.array([len(texts[r]) for r in rows.tolist()], np.int64)
                sent = b"".join(texts[r] for r in rows[~known[rows]].tolist())
                return _pack(key[rows], doc[rows], text_keys[rows], start[rows] << 8 | size << 1 | known[rows], np.frombuffer(sent, np.uint8))

            yield _dealt(bucket, pack)

    return run


def _removed_windows(text: bytes, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (entry, from, to) of the windows that start in an earlier document too.

    ``text`` holds the different texts one after the other; entry k is the one that begins at ``first[k]``.
    """
    raw = np.frombuffer(text, np.uint8)
    least = np.full(len(raw), np.iinfo(np.int64).max)
    windows = sizes - WINDOW + 1
    begins = np.concatenate([[0], np.cumsum(windows)[:-1]])
    flat = np.repeat(first - begins, windows) + np.arange(int(windows.sum()))
    owner = np.repeat(docs, windows)
    np.minimum.at(least, flat, owner)
    with tempfile.TemporaryDirectory() as folder:
        for positions, common in induced_suffixes(raw, WINDOW, folder):
            runs = np.flatnonzero(np.concatenate([[True], common[1:] < WINDOW]))
            lengths = np.diff(np.concatenate([runs, [len(positions)]]))
            least[positions] = np.repeat(np.minimum.reduceat(least[positions], runs), lengths)
    gone = np.concatenate([[False], least[flat] < owner, [False]])
    # Runs end where the entry does, too.
    limits = np.zeros(len(gone), bool)
    limits[begins + 1] = True
    rise = np.flatnonzero(gone[1:-1] & (~gone[:-2] | limits[1:-1]))
    fall = np.flatnonzero(gone[1:-1] & (~gone[2:] | np.concatenate([limits[2:-1], [True]])))
    entry = np.searchsorted(begins, rise, side="right") - 1
    return entry, starts[entry] + rise - begins[entry], starts[entry] + fall - begins[entry] + WINDOW


def _shard_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, docs, named, where, sent in _by_bucket(batches, ("<u8", "<i8", "<i8", "<i8", "u1")):
        known, size, start = where & 1 == 1, where >> 1 & 127, where >> 8
        found = [(docs[known], named[known], start[known], start[known] + size[known])]
        keys, docs, named, start, size = (c[~known] for c in (keys, docs, named, start, size))
        raw, ends = sent.tobytes(), np.cumsum(size)
        order = np.argsort(keys, kind="stable")
        keys, docs, named, start, size, begin = keys[order], docs[order], named[order], start[order], size[order], (ends - size)[order]
        texts = [raw[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
        groups, members = _groups(keys)
        if len(groups):  # an anchor whose texts are all the same needs no sorting
            uniform = np.array([texts[g : g + n].count(texts[g]) == n for g, n in zip(groups.tolist(), members.tolist(), strict=True)])
            gone = np.repeat(uniform, members) & (docs > np.repeat(np.minimum.reduceat(docs, groups), members))
            found.append((docs[gone], named[gone], start[gone], start[gone] + size[gone]))
            groups, members = groups[~uniform], members[~uniform]
        block, first, parts, used, rows = {}, [], [], 0, []
        for k, (g, n) in enumerate(zip(groups.tolist(), members.tolist(), strict=True), 1):
            rows.extend(range(g, g + n))  # windows of one anchor stay together
            for own in texts[g : g + n]:
                if (known_at := block.get(own)) is None:
                    block[own] = known_at = used
                    parts.append(own)
                    used += len(own)
                first.append(known_at)
            if used > BLOCK_BYTES or k == len(groups):
                at = np.array(rows)
                entry, low, high = _removed_windows(b"".join(parts), docs[at], start[at], size[at], np.array(first))
                found.append((docs[at][entry], named[at][entry], low, high))
                block, first, parts, used, rows = {}, [], [], 0, []
        doc, text, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
        for k in range(0, len(doc), 100_000):
            spans = low[k : k + 100_000] << 32 | high[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[k : k + 100_000]), pa.array(text[k : k + 100_000]), pa.array(spans)], names=["doc_id", "text_key", "span"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, copy, text_key, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), batch.column(4), strict=True):
            of, spans = (np.asarray(spans.values.field(k)) for k in range(2)) if spans.values is not None else (np.zeros(0, np.int64),) * 2
            spans = spans[of == text_key]
            if copy and len(text) >= WINDOW:
                low, high = np.array([0]), np.array([len(text)])
            elif not len(spans):
                low = high = np.zeros(0, np.int64)
            else:
                sorted_spans = np.sort(spans)
                low, high = sorted_spans >> 32, np.maximum.accumulate(sorted_spans & 0xFFFFFFFF)
                apart = np.concatenate([[True], low[1:] > high[:-1]])
                low, high = low[apart], high[np.concatenate([np.flatnonzero(apart)[1:] - 1, [len(high) - 1]])]
            edges = [0, *np.stack([low, high], axis=1).ravel().tolist(), len(text)]
            left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(text), len(text) - len(left), len(low), hashlib.sha256(left).hexdigest(), left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (what is
    left, UTF-8 bytes).

    A byte is removed when a string of 50 bytes that covers it also starts in a document with a smaller doc_id, judged
    on the input. Null counts as empty; texts under 50 bytes stay whole; repeats within one document stay. Repeated rows
    (same doc_id and text) appear again and do not remove each other; rows that share a doc_id count as one document. A
    row without doc_id stays whole and removes nothing. An empty table gives no rows; other columns are ignored.
    """
    session = docs.sparkSession
    partitions = int(session.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    named = texts.filter("doc_id IS NOT NULL")
    placed = named.repartition(partitions, "doc_id")  # the one shuffle of texts; all three uses below read it
    # Texts under one id are told apart by their hash; an id with one text, the common case, needs none and sends zeros.
    own = F.xxhash64("body")
    several = named.groupBy("doc_id").agg(F.min(own).alias("low"), F.max(own).alias("high")).filter("low < high").select("doc_id", F.lit(True).alias("several"))
    keyed = placed.join(several, "doc_id", "left").select("doc_id", "body", F.when(F.col("several"), own).otherwise(F.lit(0)).alias("text_key"))
    digests = named.select("doc_id", F.sha2("body", 256).alias("digest"), own.alias("own"))
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # members of a large group are spread
    members = digests.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    copies = members.join(firsts, ["digest", "salt"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("own").alias("copied"))
    copy = F.coalesce(F.array_contains("copied", own), F.lit(False)).alias("copy")
    marked = keyed.join(copies, "doc_id", "left").select("doc_id", "body", copy, "text_key")
    blocks = marked.filter("NOT copy").select("doc_id", "body", "text_key").mapInArrow(_anchor_blocks(buckets, BATCH_BYTES), "bucket int, block binary")
    dealt = blocks.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    repeated = dealt.mapInArrow(_repeated_anchors, "doc_id long, key long, place long, text_key long")
    by_doc = repeated.groupBy("doc_id").agg(F.collect_set(F.struct("key", "place", "text_key")).alias("found"))
    windows = keyed.join(by_doc, "doc_id").select("doc_id", "body", "text_key", "found").mapInArrow(_window_texts(buckets), "bucket int, block binary")
    shards = windows.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    spans = shards.mapInArrow(_shard_spans, "doc_id long, text_key long, span long").groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "span")).alias("spans"))
    whole = marked.join(spans, "doc_id", "left").select("doc_id", "body", "copy", "text_key", "spans")
    nameless = texts.filter("doc_id IS NULL").selectExpr("doc_id", "body", "false AS copy", "0L AS text_key", "CAST(NULL AS array<struct<text_key:long,span:long>>) AS spans")
    return whole.unionAll(nameless).mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s
      FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS (SELECT w.doc_id, w.p FROM w JOIN f ON w.s = f.s AND f.first < w.doc_id),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + 50 THEN 0 ELSE 1 END AS fresh FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
k AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
t AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM k GROUP BY doc_id, span),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM t),
c AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS head, sum(b - a) AS gone, count(*) AS n, max(b) AS last
      FROM (SELECT e.doc_id, e.a, e.b, substr(d.h, 2 * e.prev + 1, 2 * (e.a - e.prev)) AS part FROM e JOIN d ON e.doc_id = d.doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""
