"""Readers, writers, streams, the geocoder and the forecast on small fixtures."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlparse

import pytest
from pyspark.sql import functions as F

from curbside.operators import corpus, forecast, geocode, joins, windows, writers
from curbside.sources import files, landing
from curbside.streaming import incremental, tile_queue
from curbside.streaming import windows as stream_windows

SEGMENTS = [
    (1, "QUEEN ST W", 0, 2, 98, -79.40, 43.65),
    (2, "QUEEN ST W", 1, 1, 99, -79.40, 43.65),
    (3, "QUEEN ST W", 0, 100, 198, -79.41, 43.65),
    (4, "QUEEN ST W", 1, 101, 199, -79.41, 43.65),
    (5, "YONGE ST", 0, 2, 98, -79.38, 43.66),
]


def test_geocoder(spark):
    segments = spark.createDataFrame(SEGMENTS, "segment_id int, street_key string, parity int, low int, high int, lon double, lat double")
    asked = ["50 QUEEN ST W", "950 QUEEN ST W", "QUEEN ST W & YONGE ST", "QUEEN ST W", "ELM GROVE CT", None, ""]
    addresses = spark.createDataFrame([(a,) for a in asked], "address string")
    found = {r.address: r for r in geocode.geocoded(addresses, segments).collect()}
    assert (found["50 QUEEN ST W"].segment_id, found["50 QUEEN ST W"].method) == (1, "range")
    assert found["950 QUEEN ST W"].method == "nearest_range" and found["950 QUEEN ST W"].segment_id in (3, 4)
    assert found["QUEEN ST W & YONGE ST"].method == "intersection"
    assert found["QUEEN ST W"].lon == pytest.approx(-79.405)
    assert "ELM GROVE CT" not in found
    filled = geocode.with_fallback(geocode.geocoded(addresses, segments), addresses, -79.38, 43.65)
    assert {r.address for r in filled.filter("is_fallback").collect()} >= {"ELM GROVE CT"}


def test_forecast_by_hand(spark):
    yearly = spark.createDataFrame([("a", 2020, 10, 100.0), ("a", 2022, 20, 200.0)], "place string, year int, n int, revenue double")
    row = forecast.predictions(yearly, "place").first()
    assert (row.tickets, row.confidence, row.trend, row.change_percent) == (16.25, pytest.approx(0.933333), "steady", 0.0)


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "k int, name string, n int")
    once = writers.upserted(old, new, ["k"], ["name"])
    twice = writers.upserted(once, new, ["k"], ["name"])
    expected = [(1, "a", 1), (2, "b", 5), (3, "c", 3)]
    assert sorted(map(tuple, once.select("k", "name", "n").collect())) == expected
    assert sorted(map(tuple, twice.select("k", "name", "n").collect())) == expected


def test_replaced_partitions_leave_others(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 2020), (2, 2021)], "n int, year int")
    writers.refresh(rows, path, "year")
    writers.replace_partitions(spark.createDataFrame([(9, 2021)], "n int, year int"), path, "year")
    assert sorted(map(tuple, spark.read.parquet(path).select("n", "year").collect())) == [(1, 2020), (9, 2021)]


def test_window_over_buckets_equals_one_window(spark):
    rows = spark.createDataFrame([(k, float(k * k % 17)) for k in range(200)], "tag long, fine double")
    out = windows.rolling_mean(rows, "tag", "fine", 10, bucket_rows=7).orderBy("tag").collect()
    values = [float(k * k % 17) for k in range(200)]
    for k, row in enumerate(out):
        part = values[max(0, k - 9) : k + 1]
        assert row.rolling_mean == pytest.approx(sum(part) / len(part))


def test_corpus_splits_and_first_examples(spark):
    rows = spark.createDataFrame([(0, 3, "a"), (1, 5, "a"), (2, 10, "b"), (3, 10, "b")], "pos int, month int, code string")
    made = corpus.records(rows.withColumn("split", corpus.split_of(F.col("month"))), "Code {code}?", "{code}~", required=["code"])
    kept = corpus.distinct_examples(made, "pos")
    assert sorted((r.split, r.prompt, r.pos) for r in kept.collect()) == [("eval", "Code a?", 0), ("eval", "Code b?", 2), ("train", "Code a?", 1)]
    line = json.loads(corpus.chat_lines(made, "be brief").first().value)
    assert [m["role"] for m in line["messages"]] == ["system", "user", "assistant"]


def test_open_quotes_join_lines(spark):
    lines = ['a,"x', "y", 'z",1', "b,2", 'c,"p', 'q",3', 'd,"open']
    rows = spark.createDataFrame([("f", k, line) for k, line in enumerate(lines, 1)], "path string, line_number long, line string")
    expected = [(1, 'a,"x\ny\nz",1'), (4, "b,2"), (5, 'c,"p\nq",3'), (7, 'd,"open')]
    for size in (1, 2, 3, 100):
        assert sorted((r.line_number, r.record) for r in files.joined_quotes(rows, size).collect()) == expected


def test_encodings_match_the_plain_rule(spark):
    heads = [b"\xff\xfea\x00", b"\xfe\xff\x00a", b"\xef\xbb\xbfa", b"a\x00b\x00", b"abcd", b"", b"a", b"p\x0f\x00\x01"]
    found = files.encodings(spark.createDataFrame([(str(k), h) for k, h in enumerate(heads)], "path string, content binary"))
    assert [r.encoding for r in found.orderBy("path").collect()] == [files.sniffed_encoding(h) for h in heads]


def test_missing_file_is_an_empty_table(spark, tmp_path):
    assert files.typed_or_empty(spark, str(tmp_path / "none.csv"), "a int").count() == 0


def test_byte_order_mark_is_no_name(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿a,b\n1,\"x\ny\"\n".encode())
    assert [r.asDict() for r in files.csv_files(spark, str(tmp_path / "a.csv")).collect()] == [{"a": "1", "b": "x\ny"}]


def test_portal_retries(tmp_path):
    calls, waits = [], []

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("busy")
        return json.dumps({"success": True, "result": {"id": "p"}}).encode()

    portal = landing.OpenDataPortal("http://portal", get, wait=waits.append)
    assert portal.package("p") == {"id": "p"} and len(calls) == 3 and waits == [1.0, 2.0]


class Portal(BaseHTTPRequestHandler):
    """A portal whose first answer to each address is an error, and whose first download breaks off."""

    seen: dict[str, int] = {}
    content = bytes(range(256)) * 20_000
    rows = [{"_id": k, "name": f"n{k}"} for k in range(23)]

    def log_message(self, *_):
        pass

    def do_GET(self):
        path, asked = urlparse(self.path).path, dict(parse_qsl(urlparse(self.path).query))
        self.seen[self.path] = self.seen.get(self.path, 0) + 1
        if path == "/file":
            self.send_response(200)
            self.send_header("Content-Length", str(len(self.content)))
            self.end_headers()
            self.wfile.write(self.content if self.seen[self.path] > 1 else self.content[:1000])
            return
        if self.seen[self.path] == 1:
            self.send_error(503)
            return
        result = {"id": asked.get("id"), "url": f"http://127.0.0.1:{self.server.server_port}/file"}
        if path.endswith("datastore_search"):
            at, limit = int(asked.get("offset", 0)), int(asked["limit"])
            result = {"total": len(self.rows), "records": self.rows[at : at + limit]}
        body = json.dumps({"success": True, "result": result}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)


def test_portal_over_http(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Portal)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        waits = []
        portal = landing.OpenDataPortal(f"http://127.0.0.1:{server.server_port}", wait=waits.append)
        target = portal.download("r1", tmp_path / "in" / "f.zip")
        assert target.read_bytes() == Portal.content and not target.with_suffix(".zip.part").exists()
        assert waits == [1.0, 1.0]  # one for the look-up, one for the download that broke off
        assert portal.total("r1") == 23
        pages = [row for at in range(0, 23, 10) for row in portal.rows("r1")(at, 10, None)]
        assert pages == Portal.rows
        with pytest.raises(OSError):
            landing.OpenDataPortal("http://127.0.0.1:1", tries=2, wait=waits.append).package("p")
    finally:
        server.shutdown()


def test_changed_resources(spark):
    manifest = spark.createDataFrame([("a", "d", "1"), ("b", "d", "2"), ("c", "d", "3")], "slug string, last_modified string, sha1 string")
    state = spark.createDataFrame([("a", "d", "1"), ("b", "d", "old")], "slug string, last_modified string, sha1 string")
    assert {r.slug for r in incremental.changed(manifest, state).select("slug").collect()} == {"b", "c"}


def test_outcomes_and_waits(spark):
    asked = spark.createDataFrame([("a", 9, 1, 0, 1), ("a", 9, 2, 0, 1), ("a", 9, 3, 0, tile_queue.MOST_ATTEMPTS)], "dataset string, z int, x long, y long, attempt int")
    made = spark.createDataFrame([("a", 9, 1, 0, True)], "dataset string, z int, x long, y long, ok boolean")
    out = {r.x: (r.outcome, r.wait_seconds) for r in tile_queue.outcomes(asked, made).collect()}
    assert out == {1: ("done", 0.0), 2: ("retry", 2.0), 3: ("dead", 0.0)}


def test_stream_gives_the_closed_windows_of_the_table(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp_seconds(1700000000 + 90 * id) AS ts, 'a' AS event_type, CAST(id AS DOUBLE) AS value, 1L AS user_id FROM range(200)")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = stream_windows.tumbling(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    ours = set(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("window_start", "n").collect()))
    whole = set(map(tuple, stream_windows.tumbling(rows).select("window_start", "n").collect()))
    assert ours and ours <= whole and len(whole) - len(ours) <= 5


def test_long_and_short_spellings_are_one_street(spark):
    segments = spark.createDataFrame([(1, "HWY 7", 0, 2, 98, -79.4, 43.8), (2, "Maple Crescent NW", 0, 2, 98, -79.5, 43.8)], "segment_id int, street_key string, parity int, low int, high int, lon double, lat double")
    asked = ["50 HIGHWAY 7", "50 Hwy 7", "12 MAPLE CR NW", "12 maple cres northwest", "12 MAPLE CRES"]
    found = {r.address: (r.segment_id, r.method) for r in geocode.geocoded(spark.createDataFrame([(a,) for a in asked], "address string"), segments).collect()}
    assert found == {"50 HIGHWAY 7": (1, "range"), "50 Hwy 7": (1, "range"), "12 MAPLE CR NW": (2, "range"), "12 maple cres northwest": (2, "range"), "12 MAPLE CRES": (2, "range")}


def test_archive_members_of_many_columns(spark):
    names = ",".join(f"n{k}" for k in range(40))
    rows = [("a", "m", 1, names), ("a", "m", 2, ",".join(map(str, range(40)))), ("a", "o", 1, "x,y"), ("a", "o", 2, 'p,"q,r"')]
    got = {(r.member, r.line_number): r.cells for r in files.archive_table(spark.createDataFrame(rows, "path string, member string, line_number long, line string")).collect()}
    assert got["m", 2]["n39"] == "39" and len(got["m", 2]) == 40 and got["o", 2] == {"x": "p", "y": "q,r"}
    assert files.archive_table(spark.createDataFrame([], "path string, member string, line_number long, line string")).count() == 0


def test_nearest_names_against_all_pairs(spark):
    import difflib
    import random

    rng = random.Random(9)
    known = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(1, 12))).strip() or "a" for _ in range(120)})
    typed = sorted({k[: rng.randint(0, len(k))] + rng.choice("abx") + k[rng.randint(0, len(k)) :] for k in known} | set(known[:20]) | {""})
    got = {r.typed: r.known for r in joins.nearest_names(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(k,) for k in known], "known string")).collect()}
    want = {t: found[0] for t in typed if (found := difflib.get_close_matches(t, known, 1, 0.82))}
    assert got == want


def test_retries_wait_until_they_are_due(spark, tmp_path):
    spark.createDataFrame([("a", "s", 9, x, 0, 1, 0) for x in range(4)], tile_queue.REQUEST_SCHEMA).write.parquet(str(tmp_path / "in"))
    render = lambda r: r.select("dataset", "z", "x", "y", (F.col("x") > 0).alias("ok"))
    counts = []
    for now in (100, 101, 102, 105, 106, 114, 200, 201):
        tile_queue.run_queue(spark, str(tmp_path / "in"), render, str(tmp_path / "done"), str(tmp_path / "dead"), str(tmp_path / "state"), F.lit(now)).awaitTermination()
        counts.append((spark.read.parquet(str(tmp_path / "done")).count(), spark.read.parquet(str(tmp_path / "dead")).count()))
    assert counts == [(3, 0)] * 6 + [(3, 1)] * 2  # waits of 2, 4, 8 and 16 seconds


def test_handlers_are_found_by_name():
    from curbside.plans.intake import order_years
    from curbside.plans.registry import handler

    assert handler("curbside.plans.intake:order_years") is order_years
    for name in ("curbside.plans.intake", "curbside.plans.intake:no_such"):
        with pytest.raises(ValueError):
            handler(name)


def test_mart_stays_within_its_size(spark):
    from curbside.operators import result_mart

    mart = spark.createDataFrame([(k, "x" * k, 10**6, k // 2) for k in range(1, 9)], "key long, value string, expires_at long, used_at long")
    kept = result_mart.within_size(mart, F.char_length("value"), 21)
    assert sorted(r.key for r in kept.collect()) == [6, 7, 8]  # 8, then 6 and 7 of one second
    assert kept.columns == ["used_at", "key", "value", "expires_at"] or set(kept.columns) == set(mart.columns)


def test_key_that_cannot_be_worked_out(spark):
    from curbside.operators import result_mart

    calls = []

    def compute(keys):
        calls.append(1)
        return keys.filter("key = 1").withColumn("value", F.lit("a"))

    requests = spark.createDataFrame([(1,), (1,), (2,), (None,)], "key long")
    none = spark.createDataFrame([], "key long, value string, expires_at long, used_at long")
    served, mart = result_mart.answered(requests, none, compute, F.lit(5), 10, 3)
    assert sorted(((r.key, r.value) for r in served.collect()), key=str) == sorted([(1, "a"), (1, "a"), (2, None), (None, None)], key=str)
    assert [tuple(r) for r in mart.collect()] == [(1, "a", 15, 5)] and calls == [1]


def test_database_table(spark):
    """An embedded database, read by ranges of its key."""
    url, driver = "jdbc:derby:memory:curbside;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(0, 1000).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    rows.repartition(1).write.format("jdbc").options(url=url, dbtable="tickets", driver=driver).mode("overwrite").save()
    found = files.database_table(spark, url, "tickets", "id", 0, 1000, 4, 100)
    assert found.rdd.getNumPartitions() == 4 and found.count() == 1000
    assert found.agg(F.sum(found.columns[0])).first()[0] == 999 * 500


def test_features_are_one_document(spark, tmp_path):
    """The parts in the order of their names are valid GeoJSON with the features in order."""
    rows = spark.createDataFrame([(k * 7 % 50, f"w{k}", k / 10, 43.0) for k in range(50)], "site_key int, ward string, lon double, lat double")
    path = str(tmp_path / "features")
    writers.write_features(rows.repartition(3), "site_key", path)
    text = "".join(p.read_text() for p in sorted((tmp_path / "features").glob("part-*")))
    document = json.loads(text)
    assert document["type"] == "FeatureCollection" and [f["properties"]["site_key"] for f in document["features"]] == list(range(50))
    assert files.geojson_lines(spark, path, "site_key: int, ward: string").count() == 50
    whole = tmp_path / "whole.json"
    whole.write_text(text)
    assert files.geojson_features(spark, str(whole), "site_key: int").count() == 50
