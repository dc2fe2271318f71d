"""Column functions on hand-checked rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from curbside.functions import dates, geo, slow, text, values
from curbside.operators.vector_tiles import decoded_points, layer


def applied(spark, function, inputs, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(function(F.col("v"))).collect()]


def test_streets(spark):
    assert applied(spark, text.street_of_location, ["12-34 Main St NB", "  ", None, "100 - "]) == ["MAIN ST", None, None, None]
    assert applied(spark, text.street_label, ["123 Main St", "", None]) == ["MAIN ST", "Unknown", "Unknown"]
    assert applied(spark, text.street_key, ["Queen Street West", "ELM GROVE CT"]) == ["QUEEN STREET WEST", "ELM GROVE COURT"]
    assert applied(spark, text.clean_address, [" nan ", "", None]) == ["NAN", None, None]


def test_addresses(spark):
    assert applied(spark, text.house_number, ["123 MAIN ST", "12B KING ST", "MAIN ST", None]) == [123, 12, None, None]
    assert applied(spark, text.intersection_streets, ["QUEEN ST W & YONGE ST", "QUEEN ST W", "KING ST N/O FRONT ST", "A RD NORTH OF B AVE", " / KING ST & BAY ST"]) == [["QUEEN STREET WEST", "YONGE STREET"], None, ["KING STREET", "FRONT STREET"], ["A ROAD", "B AVENUE"], ["KING STREET", "BAY STREET"]]
    assert applied(spark, text.house_number, ["12 34 KING ST", "12B 34C KING ST", "1 2 3 MAIN", "99999999999 X"]) == [34, 34, 3, None]
    assert applied(spark, text.numbered_street, ["12 34 KING ST", "12B 34C KING ST", "12B KING ST", "12K KING ST", "7"]) == ["KING ST", "C KING ST", "KING ST B", "KING ST", ""]
    assert applied(spark, text.without_position_words, ["NR N/S 5 MAIN ST", "MAIN ST"]) == ["5 MAIN ST", "MAIN ST"]


def test_locations(spark):
    rows = spark.createDataFrame([("123 MAIN ST", None, None, "NR"), ("789 QUEEN ST", "YONGE ST", None, "")], "b string, c string, d string, a string")
    out = rows.select(text.composed_location(F.col("b"), F.col("c"), F.col("d"), F.col("a"))).collect()
    assert [r[0] for r in out] == ["123 MAIN ST", "789 QUEEN ST, YONGE ST"]


def test_wards(spark):
    assert applied(spark, text.ward_code, ["Ward 10", "10.0", "Name (7)", "200", "30", None]) == [10, 10, 7, 20, 3, None]
    assert applied(spark, text.ward_name, ["10.0", "Ward 4", "7"]) == ["Ward 10", "Ward 4", "Ward 7"]


def test_labels(spark):
    assert applied(spark, text.title_case, ["PARK ON PRIVATE PROPERTY", "park-on"]) == ["Park On Private Property", "Park-On"]
    assert applied(spark, text.masked_number, ["***03850", "***", "x1"]) == [3850, None, None]
    assert applied(spark, text.slug, [" The Island / West! "]) == ["the-island-west"]
    assert applied(spark, slow.plain_letters, ["Élan", None]) == ["Elan", None]


def test_dates_and_times(spark):
    found = applied(spark, dates.parsed_date, ["20240901", "2024-09-01", "2024/09/01", "2010-13-45", "", None])
    assert [str(d) if d else None for d in found] == ["2024-09-01"] * 3 + [None] * 3
    assert applied(spark, dates.clock, ["0915", "9:15", ""]) == ["09:15", "9:15", None]
    assert applied(spark, dates.minute_of_day, ["930", "2400", "2560", None]) == [570, 0, 720, 720]
    assert dates.year_list("2008-2010,2015") == [2008, 2009, 2010, 2015]


def test_money_rounds_half_up(spark):
    assert applied(spark, values.money, ["2.675", "2.665", "abc", "", None]) == [Decimal("2.68"), Decimal("2.67"), None, None, None]


def test_quadkeys_go_back_to_tiles(spark):
    rows = spark.createDataFrame([(-79.3832, 43.6535), (179.9999, -85.0), (-180.0, 85.05)], "lon double, lat double")
    x, y = geo.tile_x(F.col("lon"), 14), geo.tile_y(F.col("lat"), 14)
    back = geo.quadkey_tile(geo.quadkey(x, y, 14))
    for row in rows.select(x.alias("x"), y.alias("y"), back.alias("b")).collect():
        assert (14, row.x, row.y) == (row.b[0], row.b[1], row.b[2])


def test_vector_tile_bytes():
    points = [(0, 0, {"count": 3, "amount": 1.5}), (4095, 17, {"name": "é", "none": None})]
    assert decoded_points(layer("parking", points)) == [(0, 0), (4095, 17)]


def test_thinned_line(spark):
    rows = spark.createDataFrame([("0 0,1 0.001,2 0,3 5,4 0",), ("1 1",), ("",), (None,)], "line string")
    out = [r[0] for r in rows.select(slow.simplified(F.col("line"), F.lit(0.1))).collect()]
    assert [tuple(map(float, p.split())) for p in out[0].split(",")] == [(0, 0), (2, 0), (3, 5), (4, 0)]
    assert out[2:] == ["", None]
