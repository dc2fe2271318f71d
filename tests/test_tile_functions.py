from pyspark.sql import functions as F

from curbside.operators import tile_functions
from curbside.operators.tiles import covering
from curbside.operators.vector_tiles import encoded_tiles


def asked(spark, features, name):
    tile_functions.register(spark)
    features.createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM vector_tile(TABLE({name}) PARTITION BY (z, x, y) ORDER BY (px, py, n, amount))")


def test_tiles_from_sql_equal_those_of_frames(spark):
    lon, lat = -79.4 + F.col("id") % 37 * 0.004, 43.6 + F.col("id") % 23 * 0.003
    points = spark.range(600).select(F.col("id").alias("point_key"), lon.alias("lon"), lat.alias("lat"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.5).alias("amount"))
    for zoom in (9, 12, 14):
        tiles = covering(points, [zoom])
        whole = {(r.z, r.x, r.y): (r.n_features, bytes(r.mvt)) for r in encoded_tiles(points, tiles, zoom).collect()}
        found = asked(spark, tile_functions.placed_features(points, tiles, zoom), "tile_rows").collect()
        assert len(found) == len(whole) > 0 and {(r.z, r.x, r.y): (r.n_features, bytes(r.mvt)) for r in found} == whole


def test_tile_rows_without_a_place_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, 0, "a", None, 3, 1, None), (1, 1, 0, "a", 5, 6, 2, 7.0), (1, 1, 0, "a", 5, 6, 2, 7.0)], "z int, x long, y long, layer string, px int, py int, n long, amount double")
    assert [(r.x, r.n_features) for r in asked(spark, rows, "odd_rows").collect()] == [(1, 2)]
    assert asked(spark, rows.limit(0), "no_rows").count() == 0
