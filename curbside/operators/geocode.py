"""Free-text addresses placed on a street network, worked out once for each distinct address.

``segments``: segment_id, street_key, parity, low, high, lon, lat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.functions.text import house_number, intersection_streets, numbered_street, street_key, without_direction, without_position_words
from curbside.operators.joins import fallback_chain, nearest_pairs, range_matched
from curbside.sources.paths import checkpointed


def streets_found(keys: DataFrame, names: DataFrame) -> DataFrame:
    """key, street_key, method: the streets of ``names`` (street_key) that each different ``key`` may mean.

    Streets are found by their key, then without a trailing direction on either side, then without spaces, then by the most similar
    name. A key without a direction may mean several streets.
    """
    distinct = keys.select("key").filter("key <> ''").distinct()
    lookup = names.select("street_key").distinct()
    bare, bare_name = without_direction(F.col("key")), without_direction(F.col("street_key"))
    steps = [
        ("exact", F.col("key"), F.col("street_key")),
        ("no_direction", bare, bare_name),
        ("no_space", F.replace(bare, F.lit(" ")), F.replace(bare_name, F.lit(" "))),
    ]
    return fallback_chain(distinct, lookup, steps, "key", (F.col("key"), "street_key")).distinct()


def geocoded(addresses: DataFrame, segments: DataFrame) -> DataFrame:
    """address, method, segment_id, lon, lat for each distinct address that can be placed.

    An address that begins with a number is placed on the segment of its street whose range holds the number (range), else on
    the nearest one (nearest_range); one of two streets halfway between their nearest segments (intersection); one without any digit
    in the middle of its street (street). Streets are those of :func:`streets_found`; keys have the long spelling on
    both sides, so HWY and HIGHWAY, or W and WEST, are the same.
    """
    segments = segments.withColumn("street_key", street_key(F.col("street_key")))
    distinct = addresses.select("address").filter("address IS NOT NULL").distinct()
    # In steps, so that no expression is repeated within another; read once and kept, as several steps come back to it.
    parsed = distinct.withColumn("cleaned", without_position_words(F.col("address")))
    parsed = parsed.withColumns({"number": house_number(F.col("cleaned")), "street": numbered_street(F.col("cleaned")), "pair": intersection_streets(F.col("cleaned"))})
    numbered = F.col("number").isNotNull()
    plain = F.when(F.col("pair").isNull() & ~F.col("cleaned").rlike("[0-9]"), F.col("cleaned"))
    parsed = parsed.select("address", "number", street_key(F.when(numbered, F.col("street")).otherwise(plain)).alias("key"), F.when(~numbered, F.col("pair")).alias("pair"))
    parsed = checkpointed(parsed)
    keys = parsed.select("key").unionAll(parsed.select(F.explode("pair").alias("key"))).filter("key <> ''")
    streets = checkpointed(streets_found(keys, segments).select("key", "street_key"))
    single = parsed.filter("key <> ''").join(streets, "key")
    numbered = range_matched(single.filter("number IS NOT NULL").select("address", "street_key", "number"), segments, "address", "number")
    places = segments.groupBy("segment_id").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    best = numbered.groupBy("address").agg(F.min(F.struct((~F.col("inside")).alias("outside"), "off", "segment_id")).alias("best"))
    numbered = best.select("address", (~F.col("best.outside")).alias("inside"), "best.segment_id")
    by_number = numbered.join(places, "segment_id").select("address", F.when(F.col("inside"), "range").otherwise("nearest_range").alias("method"), "segment_id", "lon", "lat")
    middle = segments.groupBy("street_key").agg(F.min("segment_id").alias("segment_id"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    by_street = single.filter("number IS NULL").join(middle, "street_key").groupBy("address").agg(F.min(F.struct("segment_id", "lon", "lat")).alias("best"))
    by_street = by_street.select("address", F.lit("street").alias("method"), "best.*")
    # Streets meet with all their segments, so once for each two streets and not for each address.
    crossed = parsed.filter("pair IS NOT NULL").select("pair").distinct()
    side = lambda k: crossed.select("pair", F.col("pair")[k].alias("key")).join(streets, "key").join(segments, "street_key").select("pair", "segment_id", "lon", "lat")
    crossing = parsed.join(nearest_pairs(side(0), side(1), "pair"), "pair").select("address", F.lit("intersection").alias("method"), F.col("id_a").alias("segment_id"), "lon", "lat")
    return by_number.unionByName(by_street).unionByName(crossing)


def with_fallback(placed: DataFrame, addresses: DataFrame, lon: float, lat: float, spread: float = 0.02) -> DataFrame:
    """Addresses that could not be placed get a point near (lon, lat) that depends on the address alone, and a flag."""
    out = addresses.select("address").distinct().join(placed, "address", "left")
    unit = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "address"), F.lit(1_000_000)) / 1_000_000.0 - 0.5
    return out.withColumns({"is_fallback": F.col("method").isNull(), "lon": F.coalesce("lon", F.lit(lon) + spread * unit(1)), "lat": F.coalesce("lat", F.lit(lat) + spread * unit(2))})
