"""Lookups, fallbacks, outer merges, range and nearest joins, each with an equality key to shuffle on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.functions.geo import METRES_LAT, METRES_LON, haversine
from curbside.operators.windows import top_per_group
from curbside.sources.paths import checkpointed


def small(df: DataFrame, limit_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has ``limit_rows`` rows at most; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit_rows + 1).count() <= limit_rows else df


def enriched(facts: DataFrame, lookup: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left lookup; columns that found nothing take their default."""
    out = facts.join(lookup, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def matched_with_reasons(facts: DataFrame, lookup: DataFrame, key: str, found: str) -> tuple[DataFrame, DataFrame]:
    """Rows that found a partner, and the number of rows by outcome: matched, no_key or no_match."""
    tagged = facts.join(lookup, key, "left").withColumn("outcome", F.when(F.col(key).isNull(), "no_key").when(F.col(found).isNull(), "no_match").otherwise("matched"))
    return tagged.filter("outcome = 'matched'").drop("outcome"), tagged.groupBy("outcome").agg(F.count("*").alias("n"))


def merged_outer(left: DataFrame, right: DataFrame, key: str, values: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Full outer merge; what is missing on a side counts as 0."""
    a = left.select(key, *[F.col(v).alias(f"{names[0]}_{v}") for v in values])
    b = right.select(key, *[F.col(v).alias(f"{names[1]}_{v}") for v in values])
    both = a.join(b, key, "full")
    return both.select(key, *[F.coalesce(f"{n}_{v}", F.lit(0)).alias(f"{n}_{v}") for n in names for v in values])


def preferred(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left``, then those of ``right`` whose key ``left`` does not have."""
    return left.unionByName(right.join(left.select(key).distinct(), key, "left_anti"))


def by_candidates(facts: DataFrame, id_column: str, candidates: Column, lookup: DataFrame, key: str) -> DataFrame:
    """The partner of the first of several candidate keys that has one; facts without are left out."""
    tried = facts.select(id_column, F.posexplode(candidates).alias("priority", key)).filter(F.col(key).isNotNull())
    return top_per_group(tried.join(lookup, key), [id_column], ["priority"]).drop("rn")


def fallback_chain(facts: DataFrame, lookup: DataFrame, steps: Sequence[tuple[str, Column, Column]], id_column: str, fuzzy: tuple[Column, str] | None = None, least: float = 0.82) -> DataFrame:
    """Facts with their partners by the first of several (name, fact key, lookup key) that has one; ``method`` is its name.

    All keys are looked up at once. With ``fuzzy`` (fact key, column of ``lookup``) what has no partner goes to the most
    similar name, from a ratio of ``least`` on. ``id_column`` tells facts apart.
    """
    tries = F.array(*[F.struct(F.lit(k).alias("step"), fact_key.alias("k")) for k, (_, fact_key, _) in enumerate(steps)])
    offers = F.array(*[F.struct(F.lit(k).alias("step"), lookup_key.alias("k")) for k, (_, _, lookup_key) in enumerate(steps)])
    asked = facts.select(F.col(id_column).alias("_id"), F.explode(tries).alias("_try")).select("_id", "_try.step", "_try.k").filter("k IS NOT NULL")
    offered = lookup.select(F.struct(*lookup.columns).alias("_found"), F.explode(offers).alias("_offer")).select("_found", "_offer.step", "_offer.k")
    met = asked.join(offered, ["step", "k"]).select("_id", "step", "_found")
    first = met.groupBy("_id").agg(F.min("step").alias("step"))
    names = F.element_at(F.array(*[F.lit(name) for name, _, _ in steps]), F.col("step") + 1)
    done = met.join(first, ["_id", "step"]).select("_id", "_found", names.alias("method"))
    if fuzzy:
        left = facts.select(F.col(id_column).alias("_id"), fuzzy[0].alias("typed")).join(first, "_id", "left_anti")
        near = nearest_names(left, lookup.select(F.col(fuzzy[1]).alias("known")), least)
        partners = lookup.select(F.struct(*lookup.columns).alias("_found"), F.col(fuzzy[1]).alias("known"))
        done = done.unionByName(left.join(near.select("typed", "known"), "typed").join(partners, "known").select("_id", "_found", F.lit("fuzzy").alias("method")))
    return facts.join(done.withColumnRenamed("_id", id_column), id_column).select(*[F.col(c) for c in facts.columns], "_found.*", "method")


def _letter_pairs(df: DataFrame, column: str) -> DataFrame:
    """name, gram for every different name: its pairs of neighbouring letters, those that repeat told apart by a number."""
    names = df.select(F.col(column).alias("name")).filter("name <> ''").distinct()
    pair = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("name") - 1)), lambda k: F.substring("name", k, F.lit(2)))
    counted = names.select("name", F.explode(pair).alias("pair")).groupBy("name", "pair").agg(F.count("*").alias("n"))
    return counted.select("name", "pair", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select("name", F.concat("pair", F.col("k").cast("string")).alias("gram"))


def nearest_names(typed: DataFrame, known: DataFrame, least: float = 0.82, spare: int = 1) -> DataFrame:
    """typed, known, ratio: for every different ``typed`` name the ``known`` one most like it, by a ratio of ``least`` or more.

    Of two names of t letters together m = ceil(least * t / 2) letters match at least, in t - 2 * m + 1 blocks at most; so
    they share k = 3 * m - t - 1 pairs of letters or more. With the pairs of a name put in the order of how rare they are, two names that share k
    pairs share j + 1 among their first n - k + 1 + j at least, and only these are indexed, by both lengths, on which k depends; j is ``spare`` where
    k allows. Frequent pairs (of STREET, say) thus bring no names together. Names that meet are compared by their ratio; equal ratios go to the
    name that is last in the alphabet.
    """
    from curbside.functions.slow import name_ratio

    sides = [_letter_pairs(typed, "typed"), _letter_pairs(known, "known")]
    rarity = sides[0].unionAll(sides[1]).groupBy("gram").agg(F.count("*").alias("n"))

    def rare(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """(name, both lengths, spare, gram) for the rarest pairs of every name, as many as are needed for each length of the other name."""
        ranked = side.join(rarity, "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("order"))
        share = least / (2 - least)
        length = F.char_length("name")
        sized = ranked.select("name", "order", length.alias(own), F.explode(F.sequence(F.floor(length * share).cast("int"), F.ceil(length / share).cast("int"))).alias(other))
        matched = F.ceil(F.lit(least) * (F.col(own) + F.col(other)) / 2 - 1e-9).cast("int")
        sized = sized.withColumn("matched", matched).filter(F.col("matched").between(1, F.least(own, other)))
        sized = sized.withColumn("shared", F.greatest(F.lit(1), 3 * F.col("matched") - F.col(own) - F.col(other) - 1)).filter(F.size("order") >= F.col("shared"))
        sized = sized.withColumn("spare", F.least(F.lit(spare), F.col("shared") - 1))
        kept = F.slice("order", F.lit(1), F.size("order") - F.col("shared") + 1 + F.col("spare"))
        return sized.select(F.col("name").alias(name), own, other, "spare", F.explode(kept).alias("g")).select(name, own, other, "spare", "g.gram")

    met = rare(sides[0], "typed", "length_typed", "length_known").join(rare(sides[1], "known", "length_known", "length_typed").drop("spare"), ["gram", "length_typed", "length_known"])
    close = met.groupBy("typed", "known").agg(F.count("*").alias("n"), F.min("spare").alias("spare")).filter(F.col("n") > F.col("spare"))
    rated = close.select("typed", "known", name_ratio("known", "typed").alias("ratio")).filter(F.col("ratio") >= least)
    return rated.groupBy("typed").agg(F.max(F.struct("ratio", "known")).alias("best")).select("typed", "best.known", "best.ratio")


def cells(lon: Column, lat: Column, metres: float) -> tuple[Column, Column]:
    """Grid cell whose sides are at least ``metres`` at the city's latitude."""
    return F.floor(lon * (METRES_LON / metres)), F.floor(lat * (METRES_LAT / metres))


def _around(df: DataFrame, metres: float) -> DataFrame:
    x, y = cells(F.col("lon"), F.col("lat"), metres)
    steps = F.array(*[F.struct((x + a).alias("cx"), (y + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return df.withColumn("_c", F.explode(steps)).select("*", "_c.cx", "_c.cy").drop("_c")


def within_distance(points: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """Points that have a place within ``metres``: an equality join on grid cells, then the exact distance."""
    x, y = cells(F.col("lon"), F.col("lat"), metres)
    own = points.withColumns({"cx": x, "cy": y})
    near = _around(places.select("lon", "lat"), metres).select("cx", "cy", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    close = (own["cx"] == near["cx"]) & (own["cy"] == near["cy"]) & (haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= metres)
    return own.join(near, close, "left_semi").drop("cx", "cy")


def _levels(highest: int) -> int:
    return max(1, (highest + 2).bit_length())


def _covered(low: Column, high: Column, levels: int) -> Column:
    """The fewest dyadic cells (level, cell) that make up the positions from ``low`` to ``high``: at each level at most one at
    either end."""
    step = F.struct(low.alias("a"), (high + 1).alias("b"), F.expr("CAST(array() AS array<struct<level:int,cell:bigint>>)").alias("out"))

    def next_level(at: Column, k: Column) -> Column:
        cell = lambda x: F.array(F.struct(k.cast("int").alias("level"), x.cast("bigint").alias("cell")))
        none = F.slice(at["out"], 1, 0)
        left = F.when((at["a"] < at["b"]) & (at["a"] % 2 == 1), cell(at["a"])).otherwise(none)
        a = F.when((at["a"] < at["b"]) & (at["a"] % 2 == 1), at["a"] + 1).otherwise(at["a"])
        right = F.when((a < at["b"]) & (at["b"] % 2 == 1), cell(at["b"] - 1)).otherwise(none)
        b = F.when((a < at["b"]) & (at["b"] % 2 == 1), at["b"] - 1).otherwise(at["b"])
        return F.struct(F.floor(a / 2).alias("a"), F.floor(b / 2).alias("b"), F.concat(at["out"], left, right).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), step, next_level)["out"]


def _above(position: Column, levels: int) -> Column:
    """Every dyadic cell that holds ``position``."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.floor(position / F.pow(F.lit(2.0), k)).cast("bigint").alias("cell")))


def range_matched(facts: DataFrame, segments: DataFrame, id_column: str, number: str) -> DataFrame:
    """The segment of the fact's street that holds its number: the narrowest one of the number's parity (``inside``), else the
    one nearest to it, whatever the parity. Equal ones go by segment_id. Adds segment_id, inside and off (how far the number
    is from the segment) to ``facts``; facts of streets without segments are left out.

    ``segments``: street_key, segment_id, parity, low, high; those without numbers, or with low above high, are left out.

    The number line of a street is cut into dyadic cells (one for each number, each two, each four, ...). A range is at most
    two cells of each level, a number lies in one of each level, and the numbers below it are at most one cell of each level,
    as are those above it. So ranges and their ends are reduced to one row for each cell first, and every different
    number of a street then finds all it needs by equality joins with as many rows as there are levels, however many segments its street has.
    """
    n = F.col(number)
    ranges = segments.filter("low <= high AND high >= 0").select("street_key", "segment_id", "parity", F.greatest("low", F.lit(0)).cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"), (F.col("high") - F.col("low")).cast("bigint").alias("span"))
    levels = _levels(ranges.agg(F.max("high")).first()[0] or 0)
    least = F.min("segment_id").alias("segment_id")
    # kind: 0 and 1 ranges by parity, 2 ranges of either, 3 ends below, 4 starts above; ``key`` is what the least of wins.
    by_parity = ranges.groupBy("street_key", "parity", "low", "high", "span").agg(least)
    inside = by_parity.select("street_key", F.col("parity").cast("int").alias("kind"), F.col("span").alias("key"), "segment_id", F.explode(_covered(F.col("low"), F.col("high"), levels)).alias("at"))
    either = ranges.groupBy("street_key", "low", "high").agg(least).select("street_key", F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("key"), "segment_id", F.explode(_covered(F.col("low"), F.col("high"), levels)).alias("at"))
    ends = ranges.groupBy("street_key", "high").agg(least).select("street_key", F.lit(3).alias("kind"), (-F.col("high")).alias("key"), "segment_id", F.explode(_above(F.col("high"), levels)).alias("at"))
    starts = ranges.groupBy("street_key", "low").agg(least).select("street_key", F.lit(4).alias("kind"), F.col("low").alias("key"), "segment_id", F.explode(_above(F.col("low"), levels)).alias("at"))
    cells_of = inside.unionByName(either).unionByName(ends).unionByName(starts).select("street_key", "kind", "at.level", "at.cell", "key", "segment_id")
    best = cells_of.groupBy("street_key", "kind", "level", "cell").agg(F.min(F.struct("key", "segment_id")).alias("best"))

    asked = facts.select("street_key", n.alias("_n")).filter("_n IS NOT NULL").distinct()
    place = F.least(F.greatest(F.col("_n"), F.lit(-1)), F.lit((1 << levels) - 1)).cast("bigint")
    own = F.explode(_above(place, levels)).alias("at")
    cell = F.col("at.cell")
    odd = cell % 2 == 1
    wanted = F.array(
        F.struct(F.pmod("_n", F.lit(2)).cast("int").alias("kind"), cell.alias("cell")),
        F.struct(F.lit(2).alias("kind"), cell.alias("cell")),
        F.struct(F.when(odd, 3).otherwise(4).alias("kind"), F.when(odd, cell - 1).otherwise(cell + 1).alias("cell")),
    )
    lookups = asked.select("street_key", "_n", own).select("street_key", "_n", "at.level", F.explode(wanted).alias("w")).select("street_key", "_n", "level", "w.kind", "w.cell")
    met = lookups.join(best, ["street_key", "kind", "level", "cell"])
    gap = F.when(F.col("kind") == 2, F.lit(0)).when(F.col("kind") == 3, F.col("_n") + F.col("best.key")).otherwise(F.col("best.key") - F.col("_n")).cast("bigint")
    held = F.min(F.when(F.col("kind") < 2, F.col("best"))).alias("held")
    near = F.min(F.when(F.col("kind") >= 2, F.struct(gap.alias("key"), F.col("best.segment_id").alias("segment_id")))).alias("near")
    found = met.groupBy("street_key", "_n").agg(held, near)
    found = found.select("street_key", F.col("_n").alias(number), F.coalesce("held.segment_id", "near.segment_id").alias("segment_id"), F.col("held").isNotNull().alias("inside"), F.when(F.col("held").isNotNull(), 0).otherwise(F.col("near.key")).cast("bigint").alias("off"))
    return facts.join(found, ["street_key", number])


#: Metres that bounds of distances are let off; distances are rounded to a tenth of it.
_SLACK = 1e-5


def _in_cells(places: DataFrame, side: str, corner: tuple[float, float], size: float) -> DataFrame:
    x, y = (F.floor((F.col(c) - low) / size) for c, low in zip("xy", corner, strict=True))
    return places.filter(F.col("side") == side).withColumns({f"{side}x": x, f"{side}y": y})


def _boxes(places: DataFrame, key: str, side: str, corner: tuple[float, float], size: float) -> DataFrame:
    """Cells of one side: how many places they hold, their box, the y of the westmost place, and the cell of four times the size around."""
    ends = [F.min("x").alias(f"west_{side}"), F.max("x").alias(f"east_{side}"), F.min("y").alias(f"south_{side}"), F.max("y").alias(f"north_{side}")]
    boxes = _in_cells(places, side, corner, size).groupBy(key, f"{side}x", f"{side}y").agg(F.count("*").alias(f"n_{side}"), *ends, F.min_by("y", "x").alias(f"y_{side}"))
    return boxes.withColumns({f"in_{side}x": F.shiftright(f"{side}x", 2), f"in_{side}y": F.shiftright(f"{side}y", 2)})


def _cut(pairs: DataFrame, places: DataFrame, key: str, corner: tuple[float, float], size: float) -> DataFrame:
    """Pairs of cells of ``size`` within ``pairs`` of cells four times as large, without those farther apart than two places that the key has."""
    around = pairs.select(key, "bound", *[F.col(c).alias(f"in_{c}") for c in ("ax", "ay", "bx", "by")])
    met = around.join(_boxes(places, key, "a", corner, size), [key, "in_ax", "in_ay"]).join(_boxes(places, key, "b", corner, size), [key, "in_bx", "in_by"])
    gap = lambda low, high: F.greatest(F.lit(0.0), F.col(f"{low}_a") - F.col(f"{high}_b"), F.col(f"{low}_b") - F.col(f"{high}_a"))
    seen = F.hypot(F.col("west_a") - F.col("west_b"), F.col("y_a") - F.col("y_b"))
    met = met.withColumns({"least": F.hypot(gap("west", "east"), gap("south", "north")), "seen": seen}).filter(F.col("least") <= F.col("bound") + _SLACK)
    met = checkpointed(met.select(key, "n_a", "n_b", "ax", "ay", "bx", "by", "least", "seen"))
    return met.join(met.groupBy(key).agg(F.min("seen").alias("bound")), key).filter(F.col("least") <= F.col("bound") + _SLACK).drop("least", "seen")


def nearest_pairs(a: DataFrame, b: DataFrame, key: str, at_once: int = 1_000_000, levels: int = 20) -> DataFrame:
    """For each key the nearest pair of all its points on either side, and the point halfway.

    ``a`` and ``b``: key, segment_id, lon, lat in degrees. Distances count to the micrometre, below which they are noise of the
    coordinates' last digits; of equal ones the smaller ids win. Points without coordinates come last.

    Points of one place are one. As long as more than ``at_once`` pairs of places are left, pairs of cells meet in their stead: each
    level cuts cells in sixteen and leaves out pairs that are too far apart to hold the nearest places. The places of the cells
    that remain are compared, each with each. ``at_once`` and ``levels`` bear on the time alone.
    """
    sides = [df.select(key, F.lit(side).alias("side"), "segment_id", "lon", "lat") for side, df in (("a", a), ("b", b))]
    every = sides[0].unionAll(sides[1]).filter(F.col(key).isNotNull()).groupBy(key, "side", "lon", "lat").agg(F.min("segment_id").alias("id"))
    every = checkpointed(every.withColumns({"x": F.col("lon") * METRES_LON, "y": F.col("lat") * METRES_LAT}))
    places = every.filter(F.abs("x") + F.abs("y") < float("inf"))
    sizes = [F.count_if(F.col("side") == side).alias(f"n_{side}") for side in "ab"]
    extent = [F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north")]
    pairs = places.groupBy(key).agg(*sizes, *extent).filter("n_a > 0 AND n_b > 0")
    work = [F.coalesce(F.sum(F.col("n_a").cast("double") * F.col("n_b")), F.lit(0.0)), F.count("*")]
    left, cells, *ends = pairs.agg(*work, F.min("west"), F.min("south"), F.max("east"), F.max("north")).first()
    west, south, east, north = (end or 0.0 for end in ends)
    # At first a key is one cell; sizes go down by powers of two, so that cells lie in one of the level before.
    corner, size = (west, south), max(east - west, north - south) * 1.001 + 0.001
    pairs = pairs.select(key, "n_a", "n_b", *[F.lit(0).cast("bigint").alias(c) for c in ("ax", "ay", "bx", "by")], F.lit(float("inf")).alias("bound"))
    for _ in range(levels):
        if left <= max(at_once, 4 * cells):
            break
        size /= 4
        pairs = _cut(pairs, places, key, corner, size)
        left, cells = pairs.agg(*work).first()
    for side in "ab":
        own = _in_cells(places, side, corner, size).select(key, f"{side}x", f"{side}y", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "lon", "lat")])
        pairs = pairs.join(own, [key, f"{side}x", f"{side}y"])
    far = F.hypot((F.col("lat_a") - F.col("lat_b")) * METRES_LAT, (F.col("lon_a") - F.col("lon_b")) * METRES_LON)
    pairs = pairs.withColumn("metres", F.round(far, 6)).filter(F.col("metres") <= F.col("bound") + _SLACK)
    best = top_per_group(pairs, [key], ["metres", "id_a", "id_b"]).select(key, "id_a", "lon_a", "lat_a", "id_b", "lon_b", "lat_b", "metres")
    least = [F.min(F.when(F.col("side") == side, F.col("id"))).alias(f"least_{side}") for side in "ab"]
    found = every.groupBy(key).agg(*sizes, *least).filter("n_a > 0 AND n_b > 0").drop("n_a", "n_b").join(best, key, "left")
    ids = {f"id_{side}": F.when(F.col("metres").isNull(), F.col(f"least_{side}")).otherwise(F.col(f"id_{side}")) for side in "ab"}
    return found.withColumns(ids | {"lon": (F.col("lon_a") + F.col("lon_b")) / 2, "lat": (F.col("lat_a") + F.col("lat_b")) / 2}).drop("least_a", "least_b")


def near_in_time(df: DataFrame, keys: Sequence[str], id_column: str, time: str, seconds: int) -> DataFrame:
    """Pairs of rows with equal keys at most ``seconds`` apart, the earlier first. Rows meet in time buckets, each row in
    its own and the one before, so no key is joined with all of itself.
    """
    t = F.unix_micros(time)
    rows = df.select(*keys, F.col(id_column).alias("id"), t.alias("t"), F.floor(t / (seconds * 1_000_000)).alias("slot"))
    later = rows.select(*keys, F.col("id").alias("id_b"), F.col("t").alias("t_b"), F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("slot"))
    pairs = rows.withColumnsRenamed({"id": "id_a", "t": "t_a"}).join(later, [*keys, "slot"])
    order = (F.col("t_b") > F.col("t_a")) | ((F.col("t_b") == F.col("t_a")) & (F.col("id_b") > F.col("id_a")))
    return pairs.filter(order & (F.col("t_b") - F.col("t_a") <= seconds * 1_000_000)).select(*keys, "id_a", "id_b")


def compared(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ, those that one side lacks included (as 0), with the difference."""
    both = left.select(key, F.col(value).alias("left_value")).join(right.select(key, F.col(value).alias("right_value")), key, "full")
    both = both.select(key, F.coalesce("left_value", F.lit(0)).alias("left_value"), F.coalesce("right_value", F.lit(0)).alias("right_value"))
    return both.withColumn("difference", F.col("left_value") - F.col("right_value")).filter("difference <> 0")
