"""Numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    """Exact amount, rounded half up to cents; null for what is no number."""
    return F.round(c.try_cast("decimal(38,6)"), 2).cast("decimal(18,2)")


def safe_number(c: Column) -> Column:
    """A number from text with separators and signs; 0 if it is none."""
    return F.coalesce(F.regexp_replace(F.trim(c.cast("string")), "[$,]", "").try_cast("double"), F.lit(0.0))


def abbreviated(count: Column) -> Column:
    """1234 as 1.2K, 2500000 as 2.5M."""
    return F.when(count >= 1_000_000, F.concat(F.format_string("%.1f", count / 1_000_000.0), F.lit("M"))).when(count >= 1000, F.concat(F.format_string("%.1f", count / 1000.0), F.lit("K"))).otherwise(count.cast("string"))


def stops(value: Column, table: list[tuple[float, str]], below: str) -> Column:
    """Name of the highest stop that ``value`` reaches."""
    out = F.lit(below)
    for least, name in sorted(table):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return out


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def pg_array(c: Column) -> Column:
    """'{1,2,3}' as an array of ints."""
    inner = F.regexp_replace(c, r"^\{|\}$", "")
    return F.when(inner == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("int")))


def pg_array_text(c: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("}"))


def sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def clean_numbers(c: Column, limit: int) -> Column:
    """The first ``limit`` numbers of an array of texts; what is no number is left out."""
    return F.slice(F.filter(F.transform(c, lambda x: x.try_cast("double")), lambda x: x.isNotNull()), 1, limit)


def map_get(m: Column, key: Column, default: int = 0) -> Column:
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def top_entry(m: Column) -> Column:
    """Key of the largest value of a map; the smaller key of equals."""
    best = F.array_sort(F.map_entries(m), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.try_element_at(best, F.lit(1))["key"]


def counts_from_json(c: Column) -> Column:
    """A JSON object of counts; null for anything else."""
    return F.from_json(c, "map<string,bigint>")


def first_point(geometry: Column) -> Column:
    """[lon, lat] of a GeoJSON Point or of the first point of a MultiPoint."""
    kind = F.get_json_object(geometry, "$.type")
    path = F.when(kind == "MultiPoint", F.get_json_object(geometry, "$.coordinates[0]")).when(kind == "Point", F.get_json_object(geometry, "$.coordinates"))
    return F.from_json(path, "array<double>")


def stable_digest(**columns: Column) -> Column:
    """SHA-1 of the columns as JSON with sorted names."""
    return F.sha1(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])))


def year_mask(year: Column, base: int) -> Column:
    """A mask with the bit of one year; ``base`` is the year of bit 0."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (year - base).cast("int"))


def mask_has(mask: Column, value: Column | int, base: int) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(value) - base).cast("int") if isinstance(value, int) else (value - base).cast("int"))
    return mask.bitwiseAND(bit) != 0


def ticket_hash(*fields: Column) -> Column:
    """MD5 of the fields joined by a pipe, null as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))
