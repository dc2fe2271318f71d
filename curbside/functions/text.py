"""Text normalisers of addresses, streets, wards and labels, all as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short spellings of street types and of directions, with the long ones.
STREET_TYPES = {
    "ST": "STREET", "RD": "ROAD", "AVE": "AVENUE", "AV": "AVENUE", "BLVD": "BOULEVARD", "BL": "BOULEVARD", "DR": "DRIVE", "PKWY": "PARKWAY", "HWY": "HIGHWAY", "CRES": "CRESCENT",
    "CR": "CRESCENT", "CIR": "CIRCLE", "CRT": "COURT", "CT": "COURT", "PL": "PLACE", "PLZ": "PLAZA", "SQ": "SQUARE", "TER": "TERRACE", "TRL": "TRAIL", "LN": "LANE", "PK": "PARK", "EXPY": "EXPRESSWAY",
}
DIRECTIONS = {"E": "EAST", "W": "WEST", "N": "NORTH", "S": "SOUTH", "NE": "NORTHEAST", "NW": "NORTHWEST", "SE": "SOUTHEAST", "SW": "SOUTHWEST"}
# Words that only say where along a street a ticket was written.
POSITION_WORDS = ["NR", "AT", "OPP", "N/S", "S/S", "E/S", "W/S", "IFO", "RO", "SO", "NO", "EO", "WO"]
# What separates the two streets of an intersection, in the order in which it is looked for.
INTERSECTION_MARKS = [" / ", " & ", " AND ", " @ ", " AT ", " N/O ", " S/O ", " E/O ", " W/O ", " NORTH OF ", " SOUTH OF ", " EAST OF ", " WEST OF "]


def clean_address(c: Column) -> Column:
    """Upper case without outer spaces; null if nothing is left."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def street_of_location(c: Column) -> Column:
    """Street of a location: without bounds (NB, SB, ...), house number and dashes; null if nothing is left."""
    c = F.regexp_replace(F.upper(c), r"\b(NB|SB|EB|WB)\b", "")
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.nullif(F.trim(F.regexp_replace(c, r"^[0-9\- ]+", "")), F.lit(""))


def street_label(c: Column) -> Column:
    """Street for display: without one leading number, 'Unknown' if nothing is left."""
    c = F.trim(F.regexp_replace(F.upper(F.trim(c)), r"^[0-9]+\s*", ""))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))


def alnum_tokens(c: Column) -> Column:
    """Upper-case letters and digits, other runs as one space."""
    return F.trim(F.regexp_replace(F.upper(c), r"[^A-Z0-9]+", " "))


def street_key(c: Column) -> Column:
    """Tokens with street types and directions in their long spelling."""
    long = F.create_map(*[F.lit(x) for pair in (STREET_TYPES | DIRECTIONS).items() for x in pair])
    return F.array_join(F.transform(F.split(alnum_tokens(c), " "), lambda t: F.coalesce(F.try_element_at(long, t), t)), " ")


def without_direction(key: Column) -> Column:
    """A street key without a direction at its end."""
    return F.regexp_replace(key, f" ({'|'.join(DIRECTIONS.values())})$", "")


def _leading_numbers(c: Column) -> Column:
    """The number tokens that an address begins with, each with a space behind it; the first and the last may have a letter."""
    return F.regexp_extract(F.concat(alnum_tokens(c), F.lit(" ")), r"^(\d+[A-Z]? (?:\d+ )*(?:\d+[A-Z] )?)", 1)


def house_number(c: Column) -> Column:
    """House number of an address: the last of the numbers it begins with; null without one."""
    return F.regexp_extract(_leading_numbers(c), r"(\d+)[A-Z]? $", 1).try_cast("int")


def numbered_street(c: Column) -> Column:
    """Street behind the house number. Its letter, which may belong to the name, goes before the street if several numbers
    came first, else behind it, unless the street holds that letter anyway."""
    numbers = _leading_numbers(c)
    rest = F.trim(F.substring(F.concat(alnum_tokens(c), F.lit(" ")), F.char_length(numbers) + 1, F.char_length(c) + 1))
    letter = F.regexp_extract(numbers, r"\d([A-Z]) $", 1)
    several = F.size(F.split(F.trim(numbers), " ")) > 1
    placed = F.when(several, F.concat(letter, F.lit(" "), rest)).when(F.contains(rest, letter), rest).otherwise(F.concat(rest, F.lit(" "), letter))
    return F.trim(F.when(letter == "", rest).otherwise(placed))


def without_house_number(c: Column) -> Column:
    return F.regexp_replace(alnum_tokens(c), r"^\d{1,6}[A-Z]? ", "")


def intersection_streets(c: Column) -> Column:
    """The two street keys of an intersection, split at the first mark that has a street on both sides; null if it is none."""

    def sides(mark: str) -> Column:
        parts = F.filter(F.transform(F.split(F.upper(c), re.escape(mark)), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.size(parts) >= 2, F.slice(parts, 1, 2))

    return F.transform(F.coalesce(*[sides(m) for m in INTERSECTION_MARKS]), street_key)


def without_position_words(c: Column) -> Column:
    """Address without leading words such as NR or N/S, however many."""
    words = "|".join(sorted(POSITION_WORDS, key=len, reverse=True))
    return F.regexp_replace(F.trim(F.upper(c)), rf"^((?:{words})\s+)+", "")


def address_candidates(c: Column) -> Column:
    """Spellings to try for a free-text place, the most exact first."""
    base = alnum_tokens(c)
    return F.array_distinct(F.array(base, F.trim(F.regexp_replace(base, r"\b(NEAR|OF|THE)\b", "")), F.trim(F.regexp_replace(base, r"\b(N|S|E|W)$", "")), without_house_number(c)))


def composed_location(second: Column, third: Column, fourth: Column, descriptor: Column) -> Column:
    """'second, third / fourth, descriptor' from the parts that are there; position words are no descriptor."""
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    cross = F.nullif(F.concat_ws(" / ", blank(third), blank(fourth)), F.lit(""))
    useful = F.when(~F.upper(F.trim(descriptor)).isin(POSITION_WORDS), blank(descriptor))
    return F.concat_ws(", ", blank(second), cross, useful)


def ward_name(c: Column) -> Column:
    """'10.0' and '10' become 'Ward 10'; other names stay."""
    number = F.trim(c).try_cast("double")
    return F.when(number.isNotNull() & (number == F.floor(number)), F.concat(F.lit("Ward "), number.cast("bigint").cast("string"))).otherwise(F.trim(c))


def ward_code(c: Column) -> Column:
    """First number of a ward name; codes over 25 that end in 0 lose zeros until they fit."""
    n = F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    for _ in range(6):
        n = F.when((n > 25) & (n % 10 == 0), (n / 10).cast("int")).otherwise(n)
    return n


def ward_code_and_name(c: Column) -> Column:
    """struct(code, name): 'Name (7)', then 'Ward 7', then 'Name 7'."""
    in_brackets, spelt, trailing = (F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"\((\d{1,2})\)", r"(?i)ward\s+(\d{1,2})", r"(\d{1,2})\s*$"))
    name = F.trim(F.regexp_replace(F.regexp_replace(c, r"\(\d{1,2}\)", ""), r"(?i)^ward\s+\d{1,2}$|\s+\d{1,2}\s*$", ""))
    return F.struct(F.coalesce(in_brackets, spelt, trailing).cast("int").alias("code"), F.nullif(name, F.lit("")).alias("name"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def title_case(c: Column) -> Column:
    """Every run of letters capitalised, as in 'Park-On Private'; letters behind an apostrophe too."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+|[^a-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def masked_number(c: Column) -> Column:
    """The digits of a masked tag such as ***03850; null if it is no number."""
    return F.replace(c, F.lit("*"), F.lit("")).try_cast("bigint")


def template(text: str, columns: dict[str, Column]) -> Column:
    """``text`` with {name} replaced by columns; names that are unknown stay as written."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", text):
        if m[1] in columns:
            parts += [F.lit(text[at : m.start()]), F.coalesce(columns[m[1]].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(text[at:]))
