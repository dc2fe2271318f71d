"""Readers of the yearly exports: CSV in its variants, archives, JSON lines, GeoJSON, wide sheets, paged services."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TICKET_SCHEMA = (
    "tag_number_masked string, date_of_infraction string, infraction_code string, infraction_description string, set_fine_amount string, time_of_infraction string, "
    "location1 string, location2 string, location3 string, location4 string, province string"
)


def first_of(df: DataFrame, *names: str) -> Column:
    """The first non-null of the columns that exist under any of ``names``, whatever their case; null if none does."""
    found = {c.lower(): c for c in df.columns}
    there = [F.col(f"`{found[n]}`") for n in names if n in found]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def csv_files(spark: SparkSession, paths: str | list[str], schema: str | None = None, encoding: str = "UTF-8", drop_bad: bool = False) -> DataFrame:
    """CSV or CSV.gz with a header. Quoted fields may hold line ends; bad rows become nulls, or go."""
    reader = spark.read.option("header", True).option("multiLine", True).option("encoding", encoding).option("mode", "DROPMALFORMED" if drop_bad else "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).csv(paths)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def merged(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames whose columns differ."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def sniffed_encoding(head: bytes) -> str:
    """From the first four bytes of a file."""
    if head.startswith(b"\xff\xfe"):
        return "UTF-16LE"
    if head.startswith(b"\xfe\xff"):
        return "UTF-16BE"
    if head.startswith(b"\xef\xbb\xbf"):
        return "UTF-8"
    return "UTF-16LE" if b"\x00" in head[:4] else "UTF-8"


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and content of files that one task can hold, such as yearly archives."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def encodings(files: DataFrame) -> DataFrame:
    """path and encoding of every one of ``files`` (path, content), from the first four bytes."""
    two, three = F.hex(F.substring("content", 1, 2)), F.hex(F.substring("content", 1, 3))
    zero = F.instr(F.regexp_replace(F.hex(F.substring("content", 1, 4)), "(..)", "$1 "), "00 ") > 0
    named = F.when(two == "FFFE", "UTF-16LE").when(two == "FEFF", "UTF-16BE").when(three == "EFBBBF", "UTF-8").when(zero, "UTF-16LE").otherwise("UTF-8")
    return files.select("path", named.alias("encoding"))


def archive_rows(files: DataFrame, member: str = "parking_tags") -> DataFrame:
    """Lines of the CSV members, whose name holds ``member``, of ZIP archives ``files`` (path, content): path, member, line_number, line."""

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(n for n in archive.namelist() if member in n.lower() and n.lower().endswith(".csv")):
                        with archive.open(name) as head:
                            encoding = sniffed_encoding(head.read(4))
                        with archive.open(name) as file:
                            lines = io.TextIOWrapper(file, encoding.replace("UTF-8", "utf-8-sig"), errors="replace", newline=None)
                            number = 0
                            while part := lines.readlines(1 << 20):
                                part = [line.rstrip("\n").lstrip("﻿") for line in part]
                                yield pd.DataFrame({"path": path, "member": name, "line_number": range(number + 1, number + 1 + len(part)), "line": part})
                                number += len(part)

    return files.select("path", "content").mapInPandas(unzip, "path string, member string, line_number long, line string")


def archive_table(rows: DataFrame) -> DataFrame:
    """Columns of archive lines under their members' own headers, as a map from lower-case name to text."""
    heads = rows.filter("line_number = 1").select("path", "member", F.split(F.lower("line"), ",").alias("names"))
    widest = heads.agg(F.max(F.size("names"))).first()[0] or 1  # one number; members may have any number of columns
    body = rows.filter("line_number > 1").join(heads, ["path", "member"])
    cells = F.from_csv(F.col("line"), F.lit(", ".join(f"c{k} string" for k in range(widest)))).alias("cells")
    parsed = body.select("path", "member", "line_number", "names", cells)
    values = F.array(*[F.col("cells")[f"c{k}"] for k in range(widest)])
    return parsed.select("path", "member", "line_number", F.map_from_arrays("names", F.slice(values, F.lit(1), F.size("names"))).alias("cells"))


def typed_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A typed CSV file; no rows if there is none under ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop):
        return spark.createDataFrame([], schema)
    return csv_files(spark, path, schema)


def wide_sheet(lines: DataFrame, skip: int) -> DataFrame:
    """Cells of sheets exported as lines (path, member, line_number, line), whose header comes after ``skip`` lines."""
    body = lines.filter(F.col("line_number") > skip).withColumn("line_number", F.col("line_number") - skip)
    return archive_table(body)


def joined_quotes(lines: DataFrame, bucket_lines: int = 100_000) -> DataFrame:
    """Records of ``lines`` (path, line_number, line): a line that leaves a quote open goes on in the next one.

    One row for each record: path, line_number of its first line, record. Whether a quote is open at a line depends on
    all lines before it, so files are cut into buckets, and only one row for each bucket is put in order across them.
    """
    size = F.char_length("line") - F.char_length(F.replace("line", F.lit('"'), F.lit("")))
    rows = lines.select("path", "line_number", "line", size.alias("quotes"), F.floor(F.col("line_number") / bucket_lines).alias("bucket"))
    before = Window.partitionBy("path").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("path", "bucket").agg(F.sum("quotes").alias("n"))
    sums = sums.select("path", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    inner = Window.partitionBy("path", "bucket").orderBy("line_number")
    earlier = F.coalesce(F.sum("quotes").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums, ["path", "bucket"]).withColumn("starts", (F.col("n_before") + earlier) % 2 == 0)
    start = F.when(F.col("starts"), F.col("line_number"))
    last = rows.groupBy("path", "bucket").agg(F.max(start).alias("own"))
    last = last.select("path", "bucket", F.max("own").over(before).alias("from_before"))
    rows = rows.join(last, ["path", "bucket"]).withColumn("record_line", F.coalesce(F.max(start).over(inner.rowsBetween(Window.unboundedPreceding, 0)), "from_before"))
    joined = F.array_sort(F.collect_list(F.struct("line_number", "line")))
    return rows.groupBy("path", "record_line").agg(F.array_join(F.transform(joined, lambda x: x["line"]), "\n").alias("record")).withColumnRenamed("record_line", "line_number")


def database_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, fetch_rows: int = 5000) -> DataFrame:
    """A table of a relational database, read in ranges of ``key`` by many tasks, ``fetch_rows`` at a time."""
    options = {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": partitions, "fetchsize": fetch_rows}
    return spark.read.format("jdbc").options(**options).load()


def preferred_files(names: list[str]) -> list[str]:
    """Of each folder the repaired exports (*_fixed.csv) if there are any, else all of its CSV files."""
    folders: dict[str, list[str]] = {}
    for name in sorted(names):
        if name.lower().endswith(".csv"):
            folders.setdefault(name.rpartition("/")[0], []).append(name)
    return [f for files in folders.values() for f in ([x for x in files if x.lower().endswith("_fixed.csv")] or files)]


def ticket_files(names: list[str]) -> list[str]:
    """Exports among ``names``: .csv or numbered parts such as .001, each once, in the given order."""
    return list(dict.fromkeys(n for n in names if re.search(r"\.(csv|\d{3})$", n, re.I)))


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(paths)


def positioned(df: DataFrame) -> DataFrame:
    """Adds file and position within it, which order rows as they stand in the files."""
    return df.withColumns({"file": F.input_file_name(), "position": F.monotonically_increasing_id()})


def lookup(df: DataFrame, key: Column, first_wins: bool, *order: str) -> DataFrame:
    """One row for each key: the first or the last by ``order``."""
    best = (F.min_by if first_wins else F.max_by)(F.struct("*"), F.struct(*order))
    return df.groupBy(key.alias("lookup_key")).agg(best.alias("row")).select("lookup_key", "row.*")


def geojson_features(spark: SparkSession, paths: str | list[str], properties: str) -> DataFrame:
    """Features of GeoJSON collections: position, the properties asked for, and the geometry as JSON text."""
    raw = spark.read.text(paths, wholetext=True)
    schema = f"struct<features: array<struct<properties: struct<{properties}>, geometry: string>>>"
    return raw.select(F.posexplode(F.from_json("value", schema)["features"]).alias("position", "f")).select("position", "f.properties.*", "f.geometry")


def geojson_lines(spark: SparkSession, paths: str | list[str], properties: str) -> DataFrame:
    """Features of GeoJSON collections that have one feature in each line: the properties asked for, and the geometry as JSON
    text. Files are split as Spark likes; lines that hold no feature are left out."""
    line = F.regexp_replace(F.trim("value"), "^,|,$", "")
    parsed = F.from_json(line, f"struct<type: string, properties: struct<{properties}>, geometry: string>")
    return spark.read.text(paths).select(parsed.alias("f")).filter("f.type = 'Feature'").select("f.properties.*", "f.geometry")


def wide_to_long(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row for each cell of ``columns`` that holds a number."""
    long = df.select(*ids, *[F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in columns]).unpivot(ids, columns, name, value)
    return long.filter(F.col(value).isNotNull())


def site_maps(long: DataFrame, site: str, name: str, value: str) -> DataFrame:
    """Sites that occur in several rows become one: cells under the same name are added."""
    sums = long.groupBy(site, name).agg(F.sum(value).alias(value))
    return sums.groupBy(site).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("cells"), F.sum(value).alias("total"))


class PagedSource:
    """A service that hands out rows in pages: ``fetch(offset, limit, where)`` gives a list of dicts.

    Pages are a small list of offsets on the driver; each is fetched in a task of its own.
    """

    def __init__(self, fetch, schema: str, limit: int = 5000):
        self.fetch, self.schema, self.limit = fetch, schema, limit

    def read(self, spark: SparkSession, total: int, where: str | None = None) -> DataFrame:
        fetch, limit = self.fetch, self.limit
        pages = spark.range(0, total, limit, max(1, -(-total // limit)))

        def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for offset in frame["id"].tolist():
                    if rows := fetch(offset, limit, where):
                        yield pd.DataFrame(rows)

        return pages.mapInPandas(load, self.schema)
