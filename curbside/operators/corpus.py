"""Training records from tickets: splits, prompts, duplicates, hotspots and JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.functions.text import template
from curbside.operators.windows import top_per_group

#: Months whose tickets are held back for evaluation.
EVAL_MONTHS = (3, 10, 11, 12)


def split_of(month: Column) -> Column:
    return F.when(month.isin(*EVAL_MONTHS), "eval").otherwise("train")


def records(rows: DataFrame, prompt: str, completion: str, keep: Column | None = None, required: Sequence[str] = ()) -> DataFrame:
    """Rows with ``prompt`` and ``completion`` filled from {column} templates; rows without a required text are left out."""
    for c in required:
        rows = rows.filter(F.trim(F.col(c).cast("string")) != "")
    if keep is not None:
        rows = rows.filter(keep)
    columns = {c: F.col(c) for c in rows.columns}
    return rows.withColumns({"prompt": template(prompt, columns), "completion": template(completion, columns)})


def distinct_examples(rows: DataFrame, order: str) -> DataFrame:
    """Of equal (split, prompt, completion) the first by ``order``."""
    return rows.groupBy("split", "prompt", "completion").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("split", "prompt", "completion")]), order).alias("r")).select("split", "prompt", "completion", "r.*")


def hotspots(tickets: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` busiest places of every month, weekday and hour, ranked. ``tickets``: month, weekday, hour, place, fine, lat, lon."""
    sums = tickets.groupBy("month", "weekday", "hour", "place").agg(F.count("*").alias("n"), F.sum("fine").cast("decimal(28,2)").alias("fines"), F.first("lat", ignorenulls=True).alias("lat"), F.first("lon", ignorenulls=True).alias("lon"))
    return top_per_group(sums, ["month", "weekday", "hour"], [F.desc("n"), F.desc("fines"), "place"], k, "rank")


def chat_lines(rows: DataFrame, system: str | None = None) -> DataFrame:
    """One JSON line for each record, as messages."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = [message("user", F.col("prompt")), message("assistant", F.col("completion"))]
    if system:
        messages.insert(0, message("system", F.lit(system)))
    return rows.select(F.to_json(F.struct(F.array(*messages).alias("messages"))).alias("value"))


def completion_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("prompt", "completion")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
