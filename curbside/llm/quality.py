"""Quality classifier: a document classifier under a hierarchy of empirical-Bayes site posteriors.

A logistic model over text statistics gives each document's own evidence. The evidence of all documents is summed by
path (host and language section) and by host; a host's rate is shrunk towards the global rate, a path's towards its
host's, each with a strength estimated from how much the groups really differ. A site's posterior then moves its
documents' odds, within a bound, so that sparse sites change nothing and no site outweighs a clear text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import cut, labelled_texts, stored
from curbside.llm.linear import Logistic, fit_logistic

#: The document classifier is fitted on so many labelled rows at most, the first of each label by a hash of doc_id.
SAMPLE_PER_LABEL = 4000
#: A site moves the log-odds of its documents by so much at most.
SITE_WEIGHT, SITE_BOUND = 0.5, 1.0
KEEP_AT = 0.5
#: Probabilities are rounded to so many digits, so that sums of them are exact.
_DIGITS = 9
#: Up to so many sites (some MB) are sent to the tasks; texts then stay where they are.
BROADCAST_SITES = 100_000
_WORD = re.compile(r"\S+")
_NAMES = "letters upper digits symbols marks pipes word_length distinct top_word repeat lines short log_words plain decorated".split()


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text that do not depend on its language."""
    text = text or ""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [s for s in text.split("\n") if s.strip()]
    plain = sum(map(str.isalpha, words))
    dense = "".join(words)
    letters = sum(map(str.isalpha, dense)) if not dense.isascii() else len(dense) - len(re.sub(r"[A-Za-z]+", "", dense))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", dense))
    digits = len(re.findall(r"\d", dense))
    chars = max(1, len(dense))
    repeat = sum(map(str.__eq__, words[1:], words[:-1]))
    return [
        letters / chars,
        upper / chars,
        digits / chars,
        (chars - letters - digits) / chars,
        (text.count("!") + text.count("?")) / n,
        sum(map(text.count, "|#%$&*=~<>{}")) / n,
        min(chars / n, 40) / 10,
        len(counts) / n,
        (counts.most_common(1)[0][1] if counts else 0) / n,
        repeat / n,
        len(set(lines)) / max(1, len(lines)),
        1.0 if len(words) < 8 else 0.0,
        np.log1p(len(words)) / 10,
        plain / n,
        sum(1 for w in counts if not w[-1].isalnum() and len(w) > 1 and not w[-2].isalnum()) / max(1, len(counts)),
    ]


def _fit(docs: DataFrame, labels: DataFrame, per_label: int) -> Logistic:
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y")).distinct()
    shares = dict(known.groupBy("y").count().collect())  # two numbers

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "x": [statistics(t) for t in frame["text"]]})

    rows = labelled_texts(docs, known, per_label).mapInPandas(features, "doc_id long, y int, x array<double>").toPandas()
    rows = rows.sort_values(["doc_id", "y"])  # sums of doubles depend on the order
    if rows["y"].nunique() < 2:
        return Logistic.constant(len(_NAMES), 1.0)
    y = rows["y"].to_numpy(float)
    weight = np.where(y > 0, shares[1] / max(1, y.sum()), shares[0] / max(1, (1 - y).sum()))
    return fit_logistic(np.array(rows["x"].tolist()), y, weight)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: float, size: str, total: str) -> float:
    """Prior strength, in documents: how little the groups' rates differ beyond chance (method of moments)."""
    rate = F.col(total) / F.col(size)
    row = groups.agg(
        F.sum(F.col(size) * (rate - mean) * (rate - mean)).alias("spread"), F.count("*").alias("k"), F.sum(size).alias("n"), F.sum(F.col(size) * F.col(size)).alias("n2")
    ).first()
    noise = mean * (1 - mean)
    if not row["n"] or row["k"] < 2 or noise <= 0:
        return 1e4
    between = (row["spread"] - noise * (row["k"] - 1)) / max(1e-9, row["n"] - row["n2"] / row["n"])
    return float(f"{min(1e4, max(10.0, noise / between - 1)):.6g}") if between > 0 else 1e4  # no digits that depend on the order of rows


def _keys(docs: DataFrame, host: Column | None, path: Column | None) -> list[Column]:
    """What a row's score depends on, and its id: _id, _none (no id), _own (SHA-256 of the text), host and path."""
    return [
        F.coalesce(F.col("doc_id"), F.lit(0)).alias("_id"),
        F.col("doc_id").isNull().alias("_none"),
        F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)).alias("_own"),
        F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit("")).alias("host"),
        F.coalesce((F.col("lang") if path is None else path).cast("string"), F.lit("")).alias("path"),
    ]


def _evidence(docs: DataFrame, labels: DataFrame, host: Column | None, path: Column | None, per_label: int) -> DataFrame:
    """The keys of every row of ``docs`` with p_text. Stored, so that texts are scored once for all that follows."""
    model = _fit(docs, labels, per_label)

    @F.pandas_udf("double")
    def p_text(texts: pd.Series) -> pd.Series:
        return pd.Series(np.round(model.probability(np.array([statistics(t) for t in texts]).reshape(-1, len(_NAMES))), _DIGITS))

    return stored(docs.select(*_keys(docs, host, path), p_text(F.col("text").cast("string")).alias("p_text")), "quality")


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_posterior, path_posterior) of every site of ``evidence`` (host, path, p_text), and the mean of
    p_text. Sums are whole numbers, so they do not depend on the order of rows."""
    units = F.sum(F.round(F.col("p_text") * 10**_DIGITS).cast("long"))
    paths = cut(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), (units.cast("double") / 10**_DIGITS).alias("s")))
    row = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not row["n"]:
        mean, of_hosts, of_paths = 0.5, 1e4, 1e4
    else:
        mean = round(min(1 - 1e-6, max(1e-6, row["s"] / row["n"])), _DIGITS)
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        of_hosts, of_paths = _strength(hosts, mean, "n", "s"), _strength(paths, mean, "n", "s")
    hosts = paths.groupBy("host").agg(F.round((F.sum("s") + of_hosts * mean) / (F.sum("n") + of_hosts), _DIGITS).alias("host_posterior"))
    sites = paths.join(hosts, "host").select(
        "host", "path", "host_posterior", F.round((F.col("s") + of_paths * F.col("host_posterior")) / (F.col("n") + of_paths), _DIGITS).alias("path_posterior")
    )
    if paths.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:  # else a shuffled join, whose hot sites Spark splits
        sites = F.broadcast(sites)
    return sites, mean


def _judged(evidence: DataFrame) -> DataFrame:
    """``evidence`` with host_posterior, path_posterior, posterior and keep."""
    sites, mean = site_posteriors(evidence)
    shift = SITE_WEIGHT * (_logit(F.col("path_posterior")) - _logit(F.lit(mean)))
    odds = _logit(F.col("p_text")) + F.greatest(F.lit(-SITE_BOUND), F.least(F.lit(SITE_BOUND), shift))
    out = evidence.join(sites, ["host", "path"]).withColumn("posterior", F.round(1 / (1 + F.exp(-odds)), _DIGITS))
    return out.withColumn("keep", F.col("posterior") >= KEEP_AT)


def _whole_rows(docs: DataFrame, host: Column | None, path: Column | None) -> DataFrame:
    """The keys of every row of ``docs``, and all its columns packed in a column ``row``, so that no name can clash."""
    return docs.select(*_keys(docs, host, path), F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"))


_ROW_KEYS = ["_id", "_none", "_own", "host", "path"]


def scored(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, source, lang, ...) with p_text, host_posterior, path_posterior,
    posterior, quality_keep. ``host`` and ``path`` are columns that name a document's site (by default its source and its
    language section), ``per_label`` is the bound of the sample.

    Null texts count as empty and very long ones are read whole; null hosts and paths are a site of their own. ``labels``
    (doc_id, quality, ...) may be empty: then every text has the same evidence and all are kept. Documents with both
    marks count for both; a posterior of exactly KEEP_AT is kept. An empty table gives no rows, repeated rows appear
    again; columns of ``docs`` named like a score are replaced, all others stay as they are.
    """
    scores = _judged(_evidence(docs, labels, host, path, per_label)).withColumnRenamed("keep", "quality_keep").dropDuplicates(_ROW_KEYS)
    own = ["p_text", "host_posterior", "path_posterior", "posterior", "quality_keep"]
    kept_columns = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in own]
    return _whole_rows(docs, host, path).join(scores, _ROW_KEYS).select(*kept_columns, *own)


def decisions(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """One row per row of ``docs``: doc_id, p_text, host_posterior, path_posterior, posterior, keep.

    Nulls, long texts, ties, repeated rows and empty tables as in :func:`scored`; other columns are ignored.
    """
    found = _judged(_evidence(docs, labels, host, path, per_label))
    return found.select(F.when(~F.col("_none"), F.col("_id")).alias("doc_id"), "p_text", "host_posterior", "path_posterior", "posterior", "keep")


def kept(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns as they were, whatever their names.

    Nulls, long texts, ties, repeated rows and empty tables as in :func:`scored`.
    """
    chosen = _judged(_evidence(docs, labels, host, path, per_label)).filter("keep").select(*_ROW_KEYS)
    rows = _whole_rows(docs, host, path).join(chosen, _ROW_KEYS, "left_semi")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
