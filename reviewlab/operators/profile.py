"""Counts, shares, length profiles and class reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.operators.frames import default_source, join_source
from reviewlab.session import stored

PERCENTILES = (0.1, 0.5, 0.9, 0.95, 0.99)


def round_half_up(num: Column, den: Column, digits: int) -> Column:
    """``num/den`` rounded half-up to ``digits`` decimals in exact integer
    arithmetic, then scaled back (no binary-float tie surprises)."""
    s = 10 ** digits
    return (F.floor((num * (2 * s) + den) / (den * 2)) / F.lit(float(s))).cast("double")


# G1 / G2 -------------------------------------------------------------------
def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Counts and shares of the total (pandas ``normalize=True``). The counts
    are written, so that the total comes from them and the rows are read once."""
    counts = stored(value_counts(df, col), "value-counts")
    return counts.withColumn("share", F.round(F.col("n") / counts.agg(F.sum("n")).scalar(), 6))


# G3 ------------------------------------------------------------------------
def length_profile(df: DataFrame, text: str = "text", by: str | None = None) -> DataFrame:
    """pandas ``describe`` of code-point lengths: count, mean, sample std,
    min, exact percentiles (linear interpolation), max."""
    ln = F.length(text)
    aggs = [F.count(ln).alias("count"), F.round(F.avg(ln), 6).alias("mean"),
            F.round(F.stddev_samp(ln), 6).alias("std"), F.min(ln).alias("min"),
            F.max(ln).alias("max"),
            F.percentile(ln, list(PERCENTILES)).alias("__p")]
    g = df.groupBy(by) if by else df
    out = g.agg(*aggs)
    for i, p in enumerate(PERCENTILES):
        out = out.withColumn(f"p{int(round(p * 100))}", F.round(F.col("__p")[i], 6))
    return out.drop("__p")


# G4 / G5 -------------------------------------------------------------------
class StepCounters:
    """Counters of the training preparation, collected while its rows go
    through: ``watch`` marks a step, and after the rows were written once
    ``report`` has the figures (G4)."""

    def __init__(self, max_len: int, text: str = "text"):
        self.max_len, self.text, self.seen = max_len, text, {}

    def watch(self, df: DataFrame, step: str) -> DataFrame:
        """``df``, with its rows, its empty texts and its long texts counted."""
        size = F.length(self.text)
        self.seen[step] = Observation(f"{step}-{uuid.uuid4().hex}")
        return df.observe(self.seen[step], F.count(F.lit(1)).alias("rows"), F.count_if(size == 0).alias("empty"), F.count_if(size > self.max_len).alias("long"))

    def report(self, spark: SparkSession) -> DataFrame:
        """One row, from steps ``raw``, ``deduped``, ``cleaned`` and ``shortened``."""
        raw, deduped, cleaned, shortened = (self.seen[s].get for s in ("raw", "deduped", "cleaned", "shortened"))
        row = (raw["rows"], raw["rows"] - deduped["rows"], cleaned["empty"], cleaned["long"], shortened["long"])
        return spark.createDataFrame([row], "rows_raw long, duplicates_removed long, empty_removed long, long_before long, long_after long")


def retention(raw: DataFrame, final: DataFrame) -> DataFrame:
    r = raw.agg(F.count(F.lit(1))).scalar()
    f = final.agg(F.count(F.lit(1))).scalar()
    return raw.sparkSession.range(1).select(
        r.alias("rows_raw"), f.alias("rows_final"), (r - f).alias("rows_removed"),
        F.round(f * 100.0 / r, 2).alias("pct_kept"),
        F.round((r - f) * 100.0 / r, 2).alias("pct_removed"))


# G6 ------------------------------------------------------------------------
def class_distribution(pred: DataFrame, label: str = "label") -> DataFrame:
    """All three classes with count, one-decimal percent and chart bar
    height ``max(percent, 8)`` for non-empty classes."""
    sp = pred.sparkSession
    counts = (pred.filter(F.col(label).isin(*K.LABELS))
              .groupBy(F.col(label).cast("int").alias("label"))
              .agg(F.count(F.lit(1)).alias("n")))
    grid = sp.createDataFrame([(x,) for x in K.LABELS], "label int")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    tot = F.sum(n).over(Window.partitionBy())  # one row a class
    pct = F.when(tot > 0, round_half_up(n * 100, tot, 1)).otherwise(F.lit(0.0))
    exact = F.when(tot > 0, n * 100.0 / tot).otherwise(F.lit(0.0))
    bar = F.when((tot > 0) & (n > 0), F.greatest(exact, F.lit(K.BAR_MIN_HEIGHT))).otherwise(F.lit(0.0))
    return (grid.join(F.broadcast(counts), "label", "left")
            .select("label", n.alias("n"), tot.alias("total"), pct.alias("pct"),
                    F.round(bar, 6).alias("bar_height")))


# G7 ------------------------------------------------------------------------
def source_distribution(pred: DataFrame, reviews: DataFrame, key: str = "ID",
                        label: str = "label", src: str = "src", order: str | None = None) -> DataFrame:
    """Class x source counts, totals and one-decimal percents, sources by
    total descending. One shuffle for the join, one for the grouped
    conditional counts (a pivot with fixed values, partially aggregated)."""
    p = pred.select(key, F.col(label).cast("int").alias("label")).filter(F.col("label").isin(*K.LABELS))
    j = join_source(p, reviews, key, src, order=order)
    out = j.groupBy(src).agg(*[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in K.LABELS],
                             F.count(F.lit(1)).alias("total"))
    for x in K.LABELS:
        out = out.withColumn(f"pct_{x}", round_half_up(F.col(f"n_{x}") * 100, F.col("total"), 1))
    return out.orderBy(F.col("total").desc(), F.col(src))


# G8 ------------------------------------------------------------------------
def class_weights(df: DataFrame, label: str = "label", mode: str = "inverse") -> DataFrame:
    """``inverse``: total / count per label (unnormalised); ``balanced``:
    total / (k * count) as in the library's ``class_weight='balanced'``."""
    counts = value_counts(df, label)
    classes = Window.partitionBy()  # one row a class
    tot = F.sum("n").over(classes)
    if mode == "inverse":
        w = tot / F.col("n")
    elif mode == "balanced":
        w = tot / (F.count(F.lit(1)).over(classes) * F.col("n"))
    else:
        raise ValueError("mode must be 'inverse' or 'balanced'")
    return counts.withColumn("weight", F.round(w, 6))
