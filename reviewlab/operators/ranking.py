"""Exact rank of rows within a group, ordered by a seeded hash, without
putting a whole group on one task.

A plain ``row_number() OVER (PARTITION BY g ORDER BY h)`` sends every row
of ``g`` to one task; with one source or one label holding a third of the
data that task is the job. Instead:

1. count rows per group (partial aggregation, tiny output);
2. give each group a hash-prefix length so that a bucket holds about
   ``target_rows`` rows (hot groups get more buckets);
3. count rows per (group, bucket) and turn them into cumulative offsets
   with a window over that count table (``#buckets`` rows per group);
4. rank = bucket offset + ``row_number`` within (group, bucket).

The count tables are written out, so that Spark knows their size and
broadcasts them where they are small: the rows then move once, into their
buckets. Because the hash is ``md5(seed|key)`` the result does not depend on
partitioning or on task retries.

Where only the first rows of a group are wanted, ``cut_points`` finds the last
of them without ranking any: a histogram of hash prefixes per group shows in
which bucket the quota is reached, a finer one of that bucket narrows it down,
and the few rows of the last bucket give the cut. Rows are then kept by a
comparison with their group's cut and never move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.session import stored

#: Hex digits of the hash by which a cut is narrowed down, step by step.
DIGITS = (3, 6)
TARGET_ROWS = 1_000_000
MAX_PREFIX = 6


def seeded_hash(seed, key) -> Column:
    """Hex ``md5("seed|key")``: uniform, stable, identical in DuckDB."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def unit_float(s: Column) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of ``md5(s)``."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _prefix_len(n: Column, target_rows: int) -> Column:
    # smallest p with n / 16^p <= target_rows
    p = F.ceil(F.log(16.0, F.greatest(n / F.lit(float(target_rows)), F.lit(1.0))))
    return F.least(F.greatest(p, F.lit(0)), F.lit(MAX_PREFIX)).cast("int")


def rank_within(df: DataFrame, group: Sequence[str], order_hash: str, key: str,
                out: str = "rank", quota: Column | None = None,
                target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add ``out``: 1-based position of each row inside its group ordered by
    (``order_hash``, ``key``). If ``quota`` (a per-row column, e.g. a
    group's cap) is given, rows whose whole bucket lies past the quota are
    dropped before the per-bucket sort."""
    g = F.struct(*[F.col(c) for c in group]) if group else F.lit(0)
    d = df.withColumn("__g", g)
    counts = stored(d.groupBy("__g").agg(F.count(F.lit(1)).alias("__n")).select("__g", _prefix_len(F.col("__n"), target_rows).alias("__p")), "rank-counts")
    d = d.join(counts, "__g").withColumn("__b", F.expr(f"substring({order_hash}, 1, __p)"))
    bc = d.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__bn"))
    w = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bc = stored(bc.select("__g", "__b", F.coalesce(F.sum("__bn").over(w), F.lit(0)).alias("__off")), "rank-offsets")
    d = d.join(bc, ["__g", "__b"])
    if quota is not None:
        d = d.filter(F.col("__off") < quota)
    rn = F.row_number().over(Window.partitionBy("__g", "__b").orderBy(order_hash, key))
    return d.withColumn(out, (F.col("__off") + rn).cast("bigint")).drop("__g", "__p", "__b", "__off")


# --- the first rows of a group ------------------------------------------------------

def _narrowed(rows: DataFrame, open_: DataFrame, digits: int) -> DataFrame:
    """(__g, __quota, __b, __off) of groups whose quota is reached in bucket
    __b, behind __off rows; ``rows`` has what ``open_`` still leaves open."""
    counts = rows.groupBy("__g", F.substring("__h", 1, digits).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(w), F.lit(0))
    found = (counts.join(open_, "__g").withColumn("__off", F.col("__start") + before)
             .filter((F.col("__off") < F.col("__quota")) & (F.col("__quota") <= F.col("__off") + F.col("__n"))))
    return stored(found.select("__g", "__quota", "__b", "__off"), "cut")


def cut_points(df: DataFrame, group: Sequence[str], quotas: DataFrame, order_hash: str, key: str, most: int | None = None,
               target_rows: int = TARGET_ROWS) -> DataFrame:
    """``(__g, __quota, __cut)`` of each row of ``quotas`` (``group`` and
    ``__quota``): the (hash, key) of the group's ``__quota``-th row in that
    order, null where it has fewer or none is wanted. ``most`` is the size of
    the largest group, if known: a group of up to ``target_rows`` is sorted
    as it is, by hash and key alone; others are narrowed down first. The table is
    written, so that joins know its size."""
    g = F.struct(*[F.col(c) for c in group]) if group else F.lit(0)
    rows = df.select(g.alias("__g"), F.col(order_hash).alias("__h"), F.col(key).alias("__k"))
    own = quotas.select(g.alias("__g"), F.col("__quota").cast("bigint").alias("__quota"))
    if most is None:
        most = rows.groupBy("__g").count().agg(F.max("count")).first()[0] or 0
    steps = [d for i, d in enumerate(DIGITS) if most > target_rows * 16 ** ([0, *DIGITS][i])]
    left, open_ = rows, own.filter("__quota >= 1").withColumn("__start", F.lit(0).cast("bigint"))
    if steps:
        left = rows = stored(rows, "cut-rows")
    for digits in steps:
        found = _narrowed(left, open_, digits)
        left = left.join(found.select("__g", "__b"), "__g").filter(F.substring("__h", 1, digits) == F.col("__b")).drop("__b")
        open_ = found.select("__g", "__quota", F.col("__off").alias("__start"))
    place = F.row_number().over(Window.partitionBy("__g").orderBy("__h", "__k"))
    at = (left.join(open_, "__g").withColumn("__r", place).filter(F.col("__r") + F.col("__start") == F.col("__quota"))
          .select("__g", F.struct("__h", "__k").alias("__cut")))
    return stored(own.join(at, "__g", "left"), "cut-points")


def with_cut(df: DataFrame, group: Sequence[str], quotas: DataFrame, order_hash: str, key: str, absent: bool = False,
             most: int | None = None) -> DataFrame:
    """Rows with ``__first`` (among their group's first ``__quota``; a quota
    below 1 takes none) and ``__last`` (the ``__quota``-th). In groups without a
    quota ``__first`` is ``absent``."""
    cuts = cut_points(df, group, quotas, order_hash, key, most)
    g = F.struct(*[F.col(c) for c in group]) if group else F.lit(0)
    place = F.struct(F.col(order_hash).alias("__h"), F.col(key).alias("__k"))
    d = df.withColumn("__g", g).join(cuts, "__g", "left")
    first = (F.col("__quota") >= 1) & (F.col("__cut").isNull() | (place <= F.col("__cut")))
    return (d.withColumn("__first", F.when(F.col("__quota").isNull(), F.lit(absent)).otherwise(first)).withColumn("__last", F.coalesce(place == F.col("__cut"), F.lit(False)))
            .drop("__g", "__cut", "__quota"))
