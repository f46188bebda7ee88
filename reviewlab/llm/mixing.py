"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.llm.common import WORD_PATTERN, documents, stored

#: Parts into which a source's order is cut to find where its sample ends.
PARTS = 4096
#: Tables of one row a source are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size, weight).

    The total of all sizes is shared by weight; a target above ``max_epochs``
    times its source is held there and what is over is shared again among the
    rest. One row a source; the driver sees sums alone.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    table = stored(sizes.withColumn("held", F.lit(False)), "targets")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        held, weights = table.agg(
            F.coalesce(F.sum(F.when(F.col("held"), cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~F.col("held"), F.col("weight"))), F.lit(0)).cast("double")).first()
        share = F.col("weight") * F.lit((total - held) / weights if weights else 0.0)
        shared = table.withColumn("target", F.when(F.col("held"), cap).otherwise(share))
        over = ~F.col("held") & (share > cap)
        if not weights or shared.filter(over).isEmpty():
            return shared.select("source", "source_size", "target")
        table = stored(table.withColumn("held", F.col("held") | over), "targets")


def _per_word(keys: DataFrame, per_source: DataFrame) -> DataFrame:
    """(_ws, _per_word): for each source the probability of a copy for each
    word of a document. With the sizes from the largest down, those whose
    probability would exceed 1 are certain, and the rest share what is left of
    the words. Works on the counts of each size; a source whose documents are
    all certain has no row."""
    sizes = keys.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = sizes.join(per_source.select("_source", "_words"), F.col("source").eqNullSafe(F.col("_source"))).filter("_words > 0")
    words, squares = F.col("n") * F.col("size"), (F.col("n") * F.col("size")).cast("double") * F.col("size")
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(squares).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rate = sizes.withColumn("_per_word", (F.col("_words") - larger) / rest)
    fits = rate.filter((F.col("_per_word") > 0) & (F.col("_per_word") * F.col("size") <= 1))
    return fits.groupBy(F.col("source").alias("_ws")).agg(F.max_by("_per_word", "size").alias("_per_word"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17,
        out_prefix: str = "") -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (long: copies
    * size), each name after ``out_prefix``.

    Size: words of the text. Sources in code-point order, null last, have
    ``weights`` in turn. Within a source each document is due
    target / source_size copies: the whole part is certain. One more copy goes
    to documents with probability p, in proportion to their size, such that the
    expected words are those still missing; where that would exceed 1 the copy
    is certain too. The documents are ranked by u / (1 - u) divided by
    p / (1 - p), with u in (0, 1) from a keyed hash of the row, and taken in
    that order until the source's words are reached. The row that would go beyond gives its place
    to the row not taken yet whose size comes nearest to what is left, if one
    helps. The order is cut into ``PARTS``, summed for each part, and only
    the part in which a sample ends is sorted, so no source is in one task.

    Null or empty texts have size 0 and come last in the order (taken 0). A source without words has target 0. Equal rows tie by doc_id and
    text, and full copies are interchangeable. Other columns stay; those
    named like a result are replaced. An empty table gives an empty result.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*[out_prefix + m for m in made])
    # the caller's columns stand in one, so that no name of this computation meets theirs
    sized = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_input")).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long"))
    row_hash = F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.coalesce("text", F.lit(""))))
    # the order needs a row's hash and size only; texts are read again at the end
    keys = stored(sized.select("source", "size", row_hash.alias("_h")), "mix-sizes")
    by_source = keys.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))).cast("int") + 1)
    targets = source_targets(by_source.withColumn("weight", weight), max_epochs)

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per_source = stored(targets.withColumn("_whole", F.floor(rate)).withColumn("_rest", rate - F.floor(rate))
                        .withColumn("_words", F.col("target") - F.col("_whole") * F.col("source_size"))
                        .withColumnRenamed("source", "_source"), "mix-targets")
    per_source = stored(per_source.join(_per_word(keys, per_source), F.col("_source").eqNullSafe(F.col("_ws")), "left")
                        .drop("_ws").withColumn("_per_word", F.coalesce("_per_word", F.lit(1.0))), "mix-targets")

    few = per_source.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda table: table)

    def ranked(df: DataFrame) -> DataFrame:
        joined = df.join(small(per_source), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        u = (F.shiftrightunsigned("_h", 12) + F.lit(0.5)) / F.lit(2.0**52)
        p = F.least(F.lit(1.0), F.col("_per_word") * F.col("size"))
        odds = (u / (1 - u)) * ((1 - p) / p)
        q = F.when(p > 0, odds / (1 + odds)).otherwise(F.lit(1.0))
        return joined.withColumn("_q", q).withColumn("_part", F.least(F.floor(q * PARTS), F.lit(PARTS - 1)).cast("int"))

    order = ranked(keys)
    parts = order.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = (parts.withColumn("_before", F.coalesce(before, F.lit(0)))
            .join(per_source.select("_source", "_words"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .filter("_before < _words AND _before + _sum >= _words")
            .select(F.col("source").alias("_s"), F.col("_part").alias("_end"), "_before", "_words"))
    # the part in which the sample ends, in order; equal rows are one step
    last = (order.drop("_words").join(ends, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_end")))
            .groupBy("source", "_before", "_words", "_q", "_h").agg(F.sum("size").alias("_step"), F.max("size").alias("_one")))
    upto = F.col("_before") + F.sum("_step").over(Window.partitionBy("source").orderBy("_q", "_h"))
    whole_rows = F.floor((F.col("_words") - (F.col("_upto") - F.col("_step"))) / F.col("_one"))
    left = F.col("_words") - (F.col("_upto") - F.col("_step")) - whole_rows * F.col("_one")
    ending = stored(last.filter("_one > 0").withColumn("_upto", upto).filter("_upto >= _words")
                    .select("source", F.struct("_q", "_h", whole_rows.cast("long").alias("_n"), left.alias("_left")).alias("_e"))
                    .groupBy("source").agg(F.min("_e").alias("_e"))
                    .select(F.col("source").alias("_es"), F.col("_e._q").alias("_eq"), F.col("_e._h").alias("_eh"), "_e._n", "_e._left"), "mix-ends")
    beyond = (F.col("_q") > F.col("_eq")) | ((F.col("_q") == F.col("_eq")) & (F.col("_h") >= F.col("_eh")))
    miss = F.abs(F.col("size") - F.col("_left"))
    picks = (order.join(ending, F.col("source").eqNullSafe(F.col("_es"))).filter(beyond & (miss < F.col("_left")))
             .groupBy("_es").agg(F.min(F.struct(miss.alias("_miss"), "_q", "_h")).alias("_pick"))
             .select(F.col("_es").alias("_ps"), F.col("_pick._q").alias("_pq"), F.col("_pick._h").alias("_ph")))
    marks = ending.join(picks, F.col("_es").eqNullSafe(F.col("_ps")), "left").drop("_ps")

    full = ranked(sized.withColumn("_h", row_hash)).join(small(marks), F.col("source").eqNullSafe(F.col("_es")), "left")
    inside = F.coalesce((F.col("_q") < F.col("_eq")) | ((F.col("_q") == F.col("_eq")) & (F.col("_h") < F.col("_eh"))), (F.col("_rest") > 0) & (F.col("size") > 0))
    is_end, is_pick = (F.coalesce((F.col("_q") == F.col(f"_{x}q")) & (F.col("_h") == F.col(f"_{x}h")), F.lit(False)) for x in "ep")
    # equal rows share their place: only so many of them, the first by doc_id and text, are taken
    nth = F.row_number().over(Window.partitionBy("source", "_h").orderBy("doc_id", "text"))
    marked = F.when(is_end, F.col("_n")).otherwise(0) + F.when(is_pick, 1).otherwise(0)
    rest, ends_at = full.filter(~(is_end | is_pick)), full.filter(is_end | is_pick)
    out = rest.withColumn("copies", F.col("_whole") + F.when(inside, 1).otherwise(0)).unionByName(
        ends_at.withColumn("_nth", nth).withColumn("copies", F.col("_whole") + F.when(F.col("_nth") <= marked, 1).otherwise(0)).drop("_nth"))
    out = out.withColumn("copies", F.col("copies").cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("_input.*", *[F.col(m).alias(out_prefix + m) for m in made])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
