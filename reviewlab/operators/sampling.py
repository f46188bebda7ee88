"""Seeded sampling, caps, splits, folds and augmentation.

Randomness is a pure function of ``(seed, key)`` through ``md5``, so every
result is stable under repartitioning and task retries and can be checked
against SQL. Caps, samples and splits compare each row with its group's cut
(``ranking.cut_points``); ranks, where a result shows them, come from
``ranking.rank_within``, which splits hot groups into hash buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.functions.arrays import let
from reviewlab.operators.ranking import rank_within, seeded_hash, unit_float, with_cut
from reviewlab.session import stored


def _with_hash(df: DataFrame, seed, key: str, salt: str = "") -> DataFrame:
    return df.withColumn("__h", seeded_hash(f"{seed}{salt}", key))


# S1 ------------------------------------------------------------------------
def cap_per_group(df: DataFrame, group: str, n: int, seed=K.SEED, key: str = "ID",
                  keep_null: bool = False) -> DataFrame:
    """At most ``n`` rows per group value, chosen by seeded hash. Null
    groups are dropped like a pandas ``groupby`` unless ``keep_null``."""
    if not keep_null:
        df = df.filter(F.col(group).isNotNull())
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    most = counts.agg(F.max("__n")).first()[0] or 0
    if most <= n:
        return df
    quotas = counts.filter(F.col("__n") > n).select(group, F.lit(n).alias("__quota"))
    return _first(with_cut(_with_hash(df, seed, key), [group], quotas, "__h", key, absent=True, most=most))


def _first(df: DataFrame) -> DataFrame:
    return df.filter("__first").drop("__h", "__first", "__last")


# S2 ------------------------------------------------------------------------
def stratified_quota(counts: DataFrame, label: str, max_total: int) -> DataFrame:
    """``min(cnt, max(1, floor(max_total * cnt / total)))`` per label."""
    tot = counts.agg(F.sum("__cnt")).scalar()
    q = F.least(F.col("__cnt"), F.greatest(F.lit(1), F.floor(F.col("__cnt") * max_total / tot)))
    return counts.withColumn("__quota", F.when(tot > max_total, q).otherwise(F.col("__cnt")))


def cap_total_stratified(df: DataFrame, label: str, max_total: int | None, seed=K.SEED,
                         key: str = "ID") -> DataFrame:
    if max_total is None:
        return df
    counts = stored(df.groupBy(label).agg(F.count(F.lit(1)).alias("__cnt")), "label-counts")
    quotas = stratified_quota(counts, label, max_total).select(label, "__quota")
    return _first(with_cut(_with_hash(df, seed, key), [label], quotas, "__h", key))


# S3 ------------------------------------------------------------------------
def split_quotas(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """Per-label test counts of a stratified split: ``n_test =
    ceil(test_size * N)``; train counts are floor(n_train * share) plus one
    for the largest remainders (ties to the smaller label); test = rest.
    The window runs over the per-label count table only."""
    counts = stored(df.groupBy(label).agg(F.count(F.lit(1)).alias("__cnt")), "label-counts")
    n = counts.agg(F.sum("__cnt")).scalar()
    n_train = n - F.ceil(n * F.lit(test_size))
    exact = F.col("__cnt") * n_train / n
    c = counts.withColumn("__fl", F.floor(exact)).withColumn("__fr", exact - F.floor(exact))
    short = n_train - c.agg(F.sum("__fl")).scalar()
    w = Window.orderBy(F.col("__fr").desc(), F.col(label))
    c = c.withColumn("__train", F.col("__fl") + F.when(F.row_number().over(w) <= short, 1).otherwise(0))
    return c.select(label, "__cnt", (F.col("__cnt") - F.col("__train")).alias("__test"))


def stratified_split(df: DataFrame, label: str = "label", test_size: float = K.VAL_SIZE,
                     seed=K.SEED, key: str = "ID", out: str = "split", rank: bool = True) -> DataFrame:
    """Adds ``out`` in {train, val}: the first ``test`` rows of each label by
    seeded hash go to val. ``rank`` adds each row's 1-based place within its
    label and part, which takes a ranking of all rows; without it rows are
    only compared with their label's cut."""
    quotas = split_quotas(df, label, test_size).select(label, F.col("__test").alias("__quota"))
    if not rank:
        d = with_cut(_with_hash(df, seed, key), [label], quotas, "__h", key)
        return d.withColumn(out, F.when(F.col("__first"), "val").otherwise("train")).drop("__h", "__first", "__last")
    d = df.join(F.broadcast(quotas.withColumnRenamed("__quota", "__test")), label)  # one row per class
    d = rank_within(_with_hash(d, seed, key), [label], "__h", key, "__r")
    return (d.withColumn(out, F.when(F.col("__r") <= F.col("__test"), "val").otherwise("train"))
            .withColumn("rank", F.col("__r") - F.when(F.col(out) == "train", F.col("__test")).otherwise(0))
            .drop("__h", "__r", "__test"))


# S4 / S5 / S6 / S7 ---------------------------------------------------------
def hash_threshold(fraction: float) -> str:
    """Hex prefix bound: ``substr(md5, 1, 8) < bound`` keeps ``fraction``."""
    return format(min(int(round(fraction * 2 ** 32)), 2 ** 32 - 1), "08x")


def sample_fraction(df: DataFrame, fraction: float, seed=K.SEED, key: str = "ID") -> DataFrame:
    """Bernoulli sample by hash prefix: narrow, no shuffle."""
    return df.filter(F.substring(seeded_hash(seed, key), 1, 8) < F.lit(hash_threshold(fraction)))


def sample_n(df: DataFrame, n: int, seed=K.SEED, key: str = "ID") -> DataFrame:
    """Exactly ``min(n, count)`` rows with the smallest seeded hash."""
    quotas = df.sparkSession.range(1).select(F.lit(n).alias("__quota"))
    return _first(with_cut(_with_hash(df, seed, key), [], quotas, "__h", key))


def shuffle_rows(df: DataFrame, seed=K.SEED, key: str = "ID", out: str = "ord") -> DataFrame:
    """Seeded permutation: ``out`` is the 1-based position."""
    d = rank_within(_with_hash(df, seed, key), [], "__h", key, out)
    return d.drop("__h")


def assign_folds(df: DataFrame, k: int = K.ENSEMBLE_FOLDS, stratify: str | None = "label",
                 seed=K.SEED, key: str = "ID", out: str = "fold") -> DataFrame:
    """``fold = (rank - 1) % k`` with rank per stratum by seeded hash, so
    every fold gets an equal share of each class."""
    d = rank_within(_with_hash(df, seed, key), [stratify] if stratify else [], "__h", key, "__r")
    return d.withColumn(out, ((F.col("__r") - 1) % k).cast("int")).drop("__h", "__r")


# A1 - A3 ---------------------------------------------------------------------
def _u(seed, key: Column, copy: Column, tag: str, i: Column | None = None) -> Column:
    parts = [F.lit(f"{seed}|"), key.cast("string"), F.lit("|"), copy.cast("string"), F.lit(f"|{tag}")]
    if i is not None:
        parts += [F.lit("|"), i.cast("string")]
    return unit_float(F.concat(*parts))


def drop_words(words: Column, key: Column, copy: Column, p: float = K.WORD_DROP_P,
               seed=K.SEED) -> Column:
    """A1: drop each word with probability ``p`` when there are more than
    three; keep the original if every word was dropped."""
    kept = F.filter(words, lambda w, i: _u(seed, key, copy, "d", i) > p)
    return (F.when(F.size(words) < K.MIN_WORDS_FOR_AUG, words)
            .when(F.size(kept) == 0, words).otherwise(kept))


def swap_words(words: Column, key: Column, copy: Column, prob: float = K.WORD_SWAP_P,
               seed=K.SEED) -> Column:
    """A2: with probability ``prob`` and more than three words, swap two
    distinct positions drawn from the words that are left."""
    def body(ws):
        n = F.size(ws)
        i = F.floor(_u(seed, key, copy, "i") * n).cast("int")
        j0 = F.floor(_u(seed, key, copy, "j") * (n - 1)).cast("int")
        j = F.when(j0 >= i, j0 + 1).otherwise(j0)
        # bind the positions too, so the lambda below reads plain values
        return let(F.struct(i.alias("i"), j.alias("j")), lambda p: F.when(
            (n >= K.MIN_WORDS_FOR_AUG) & (_u(seed, key, copy, "s") <= prob),
            F.transform(ws, lambda w, k: F.when(k == p["i"], F.element_at(ws, p["j"] + 1))
                        .when(k == p["j"], F.element_at(ws, p["i"] + 1)).otherwise(w))
        ).otherwise(ws))

    return let(words, body)


def augment_text(text: Column, key: Column, copy: Column, seed=K.SEED) -> Column:
    """A3: whitespace words -> A1 -> A2 -> joined by one space."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(swap_words(drop_words(words, key, copy, seed=seed), key, copy, seed=seed), " ")


# A4 ------------------------------------------------------------------------
def balance_by_augmentation(train: DataFrame, label: str = "label", text: str = "text",
                            key: str = "ID", max_per_row: int = K.MAX_AUG_PER_SAMPLE, seed=K.SEED) -> DataFrame:
    """A4: for every class below the largest, add augmented copies of its rows
    in the order of the seeded hash until the deficit is met or rows run out.
    A row gets deficit div rows copies, at least one and at most
    ``max_per_row``; the last row that is reached gets what is still
    missing. Returns only the new rows, with ``aug`` = copy number."""
    counts = stored(train.groupBy(label).agg(F.count(F.lit(1)).alias("__cnt")), "label-counts")
    top = counts.agg(F.max("__cnt")).scalar()
    missing = counts.withColumn("__def", top - F.col("__cnt")).filter(F.col("__def") > 0)
    per_row = F.least(F.lit(max_per_row), F.greatest(F.lit(1), F.floor(F.col("__def") / F.col("__cnt")))).cast("int")
    plan = missing.withColumn("__per", per_row).withColumn("__quota", F.ceil(F.col("__def") / F.col("__per")))
    plan = stored(plan.select(label, "__def", "__per", "__quota"), "augmentation")
    d = with_cut(_with_hash(train, seed, key), [label], plan.select(label, "__quota"), "__h", key).filter("__first")
    d = d.join(F.broadcast(plan), label)  # one row per class
    copies = F.when(F.col("__last"), F.col("__def") - (F.col("__quota") - 1) * F.col("__per")).otherwise(F.col("__per"))
    d = d.withColumn("aug", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    return (d.withColumn(text, augment_text(F.col(text), F.col(key), F.col("aug"), seed))
            .drop("__h", "__first", "__last", "__def", "__per", "__quota"))
