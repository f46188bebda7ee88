"""Projections, filters, casts, dedup and joins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.session import stored


class MissingColumns(ValueError):
    pass


# IO9 -----------------------------------------------------------------------
def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Fail fast (schema only, no job) when required columns are missing."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return df


# P1-P7 ---------------------------------------------------------------------
def drop_unusable(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    return df.dropna(subset=[text, label])


def fill_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def drop_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.length(text) > 0)


def flag_empty(df: DataFrame, text: str = "text", out: str = "is_empty") -> DataFrame:
    return df.withColumn(out, F.length(F.coalesce(F.col(text), F.lit(""))) == 0)


def cast_ids(df: DataFrame, cols=("ID",), lenient: bool = False) -> DataFrame:
    """ANSI cast raises on junk like the original ``astype(int)``;
    ``lenient`` turns junk into null instead."""
    for c in cols:
        df = df.withColumn(c, F.col(c).try_cast("bigint") if lenient else F.col(c).cast("bigint"))
    return df


def label_value(c, blank_as_zero: bool = False) -> Column:
    """Integer label in {0,1,2} or null. With ``blank_as_zero`` a blank
    string counts as 0, like JavaScript's ``Number("")``."""
    raw = F.trim(F.col(c).cast("string")) if isinstance(c, str) else F.trim(c.cast("string"))
    num = raw.try_cast("double")
    if blank_as_zero:
        # a missing field reads as "" in the original (``?? ""``), so null too
        num = F.when(F.coalesce(raw, F.lit("")) == "", F.lit(0.0)).otherwise(num)
    return F.when(num.isin(*[float(x) for x in K.LABELS]), num.cast("int"))


def valid_labels(df: DataFrame, label: str = "label", blank_as_zero: bool = False) -> DataFrame:
    return (df.withColumn(label, label_value(label, blank_as_zero))
            .filter(F.col(label).isNotNull()))


def default_source(c, default: str = K.UNKNOWN_SOURCE) -> Column:
    """Trimmed source, or the default for null/blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def filter_source(df: DataFrame, sources: Iterable[str], src: str = "src") -> DataFrame:
    return df.filter(F.col(src).isin(list(sources)))


def filter_keyword(df: DataFrame, words: Iterable[str], text: str = "text",
                   mode: str = "any") -> DataFrame:
    """Case-insensitive keyword filter. ``any`` / ``all``: some / every
    keyword stands as a whole word; ``contains``: some keyword occurs anywhere."""
    if mode not in ("any", "all", "contains"):
        raise ValueError("mode must be 'any', 'all' or 'contains'")
    edge = "" if mode == "contains" else r"\b"
    conds = [F.col(text).rlike("(?iU)" + edge + _quote(w) + edge) for w in words]
    if not conds:
        return df
    return df.filter(reduce(and_ if mode == "all" else or_, conds))


def _quote(w: str) -> str:
    return r"\Q" + w.replace(r"\E", r"\E\\E\Q") + r"\E"


def errors(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Misclassified rows."""
    return df.filter(F.col(y_true) != F.col(y_pred))


def preview(df: DataFrame, n: int = 10, key: str = "ID") -> DataFrame:
    """First ``n`` rows by key (TakeOrderedAndProject; the limit is
    the feature)."""
    return df.orderBy(key).limit(n)


def source_token(src: Column, normalise: bool = True,
                 null_token: str = K.NULL_SOURCE_TEXT) -> Column:
    """``[SRC_x] `` for a source, or empty string for a blank one."""
    if not normalise:
        # the notebook form: any non-null source, blank included, verbatim
        return F.when(src.isNull(), F.lit("")).otherwise(
            F.concat(F.lit(K.SOURCE_TOKEN_OPEN), src, F.lit("] ")))
    s = F.lower(F.regexp_replace(F.coalesce(src, F.lit(null_token)), r"(?U)^\s+|\s+$", ""))
    s = F.regexp_replace(s, " ", "_")
    return F.when(s == "", F.lit("")).otherwise(
        F.concat(F.lit(K.SOURCE_TOKEN_OPEN), s, F.lit("] ")))


def add_source_token(df: DataFrame, text: str = "text", src: str = "src",
                     normalise: bool = True, null_token: str = K.NULL_SOURCE_TEXT) -> DataFrame:
    """Prefix ``[SRC_<lower(trim(src)) with _ for spaces>] ``;
    blank sources leave the text unchanged; a null source reads ``nan``."""
    return df.withColumn(text, F.concat(source_token(F.col(src), normalise, null_token),
                                        F.col(text)))


# J1 ------------------------------------------------------------------------
def dedup_exact(df: DataFrame, cols=("text", "label"), key: str = "ID") -> DataFrame:
    """Keep the row with the smallest key of every group of exact copies.

    Groups are found by 128-bit fingerprints: numbers of a fixed size, so that
    a hash aggregation counts them, with partial sums where they are read; a
    group that holds a third of all rows is one row a task. Only the copies'
    keys and fingerprints are written, and the rows are freed of those by an
    anti-join, which moves no texts while the copies are few. Where a third
    hash shows that one fingerprint stands for different rows, or where keys are
    null or repeat within a group, whole rows are compared instead.
    """
    told = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    marked = df.withColumn("__a", F.xxhash64(F.lit(1), *told)).withColumn("__b", F.xxhash64(F.lit(2), *told))
    hashed = marked.select(F.col(key).alias("__k"), "__a", "__b", F.hash(*told).alias("__c"))
    groups = stored(hashed.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n"), F.min("__k").alias("__low"), F.min("__c").alias("__c0"), F.max("__c").alias("__c1"))
                    .filter("__n > 1"), "copies")
    found, mixed = groups.agg(F.count(F.lit(1)), F.count_if(F.col("__c0") != F.col("__c1"))).first()
    if not found:
        return df
    copies = stored(hashed.join(groups, ["__a", "__b"]).select("__k", "__a", "__b", (F.col("__k") == F.col("__low")).alias("__first")), "copy-keys")
    firsts, unknown = copies.agg(F.count_if(F.col("__first")), F.count_if(F.col("__first").isNull())).first()
    if mixed or unknown or firsts != found:
        return _dedup_by_rows(df, cols, key)
    gone = copies.filter(~F.col("__first")).select(F.col("__k").alias(key), "__a", "__b")
    return marked.join(gone, [key, "__a", "__b"], "left_anti").select(*df.columns)


def _dedup_by_rows(df: DataFrame, cols, key: str) -> DataFrame:
    others = [c for c in df.columns if c not in cols]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*cols)
            .agg(F.min_by(packed, F.col(key)).alias("__row"))
            .select(*cols, "__row.*")
            .select(*df.columns))


# J2 ------------------------------------------------------------------------
def place_of(df: DataFrame, order: str | None) -> Column:
    """What tells which of two rows came later: ``order``; or ``pos``, the place
    in the files (``io.with_position``); or, without both, the order in which
    the table is read, which only holds for one file read in one piece."""
    return F.col(order) if order else F.col("pos") if "pos" in df.columns else F.monotonically_increasing_id()


def last_by_id(df: DataFrame, key: str = "ID", order: str | None = None) -> DataFrame:
    """The last occurrence (by ``place_of``) of every key wins; a partial
    aggregation, so hot keys are combined map-side."""
    others = [c for c in df.columns if c not in (key,)]
    return (df.withColumn("__at", place_of(df, order)).groupBy(key)
            .agg(F.max_by(F.struct(*[F.col(c) for c in others]), F.col("__at")).alias("__row"))
            .select(key, "__row.*"))


# J3 / J4 -------------------------------------------------------------------
def join_truth(pred: DataFrame, truth: DataFrame, key: str = "ID",
               pred_col: str = "label", true_col: str = "label") -> DataFrame:
    """Inner join of predictions and truth; ids in one side only drop out.
    AQE picks broadcast or sort-merge from runtime sizes."""
    p = pred.select(F.col(key), F.col(pred_col).alias("y_pred"))
    t = truth.select(F.col(key), F.col(true_col).alias("y_true"))
    return t.join(p, key, "inner")


def join_source(pred: DataFrame, reviews: DataFrame, key: str = "ID", src: str = "src",
                default: str = K.UNKNOWN_SOURCE, order: str | None = None) -> DataFrame:
    """Left join predictions to the reviews' source; misses and blank
    sources read ``default``. Of several reviews with one key the last
    wins (``place_of``)."""
    r = reviews.select(F.col(key), default_source(src, default).alias("__src"), place_of(reviews, order).alias("__at"))
    r = r.groupBy(key).agg(F.max_by("__src", "__at").alias("__src"))
    return (pred.join(r, key, "left")
            .withColumn(src, F.coalesce(F.col("__src"), F.lit(default))).drop("__src"))


# J5 / J6 -------------------------------------------------------------------
def align_scores(a: DataFrame, b: DataFrame, key: str = "ID", col: str = "p") -> DataFrame:
    """Full outer join on the key; rows missing on one side or with arrays
    of different length are flagged ``aligned = false``."""
    j = (a.select(key, F.col(col).alias("p_a"))
         .join(b.select(key, F.col(col).alias("p_b")), key, "full_outer"))
    ok = F.col("p_a").isNotNull() & F.col("p_b").isNotNull() & (F.size("p_a") == F.size("p_b"))
    return j.withColumn("aligned", F.coalesce(ok, F.lit(False)))


def assert_aligned(j: DataFrame) -> DataFrame:
    """Eager check used by jobs: raises if any row failed to align."""
    bad = j.filter(~F.col("aligned")).limit(1).count()
    if bad:
        raise ValueError("score tables are not aligned on ID")
    return j


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def apply_overrides(pred: DataFrame, overrides: DataFrame, key: str = "ID",
                    label: str = "label", order: str | None = None) -> DataFrame:
    """P10: manual corrections win over predictions. Overrides are reduced
    to one row per key first (last by ``order`` if given)."""
    o = overrides.select(key, *( [order] if order else []), F.col(label).alias("__ov"))
    o = last_by_id(o, key, order) if order else o.groupBy(key).agg(F.max("__ov").alias("__ov"))
    return (pred.join(o.select(key, "__ov"), key, "left")
            .withColumn(label, F.coalesce(F.col("__ov"), F.col(label))).drop("__ov"))
