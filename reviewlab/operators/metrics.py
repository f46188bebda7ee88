"""Evaluation metrics as aggregations (M1-M9).

Every metric is one partially-aggregated pass over the (y_true, y_pred)
pairs: conditional counts per label, then column arithmetic on the tiny
result. Grouped forms (per model, per weight, per fold) add grouping keys
instead of loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab import constants as K


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def label_counts(df: DataFrame, by: Sequence[str] = (), labels=K.LABELS,
                 y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per group: ``tp_l``, ``pred_l``, ``true_l`` for every label, ``n``
    and ``correct``. Rows outside ``labels`` are ignored (JS rule)."""
    t, p = F.col(y_true), F.col(y_pred)
    ok = t.isin(*labels) & p.isin(*labels)
    aggs = []
    for l in labels:
        aggs += [F.count_if(ok & (t == l) & (p == l)).alias(f"tp_{l}"),
                 F.count_if(ok & (p == l)).alias(f"pred_{l}"),
                 F.count_if(ok & (t == l)).alias(f"true_{l}")]
    aggs += [F.count_if(ok).alias("n"), F.count_if(ok & (t == p)).alias("correct")]
    g = df.groupBy(*by) if by else df
    return g.agg(*aggs)


def _per_label(l) -> tuple[Column, Column, Column]:
    prec = _safe_div(F.col(f"tp_{l}"), F.col(f"pred_{l}"))
    rec = _safe_div(F.col(f"tp_{l}"), F.col(f"true_{l}"))
    return prec, rec, _f1(prec, rec)


# M1 ------------------------------------------------------------------------
def confusion(df: DataFrame, labels=K.LABELS, y_true: str = "y_true",
              y_pred: str = "y_pred") -> DataFrame:
    """Fixed ``len(labels)``^2 long table including zero cells."""
    t, p = F.col(y_true), F.col(y_pred)
    cells = df.filter(t.isin(*labels) & p.isin(*labels)).groupBy(
        t.cast("int").alias("y_true"), p.cast("int").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(int(a), int(b)) for a in labels for b in labels], "y_true int, y_pred int")
    return (grid.join(F.broadcast(cells), ["y_true", "y_pred"], "left")
            .select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


# M2 ------------------------------------------------------------------------
def per_class(df: DataFrame, labels=K.LABELS, by: Sequence[str] = (), **kw) -> DataFrame:
    """Precision / recall / F1 (0 when undefined) and support per label."""
    c = label_counts(df, by, labels, **kw)
    rows = []
    for l in labels:
        prec, rec, f1 = _per_label(l)
        rows.append(F.struct(F.lit(l).alias("label"), F.col(f"tp_{l}").alias("tp"),
                             F.col(f"true_{l}").alias("support"), F.col(f"pred_{l}").alias("predicted"),
                             F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
                             F.round(f1, 6).alias("f1")))
    return c.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


# M3 / M4 / M5 --------------------------------------------------------------
def summary(df: DataFrame, by: Sequence[str] = (), labels=K.LABELS, **kw) -> DataFrame:
    """Per group: accuracy, macro P/R/F1 over all labels (``fixed``, the
    report page), macro-F1 over labels present in truth or prediction
    (``present``, the library default), weighted F1, and ``n``. An empty
    overlap gives zeros."""
    c = label_counts(df, by, labels, **kw)
    precs, recs, f1s = zip(*[_per_label(l) for l in labels])
    present = [(F.col(f"true_{l}") + F.col(f"pred_{l}") > 0).cast("int") for l in labels]
    n_present = sum(present[1:], present[0])
    f1_present = sum([f * p for f, p in zip(f1s, present)][1:], f1s[0] * present[0])
    k = float(len(labels))
    weighted = sum([f * F.col(f"true_{l}") for f, l in zip(f1s, labels)][1:],
                   f1s[0] * F.col(f"true_{labels[0]}"))
    return c.select(
        *by,
        F.col("n").cast("bigint").alias("n"),
        F.round(_safe_div(F.col("correct"), F.col("n")), 6).alias("accuracy"),
        F.round(F.when(F.col("n") > 0, sum(precs[1:], precs[0]) / k).otherwise(0.0), 6).alias("macro_precision"),
        F.round(F.when(F.col("n") > 0, sum(recs[1:], recs[0]) / k).otherwise(0.0), 6).alias("macro_recall"),
        F.round(F.when(F.col("n") > 0, sum(f1s[1:], f1s[0]) / k).otherwise(0.0), 6).alias("macro_f1_fixed"),
        F.round(_safe_div(f1_present, n_present), 6).alias("macro_f1_present"),
        F.round(_safe_div(weighted, F.col("n")), 6).alias("weighted_f1"))


# M6 ------------------------------------------------------------------------
def classification_report(df: DataFrame, labels=K.LABELS, digits: int = 4, **kw) -> DataFrame:
    """Rows per label, then ``accuracy``, ``macro avg`` and ``weighted avg``
    (averages over labels present in truth or prediction)."""
    c = label_counts(df, (), labels, **kw)
    rows = []
    present = [(F.col(f"true_{l}") + F.col(f"pred_{l}") > 0) for l in labels]
    stats = [_per_label(l) for l in labels]
    for l, (p, r, f) in zip(labels, stats):
        rows.append((F.lit(str(l)), p, r, f, F.col(f"true_{l}"), present[labels.index(l)]))
    npres = sum([x.cast("int") for x in present][1:], present[0].cast("int"))
    mac = [_safe_div(sum([s[i] * pr.cast("int") for s, pr in zip(stats, present)][1:],
                         stats[0][i] * present[0].cast("int")), npres) for i in range(3)]
    wtd = [_safe_div(sum([s[i] * F.col(f"true_{l}") for s, l in zip(stats, labels)][1:],
                         stats[0][i] * F.col(f"true_{labels[0]}")), F.col("n")) for i in range(3)]
    acc = _safe_div(F.col("correct"), F.col("n"))
    out = [F.struct(F.lit(name).alias("row"), F.round(p, digits).alias("precision"),
                    F.round(r, digits).alias("recall"), F.round(f, digits).alias("f1"),
                    s.cast("bigint").alias("support"), keep.alias("__keep"))
           for name, p, r, f, s, keep in rows]
    out.append(F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                        F.lit(None).cast("double").alias("recall"), F.round(acc, digits).alias("f1"),
                        F.col("n").cast("bigint").alias("support"), F.lit(True).alias("__keep")))
    for name, v in (("macro avg", mac), ("weighted avg", wtd)):
        out.append(F.struct(F.lit(name).alias("row"), *[F.round(x, digits).alias(a) for x, a in
                                                        zip(v, ("precision", "recall", "f1"))],
                            F.col("n").cast("bigint").alias("support"), F.lit(True).alias("__keep")))
    return (c.select(F.explode(F.array(*out)).alias("r")).select("r.*")
            .filter("__keep").drop("__keep"))


# M7 ------------------------------------------------------------------------
def error_examples(df: DataFrame, n: int = 10, key: str = "ID", y_true: str = "y_true",
                   y_pred: str = "y_pred") -> DataFrame:
    """Up to ``n`` misclassified rows per (true, pred) pair, smallest key
    first. ``row_number() <= n`` is planned as a partial WindowGroupLimit,
    so each map task ships at most ``n`` rows per pair to the final sort."""
    e = df.filter(F.col(y_true) != F.col(y_pred))
    w = Window.partitionBy(y_true, y_pred).orderBy(key)
    return e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# M8 ------------------------------------------------------------------------
def leaderboard(preds: DataFrame, truth: DataFrame, key: str = "ID", model: str = "model",
                label: str = "label") -> DataFrame:
    """Models on one truth set, ranked by present-label macro-F1.
    ``preds`` is long: (model, key, label)."""
    j = (preds.select(model, key, F.col(label).alias("y_pred"))
         .join(truth.select(key, F.col(label).alias("y_true")), key))
    s = summary(j, by=[model])
    return s.orderBy(F.col("macro_f1_present").desc(), F.col(model))


# M9 ------------------------------------------------------------------------
def early_stop(history: DataFrame, run: str = "run", epoch: str = "epoch",
               metric: str = "val_f1", patience: int = K.EARLY_STOP_PATIENCE) -> DataFrame:
    """Replays early stopping on a history table: an epoch improves when its
    metric is strictly above the best so far (start -1); training stops at
    the first epoch ``patience`` epochs after the last improvement. Returns
    one row per run with ``best_epoch``, ``best_metric``, ``stop_epoch``
    and ``epochs_run``."""
    w = Window.partitionBy(run).orderBy(epoch)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = (history.withColumn("__rn", F.row_number().over(w))
         .withColumn("__prev", F.coalesce(F.max(metric).over(before), F.lit(-1.0)))
         .withColumn("__imp", F.col(metric) > F.col("__prev"))
         .withColumn("__last", F.max(F.when(F.col("__imp"), F.col("__rn"))).over(upto))
         .withColumn("__stop", (F.col("__rn") - F.coalesce(F.col("__last"), F.lit(0))) >= patience))
    first_stop = h.groupBy(run).agg(F.min(F.when(F.col("__stop"), F.col("__rn"))).alias("__stop_rn"),
                                    F.max("__rn").alias("__last_rn"))
    h = h.join(first_stop, run).filter(F.col("__rn") <= F.coalesce(F.col("__stop_rn"), F.col("__last_rn")))
    return h.groupBy(run).agg(
        F.max_by(F.col(epoch), F.struct(F.col(metric), -F.col("__rn"))).alias("best_epoch"),
        F.max(metric).alias("best_metric"),
        F.max_by(F.col(epoch), F.col("__rn")).alias("stop_epoch"),
        F.count(F.lit(1)).alias("epochs_run"))
