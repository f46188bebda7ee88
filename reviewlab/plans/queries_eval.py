"""Registered queries for metrics (M1-M9), ensembles (E1-E5) and Q4-Q6."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.operators import ensemble as E
from reviewlab.operators import frames, metrics as M
from reviewlab.plans import jobs
from reviewlab.plans import oracle as O
from reviewlab.plans.catalog import register
from reviewlab.session import scratch_path
from reviewlab.sources import io
from reviewlab.sources import testviews as V

L = K.LABELS


# ------------------------------------------------------------ SQL builders
def _counts_sql(base, by=""):
    ok = "y_true IN (0, 1, 2) AND y_pred IN (0, 1, 2)"
    cols = []
    for l in L:
        cols += [f"count(*) FILTER (WHERE {ok} AND y_true = {l} AND y_pred = {l}) AS tp_{l}",
                 f"count(*) FILTER (WHERE {ok} AND y_pred = {l}) AS pred_{l}",
                 f"count(*) FILTER (WHERE {ok} AND y_true = {l}) AS true_{l}"]
    cols += [f"count(*) FILTER (WHERE {ok}) AS n", f"count(*) FILTER (WHERE {ok} AND y_true = y_pred) AS correct"]
    g = f" GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"SELECT {sel}{', '.join(cols)} FROM ({base}){g}"


def _div(a, b):
    return f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END)"


def _prf(l):
    p = _div(f"tp_{l}::DOUBLE", f"pred_{l}")
    r = _div(f"tp_{l}::DOUBLE", f"true_{l}")
    f = f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
    return p, r, f


def summary_sql(base, by=""):
    ps, rs, fs = zip(*[_prf(l) for l in L])
    pres = [f"(CASE WHEN true_{l} + pred_{l} > 0 THEN 1 ELSE 0 END)" for l in L]
    npres = " + ".join(pres)
    fpres = " + ".join(f"{f} * {p}" for f, p in zip(fs, pres))
    wtd = " + ".join(f"{f} * true_{l}" for f, l in zip(fs, L))
    sel = f"{by}, " if by else ""
    mac = lambda xs: f"round(CASE WHEN n > 0 THEN ({' + '.join(xs)}) / 3.0 ELSE 0.0 END, 6)"
    return f"""SELECT {sel}CAST(n AS BIGINT) AS n, round({_div('correct::DOUBLE', 'n')}, 6) AS accuracy,
  {mac(ps)} AS macro_precision, {mac(rs)} AS macro_recall, {mac(fs)} AS macro_f1_fixed,
  round({_div(f'({fpres})', f'({npres})')}, 6) AS macro_f1_present,
  round({_div(f'({wtd})', 'n')}, 6) AS weighted_f1
FROM ({_counts_sql(base, by)})"""


def _preds_sql():
    return O.preds_sql()


# M1 / M2 / M3-M5 ------------------------------------------------------------
@register("confusion", lambda: f"""SELECT g.y_true, g.y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT a AS y_true, b AS y_pred FROM (SELECT unnest([0,1,2]) AS a) CROSS JOIN (SELECT unnest([0,1,2]) AS b)) g
LEFT JOIN (SELECT y_true, y_pred, count(*) AS n FROM ({_preds_sql()}) GROUP BY ALL) c
ON g.y_true = c.y_true AND g.y_pred = c.y_pred""")
def confusion(spark, sf):
    return M.confusion(V.preds(spark, sf))


def _per_class_sql():
    parts = []
    for l in L:
        p, r, f = _prf(l)
        parts.append(f"SELECT {l} AS label, tp_{l} AS tp, true_{l} AS support, pred_{l} AS predicted, "
                     f"round({p}, 6) AS precision, round({r}, 6) AS recall, round({f}, 6) AS f1 FROM c")
    return f"WITH c AS ({_counts_sql(_preds_sql())}) " + " UNION ALL ".join(parts)


@register("per_class", _per_class_sql)
def per_class(spark, sf):
    return M.per_class(V.preds(spark, sf))


@register("metrics_summary", lambda: summary_sql(_preds_sql()))
def metrics_summary(spark, sf):
    """M3 (fixed macro), M4 (present macro), M5 accuracy, weighted F1."""
    return M.summary(V.preds(spark, sf))


@register("metrics_two_class", lambda: summary_sql(
    f"SELECT * FROM ({_preds_sql()}) WHERE y_true <> 1 AND y_pred <> 1"))
def metrics_two_class(spark, sf):
    """Class 1 absent from truth and prediction: fixed and present macro-F1
    differ (M3 vs M4)."""
    p = V.preds(spark, sf)
    return M.summary(p.filter((F.col("y_true") != 1) & (F.col("y_pred") != 1)))


@register("metrics_by_source", lambda: summary_sql(f"""SELECT p.*, coalesce(r.src, {O.q(K.UNKNOWN_SOURCE)}) AS src
FROM ({_preds_sql()}) p LEFT JOIN (SELECT ID, max(coalesce(nullif(trim(src), ''), {O.q(K.UNKNOWN_SOURCE)})) AS src
FROM ({O.reviews_sql()}) GROUP BY ID) r ON p.ID = r.ID""", "src"))
def metrics_by_source(spark, sf):
    """Grouped M3-M5 per review source (J4 + grouped conditional counts)."""
    return M.summary(frames.join_source(V.preds(spark, sf), V.reviews(spark, sf)), by=["src"])


def _evaluate_sql():
    truth = f"SELECT ID, label AS y_true FROM ({O.reviews_sql()}) WHERE label IS NOT NULL"
    pred = f"SELECT ID, y_pred FROM ({_preds_sql()})"
    return summary_sql(f"SELECT t.ID, t.y_true, p.y_pred FROM ({truth}) t JOIN ({pred}) p ON t.ID = p.ID")


@register("evaluate", _evaluate_sql)
def evaluate(spark, sf):
    """Q4: predictions and truth as CSV files (IO3), in which every ID stands
    twice, first with another label; the last one counts (J2), then J3, M3-M5."""
    def uploaded(rows, name):
        path = scratch_path(spark, name)
        twice = rows.select("ID", ((F.col("label") + 1) % 3).alias("label"), F.lit(0).alias("at")).unionByName(rows.withColumn("at", F.lit(1)))
        (twice.repartition(1).sortWithinPartitions("at", "ID").select(F.col("ID").alias(" id "), F.col("label").alias("'Label'"))
         .write.option("header", True).csv(path))
        return io.read_labels(spark, path, position=True)

    truth = uploaded(frames.valid_labels(V.reviews(spark, sf).select("ID", "label")), "truth")
    pred = uploaded(V.preds(spark, sf).select("ID", F.col("y_pred").alias("label")), "upload")
    return jobs.evaluate(pred, truth)


def _report_sql():
    rows = []
    pres = lambda l: f"true_{l} + pred_{l} > 0"
    stats = [_prf(l) for l in L]
    for l, (p, r, f) in zip(L, stats):
        rows.append(f"SELECT '{l}' AS row, round({p}, 4) AS precision, round({r}, 4) AS recall, "
                    f"round({f}, 4) AS f1, CAST(true_{l} AS BIGINT) AS support FROM c WHERE {pres(l)}")
    rows.append("SELECT 'accuracy', NULL::DOUBLE, NULL::DOUBLE, round(" + _div("correct::DOUBLE", "n")
                + ", 4), CAST(n AS BIGINT) FROM c")
    npres = " + ".join(f"(CASE WHEN {pres(l)} THEN 1 ELSE 0 END)" for l in L)
    mac = [_div("(" + " + ".join(f"{s[i]} * (CASE WHEN {pres(l)} THEN 1 ELSE 0 END)" for s, l in zip(stats, L)) + ")",
                f"({npres})") for i in range(3)]
    wtd = [_div("(" + " + ".join(f"{s[i]} * true_{l}" for s, l in zip(stats, L)) + ")", "n") for i in range(3)]
    for name, v in (("macro avg", mac), ("weighted avg", wtd)):
        rows.append(f"SELECT '{name}', round({v[0]}, 4), round({v[1]}, 4), round({v[2]}, 4), CAST(n AS BIGINT) FROM c")
    return f"WITH c AS ({_counts_sql(_preds_sql())}) " + " UNION ALL ".join(rows)


@register("classification_report", _report_sql)
def classification_report(spark, sf):
    return M.classification_report(V.preds(spark, sf))


@register("error_examples", lambda: f"""SELECT ID, y_true, y_pred, row_number() OVER (PARTITION BY y_true, y_pred ORDER BY ID) AS rank
FROM ({_preds_sql()}) WHERE y_true <> y_pred QUALIFY rank <= 10""")
def error_examples(spark, sf):
    """M7: up to 10 examples per (true, pred) error pair."""
    return M.error_examples(V.preds(spark, sf), 10).withColumn("rank", F.col("rank").cast("bigint"))


# E1 - E5 ---------------------------------------------------------------------
MODEL_B = (53, 89)
W_A, W_B = 0.35, 0.65


def _ens_sql():
    a, b = O.score_probs_sql(), O.score_probs_sql(*MODEL_B)
    return f"""SELECT coalesce(a.ID, b.ID) AS ID, CASE WHEN a.p IS NOT NULL AND b.p IS NOT NULL AND len(a.p) = len(b.p)
  THEN list_transform(generate_series(1, len(a.p)), lambda i: {W_A} * a.p[i] + {W_B} * b.p[i]) END AS p
FROM ({a}) a FULL OUTER JOIN ({b}) b ON a.ID = b.ID"""


def _argmax_sql(p):
    return f"CAST(list_position({p}, list_max({p})) - 1 AS INTEGER)"


@register("ensemble_argmax", lambda: f"""SELECT ID, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2,
  {_argmax_sql('p')} AS label FROM ({_ens_sql()})""")
def ensemble_argmax(spark, sf):
    """J5 + E1 + E2: 0.35 / 0.65 mix of two score tables, then argmax."""
    e = E.ensemble(V.score_probs(spark, sf), V.score_probs(spark, sf, *MODEL_B), W_A, W_B, strict=False)  # null rows, as its SQL
    return e.select("ID", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)],
                    E.argmax_label("p").alias("label"))


@register("softmax", lambda: f"""SELECT ID, round(e0 / (e0 + e1 + e2), 6) AS s0, round(e1 / (e0 + e1 + e2), 6) AS s1,
  round(e2 / (e0 + e1 + e2), 6) AS s2 FROM (SELECT ID, exp(r0 / 10 - m) AS e0, exp(r1 / 10 - m) AS e1, exp(r2 / 10 - m) AS e2
  FROM (SELECT *, greatest(r0, r1, r2) / 10 AS m FROM ({O.scores_sql()})))""")
def softmax(spark, sf):
    """E3 on scores read as logits (divided by 10)."""
    s = V.scores(spark, sf)
    sm = E.softmax(F.array(*[F.col(f"r{k}") / 10 for k in range(3)]))
    return s.select("ID", *[F.round(sm[i], 6).alias(f"s{i}") for i in range(3)])


@register("one_hot", lambda: f"""SELECT ID, CAST(y_pred = 0 AS DOUBLE) AS o0, CAST(y_pred = 1 AS DOUBLE) AS o1,
  CAST(y_pred = 2 AS DOUBLE) AS o2 FROM ({_preds_sql()})""")
def one_hot(spark, sf):
    oh = E.one_hot("y_pred", 3)
    return V.preds(spark, sf).select("ID", *[oh[i].alias(f"o{i}") for i in range(3)])


def _search_sql():
    a, b = O.score_probs_sql(), O.score_probs_sql(*MODEL_B)
    truth = f"SELECT ID, label AS y_true FROM ({O.reviews_sql()}) WHERE label IS NOT NULL"
    j = f"""SELECT a.ID, a.p AS pa, b.p AS pb, t.y_true FROM ({a}) a JOIN ({b}) b ON a.ID = b.ID AND len(a.p) = len(b.p)
JOIN ({truth}) t ON a.ID = t.ID"""
    folds = f"SELECT *, CAST((row_number() OVER (PARTITION BY y_true ORDER BY md5('{K.SEED}|' || CAST(ID AS VARCHAR)), ID) - 1) % {K.ENSEMBLE_FOLDS} AS INTEGER) AS fold FROM ({j})"
    steps = int(round(1 / K.ENSEMBLE_WEIGHT_STEP))
    x = f"""SELECT *, {_argmax_sql("list_transform(generate_series(1, len(pa)), lambda i: weight * pa[i] + (1 - weight) * pb[i])")} AS y_pred
FROM (SELECT *, CAST(i AS DOUBLE) / {float(steps)} AS weight FROM ({folds}), (SELECT unnest(generate_series(0, {steps})) AS i))"""
    per = summary_sql(x, "weight, fold")
    return f"""WITH cv AS (SELECT weight, round(avg(macro_f1_present), 6) AS cv_f1_macro FROM ({per}) GROUP BY weight)
SELECT weight, cv_f1_macro, weight = (SELECT weight FROM cv ORDER BY cv_f1_macro DESC, weight LIMIT 1) AS is_best FROM cv"""


@register("search_weights", _search_sql)
def search_weights(spark, sf):
    """E5: 0.05 weight grid x 5 stratified folds, mean macro-F1 per weight."""
    truth = frames.valid_labels(V.reviews(spark, sf).select("ID", "label"))
    return E.search_weights(V.score_probs(spark, sf), V.score_probs(spark, sf, *MODEL_B), truth)


# M8 / M9 ---------------------------------------------------------------------
def _models_sql():
    a, b = O.score_probs_sql(), O.score_probs_sql(*MODEL_B)
    return f"""SELECT 'rule' AS model, ID, y_pred AS label FROM ({_preds_sql()})
UNION ALL SELECT 'scores_a', ID, {_argmax_sql('p')} FROM ({a})
UNION ALL SELECT 'scores_b', ID, {_argmax_sql('p')} FROM ({b})
UNION ALL SELECT 'ensemble', ID, {_argmax_sql('p')} FROM ({_ens_sql()})"""


@register("leaderboard", lambda: summary_sql(f"""SELECT m.model, m.ID, m.label AS y_pred, t.label AS y_true
FROM ({_models_sql()}) m JOIN (SELECT ID, label FROM ({O.reviews_sql()}) WHERE label IS NOT NULL) t ON m.ID = t.ID""", "model"))
def leaderboard(spark, sf):
    """M8: four models on one truth set, ranked by present macro-F1."""
    pa, pb = V.score_probs(spark, sf), V.score_probs(spark, sf, *MODEL_B)
    long = (V.preds(spark, sf).select(F.lit("rule").alias("model"), "ID", F.col("y_pred").alias("label"))
            .unionByName(pa.select(F.lit("scores_a").alias("model"), "ID", E.argmax_label("p").alias("label")))
            .unionByName(pb.select(F.lit("scores_b").alias("model"), "ID", E.argmax_label("p").alias("label")))
            .unionByName(E.ensemble(pa, pb, W_A, W_B, strict=False).select(
                F.lit("ensemble").alias("model"), "ID", E.argmax_label("p").alias("label"))))
    truth = frames.valid_labels(V.reviews(spark, sf).select("ID", "label"))
    return M.leaderboard(long, truth)


def _history_sql():
    src = f"""SELECT ID, max(coalesce(nullif(trim(src), ''), {O.q(K.UNKNOWN_SOURCE)})) AS src FROM ({O.reviews_sql()}) GROUP BY ID"""
    base = f"""SELECT coalesce(r.src, {O.q(K.UNKNOWN_SOURCE)}) AS run, CAST(p.ID % 8 + 1 AS INTEGER) AS epoch, p.y_true, p.y_pred
FROM ({_preds_sql()}) p LEFT JOIN ({src}) r ON p.ID = r.ID"""
    return f"SELECT run, epoch, round(macro_f1_present, 4) AS val_f1 FROM ({summary_sql(base, 'run, epoch')})"


def _history(spark, sf):
    j = frames.join_source(V.preds(spark, sf), V.reviews(spark, sf)).withColumnRenamed("src", "run")
    j = j.withColumn("epoch", (F.col("ID") % 8 + 1).cast("int"))
    return M.summary(j, by=["run", "epoch"]).select(
        "run", "epoch", F.round("macro_f1_present", 4).alias("val_f1"))


def _early_stop_sql():
    p = K.EARLY_STOP_PATIENCE
    return f"""WITH h AS ({_history_sql()}),
a AS (SELECT *, row_number() OVER w AS rn,
  coalesce(max(val_f1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS prev
  FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch)),
b AS (SELECT *, max(CASE WHEN val_f1 > prev THEN rn END) OVER (PARTITION BY run ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM a),
c AS (SELECT *, rn - coalesce(last_imp, 0) >= {p} AS stop FROM b),
s AS (SELECT run, coalesce(min(CASE WHEN stop THEN rn END), max(rn)) AS stop_rn FROM c GROUP BY run),
k AS (SELECT c.* FROM c JOIN s ON c.run = s.run WHERE c.rn <= s.stop_rn)
SELECT run, arg_max(epoch, val_f1 * 1000000 - rn) AS best_epoch, max(val_f1) AS best_metric,
  arg_max(epoch, rn) AS stop_epoch, count(*) AS epochs_run FROM k GROUP BY run"""


@register("early_stop", _early_stop_sql)
def early_stop(spark, sf):
    """M9 over a per-source history table derived from the predictions
    (epoch = ID % 8 + 1, val_f1 = present macro-F1 of that slice)."""
    return M.early_stop(_history(spark, sf), "run", "epoch", "val_f1")


@register("error_texts", lambda: f"""SELECT e.y_true, e.y_pred, e.ID, e.rank, r.text FROM (SELECT *, CAST(row_number() OVER (PARTITION BY y_true, y_pred ORDER BY ID) AS INTEGER) AS rank
FROM ({_preds_sql()}) WHERE y_true <> y_pred) e JOIN ({O.reviews_sql()}) r ON e.ID = r.ID WHERE e.rank <= 10""")
def error_texts(spark, sf):
    """M7 with texts: up to 10 wrongly classified reviews of each pair."""
    found = M.error_examples(V.preds(spark, sf))
    return found.join(V.reviews(spark, sf).select("ID", "text"), "ID").select("y_true", "y_pred", "ID", "rank", "text")
