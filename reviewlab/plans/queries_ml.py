"""Registered queries for I/O round trips, MLlib models (C1-C7), the
scoring jobs (Q3, Q5, Q7) and the streaming re-aims (ST1, ST2)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.operators import baselines, frames, metrics as M, models as ML
from reviewlab.operators import profile as G
from reviewlab.plans import jobs
from reviewlab.plans import oracle as O
from reviewlab.plans.catalog import register
from reviewlab.plans.queries_eval import _history, _history_sql
from reviewlab.plans.queries_sampling import _training_sql
from reviewlab.plans.queries_text import _prepare_inference_sql
from reviewlab.session import cut_lineage, scratch_path
from reviewlab.sources import io
from reviewlab.sources import testviews as V
from reviewlab.streaming import stream


# IO1 / IO5 -------------------------------------------------------------------
@register("io_csv_roundtrip", lambda: f"SELECT ID, text, label, src FROM ({O.reviews_sql()})")
def io_csv_roundtrip(spark, sf):
    """IO5 then IO1: reviews written as CSV (texts with commas, quotes and
    newlines; blank sources) and read back with an explicit schema."""
    path = scratch_path(spark, "reviews-csv")
    io.write_reviews(V.reviews(spark, sf).select("ID", "text", "label", "src"), path, "csv")
    return io.read_reviews(spark, path, labelled=True, with_id=True).select("ID", "text", "label", "src")


# IO3 / IO6 -------------------------------------------------------------------
@register("io_labels_roundtrip", lambda: f"SELECT CAST(ID AS VARCHAR) AS ID, y_pred AS label FROM ({O.preds_sql()})")
def io_labels_roundtrip(spark, sf):
    """IO6 writes ``ID,label``; IO3 reads it back (``evaluate`` does so
    through a messy header)."""
    path = scratch_path(spark, "labels-csv")
    io.write_submission(V.preds(spark, sf).select("ID", F.col("y_pred").alias("label")), path)
    return io.read_labels(spark, path)


# IO8 -------------------------------------------------------------------------
@register("history_roundtrip", lambda: _history_sql())
def history_roundtrip(spark, sf):
    """IO8: a training history written as CSV and read back by column name."""
    path = scratch_path(spark, "history-csv")
    io.write_history(_history(spark, sf).select("val_f1", "epoch", "run"), path)
    return io.read_history(spark, path).select("run", "epoch", "val_f1")


# C1 / C6 / Q7 ------------------------------------------------------------------
def _train_val(spark, sf):
    out = cut_lineage(jobs.prepare_training(V.reviews(spark, sf)))
    return (out.filter(F.col("split") == "train").select("ID", "text", "label"),
            out.filter(F.col("split") == "val").select("ID", "text", "label"))


@register("train_logreg")
def train_logreg(spark, sf):
    """Q7 / C1 + C6: char 3-5-gram TF-IDF + multinomial logistic regression
    fitted on the prepared train split; val predictions with truth."""
    train, val = _train_val(spark, sf)
    p = ML.LogRegParams(C=10.0, max_iter=1000)
    m = ML.train_logreg(train, p)
    pred = ML.predict(val, m, p.features)
    return pred.join(val.select("ID", F.col("label").alias("y_true")), "ID").select(
        "ID", "y_true", F.col("label").alias("y_pred"))


@register("train_svm")
def train_svm(spark, sf):
    """One-against-the-rest linear SVM (squared hinge, raw counts of 3-4
    characters) on a 40 % sample of train (S4)."""
    from reviewlab.operators.sampling import sample_fraction
    train, val = _train_val(spark, sf)
    m = ML.train_svm(sample_fraction(train, K.SVC_SAMPLE_FRACTION))
    return ML.predict(val, m, baselines.SVC_FEATURES).select("ID", "label")


@register("train_trees")
def train_trees(spark, sf):
    """F7 + C3 + C5: truncated SVD (up to 200 components) of raw counts, then
    200 rounds of boosted trees of depth 6 over all classes, saved and loaded."""
    train, val = _train_val(spark, sf)
    path = scratch_path(spark, "trees")
    ML.train_trees(train).save(spark, path)
    return ML.score_trees(val, baselines.TreesModel.load(spark, path))


# Q7 ----------------------------------------------------------------------------
@register("train_baselines")
def train_baselines(spark, sf):
    """Q7: the three baselines on one term table, with M6 of each."""
    return jobs.train_baselines(*_train_val(spark, sf)).report()


@register("train_baselines_errors")
def train_baselines_errors(spark, sf):
    """Q7 + M7: up to 10 wrongly classified texts of each baseline and pair."""
    return jobs.train_baselines(*_train_val(spark, sf)).errors().select("model", "y_true", "y_pred", "rank", "ID", "text")


def _support_sql():
    val = f"SELECT label FROM ({_training_sql()}) WHERE split = 'val'"
    models = "(SELECT unnest(['logreg', 'svm', 'trees']) AS model)"
    return f"""WITH v AS ({val})
SELECT model, CAST(label AS VARCHAR) AS row, count(*) AS support FROM v, {models} GROUP BY ALL
UNION ALL SELECT model, row, count(*) AS support FROM v, {models}, (SELECT unnest(['accuracy', 'macro avg', 'weighted avg']) AS row) GROUP BY ALL"""


@register("train_baselines_support", _support_sql)
def train_baselines_support(spark, sf):
    """Q7: how many validation rows each figure of the report rests on."""
    return jobs.train_baselines(*_train_val(spark, sf)).report().filter("support > 0").select("model", "row", "support")


@register("model_search")
def model_search(spark, sf):
    """C4 + C5: five seeded random trials on a 30 % sample, best refitted on
    all of train, saved and loaded back, then its val report (M6)."""
    train, val = _train_val(spark, sf)
    model, params, trials = ML.random_search(train, val, n_trials=5)
    path = scratch_path(spark, "model")
    ML.save_model(model, path)
    loaded = ML.load_model(path)
    pred = ML.predict(val, loaded, params.features)
    j = pred.join(val.select("ID", F.col("label").alias("y_true")), "ID").withColumnRenamed("label", "y_pred")
    return M.classification_report(j)


# Q3 / C7 ---------------------------------------------------------------------
@register("predict_table")
def predict_table(spark, sf):
    """Q3: unlabelled reviews -> T24 -> fitted classifier -> ``ID,label``
    written as a submission (IO6) and read back."""
    train, _ = _train_val(spark, sf)
    p = ML.LogRegParams(C=10.0, max_iter=1000)
    return jobs.predict_table(V.reviews(spark, sf), ML.train_logreg(train, p), p.features, scratch_path(spark, "submission"))


def _batch_score_sql():
    """The letter model's weights as lists, and its sums over all letters."""
    w = ML.letter_weights()
    lists = ", ".join("[" + ", ".join(repr(float(x)) for x in w[:, k]) + f"]::DOUBLE[] AS w{k}" for k in range(3))
    z = ", ".join(f"coalesce(list_sum(list_transform(places, lambda i: w{k}[i + 1])), 0) / greatest(len(places), 1) + w{k}[27] AS z{k}" for k in range(3))
    place = "CASE WHEN unicode(c) BETWEEN 97 AND 122 THEN unicode(c) - 97 ELSE 27 + unicode(c) % 256 END"
    return f"""WITH w AS (SELECT {lists}),
d AS (SELECT ID, list_transform(regexp_extract_all(lower(text), '\\p{{L}}'), lambda c: {place}) AS places FROM ({_prepare_inference_sql()})),
z AS (SELECT ID, {z} FROM d, w), e AS (SELECT ID, exp(z0) AS e0, exp(z1) AS e1, exp(z2) AS e2 FROM z)
SELECT ID, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS label,
  round(e0 / (e0 + e1 + e2), 6) AS p0, round(e1 / (e0 + e1 + e2), 6) AS p1, round(e2 / (e0 + e1 + e2), 6) AS p2 FROM e"""


@register("batch_score", _batch_score_sql)
def batch_score(spark, sf):
    """A user NumPy model through ``predict_batch_udf`` in batches of 32."""
    test = jobs.prepare_inference(V.reviews(spark, sf).select("ID", "text", "src"))
    s = ML.batch_score(test, ML.letter_model_factory())
    return s.select("ID", "label", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)])


@register("compare_ensemble")
def compare_ensemble(spark, sf):
    """Q5: logistic regression (C6) and the NumPy model (C7) on val, mixed
    with weights from an ensemble config (IO4), ranked with M8."""
    train, val = _train_val(spark, sf)
    p = ML.LogRegParams(C=10.0, max_iter=1000)
    lr = ML.predict(val, ML.train_logreg(train, p), p.features)
    nn = ML.batch_score(val, ML.letter_model_factory())
    cfg_path = scratch_path(spark, "ensemble") + ".json"
    spark.createDataFrame([(json.dumps({"bert_model_dir": "bert", "lr_model_path": "lr.model",
                                        "bert_weight": 0.35, "lr_weight": 0.65, "num_labels": 3}),)],
                          "value string").coalesce(1).write.text(cfg_path)
    return jobs.compare_ensemble({"letters": nn, "logreg": lr}, val, io.read_ensemble_config(spark, cfg_path))


# U1 --------------------------------------------------------------------------
@register("map_text_udf", lambda: f"""SELECT ID, length(regexp_replace(lower(text), {O.q(O.WS + '+')}, ' ', 'g')) AS n_chars
FROM ({O.reviews_sql()})""")
def map_text_udf(spark, sf):
    """A user cleaner applied with a vectorised pandas UDF hook."""
    from reviewlab.functions.udf import map_text
    r = V.reviews(spark, sf).select("ID", "text")
    return map_text(r, lambda s: s.str.lower().str.replace(r"\s+", " ", regex=True)).select(
        "ID", F.length("text").alias("n_chars"))


# ST1 / ST2 -------------------------------------------------------------------
def _drop_files(spark, sf):
    """Reviews as several CSV files in a fresh inbox folder, as many as the
    documents' scan has parts: a file is read by one task."""
    inbox = scratch_path(spark, "inbox")
    r = V.reviews(spark, sf).select("ID", "text", "src")
    files = max(4, V.table(spark, sf, "documents").rdd.getNumPartitions())
    io.write_reviews(r.repartition(files, "ID"), inbox, "csv")
    return inbox


def _served_sql():
    return f"SELECT ID, src, CAST(length(text) % 3 AS INTEGER) AS label FROM ({_prepare_inference_sql('serve', K.MAX_TEXT_LEN_SERVE)})"


@register("stream_predictions", lambda: f"SELECT ID, label FROM ({_served_sql()})")
def stream_predictions(spark, sf):
    """ST1: files arriving in a folder -> prepared -> scored -> ``ID,label``
    parquet with a checkpoint (availableNow trigger)."""
    inbox = _drop_files(spark, sf)
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    stream.run_predictions(spark, inbox, out, ck, stream.default_scorer)
    return spark.read.parquet(out).select("ID", "label")


@register("stream_model_predictions", lambda: f"SELECT ID, true AS same FROM ({O.reviews_sql()})")
def stream_model_predictions(spark, sf):
    """ST1 with a fitted model, saved and loaded: files of two runs of the
    stream, each row's label against that of the batch job (Q3)."""
    train, _ = _train_val(spark, sf)
    path = scratch_path(spark, "stream-model")
    ML.save_model(ML.train_svm(train), path)
    model = ML.load_model(path)
    reviews = V.reviews(spark, sf).select("ID", "text", "src")
    inbox, out, ck = (scratch_path(spark, f"stream-model-{x}") for x in ("in", "out", "ck"))
    for part in (0, 1):
        some = reviews.filter(F.col("ID") % 2 == part)
        io.write_reviews(some.repartition(2, "ID"), inbox, "csv", mode="append")
        stream.run_predictions(spark, inbox, out, ck, ML.scorer(model, baselines.SVC_FEATURES))
    streamed = spark.read.parquet(out).select("ID", F.col("label").alias("streamed"))
    batch = jobs.predict_table(reviews, model, baselines.SVC_FEATURES)
    return batch.join(streamed, "ID", "full").select("ID", F.col("label").eqNullSafe(F.col("streamed")).alias("same"))


@register("stream_source_counts", lambda: f"""SELECT coalesce(nullif(trim(src), ''), {O.q(K.UNKNOWN_SOURCE)}) AS src, label, count(*) AS n
FROM ({_served_sql()}) GROUP BY ALL""")
def stream_source_counts(spark, sf):
    """ST2: running predicted class x source counts over arriving files."""
    inbox = _drop_files(spark, sf)
    out, ck = scratch_path(spark, "counts-out"), scratch_path(spark, "counts-ck")
    stream.run_source_counts(spark, inbox, out, ck, stream.default_scorer)
    return stream.read_source_counts(spark, out)


# J4 / G7 -----------------------------------------------------------------------
@register("source_distribution_last", lambda: f"""WITH s AS (SELECT conv_id AS ID, coalesce(nullif(trim(arg_max(role, turn)), ''), {O.q(K.UNKNOWN_SOURCE)}) AS src
  FROM conversations GROUP BY conv_id),
j AS (SELECT p.y_pred AS label, coalesce(s.src, {O.q(K.UNKNOWN_SOURCE)}) AS src FROM ({O.preds_sql()}) p LEFT JOIN s USING (ID))
SELECT src, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1, count(*) FILTER (label = 2) AS n_2, count(*) AS total FROM j GROUP BY src""")
def source_distribution_last(spark, sf):
    """J4 + G7 where IDs repeat: each conversation's last role is its source."""
    turns = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("ID"), F.col("role").alias("src"), "turn")
    pred = V.preds(spark, sf).select("ID", F.col("y_pred").alias("label"))
    return G.source_distribution(pred, turns, order="turn").select("src", "n_0", "n_1", "n_2", "total")


# IO2 / P5 / IO7 ----------------------------------------------------------------
@register("io_unlabelled_roundtrip", lambda: f"SELECT ID, text, src FROM ({O.reviews_sql()})")
def io_unlabelled_roundtrip(spark, sf):
    """IO2 + P5: ``ID,text,src`` CSV read back with IDs cast to bigint."""
    path = scratch_path(spark, "unlabelled-csv")
    io.write_reviews(V.reviews(spark, sf).select("src", F.col("ID").cast("string").alias("ID"), "text"), path, "csv")
    return frames.cast_ids(io.read_reviews(spark, path, labelled=False), ["ID"])


@register("cached_scores", lambda: f"""SELECT ID, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2
FROM ({O.score_probs_sql()})""")
def cached_scores(spark, sf):
    """IO7: scores stored under a digest of the input and the model's name; the
    second call reads the stored table instead of recomputing."""
    base, inputs = scratch_path(spark, "score-cache"), V.table(spark, sf, "labels")
    io.cached_scores(spark, base, inputs, "scores_a", lambda: V.score_probs(spark, sf))
    s = io.cached_scores(spark, base, inputs, "scores_a", lambda: V.score_probs(spark, sf).limit(0))
    return s.select("ID", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)])


@register("drop_flag_empty", lambda: f"""SELECT ID, length(text) = 0 AS is_empty FROM {O.clean_text_sql(
    f"SELECT ID, CASE WHEN ID % 7 = 0 THEN '​' ELSE text END AS text FROM ({O.reviews_sql()})")}""")
def drop_flag_empty(spark, sf):
    """Texts that clean to nothing (every 7th is a lone zero-width
    space) are flagged, the rest kept."""
    from reviewlab.functions import text as T
    r = V.reviews(spark, sf).select("ID", F.when(F.col("ID") % 7 == 0, F.lit("​"))
                                    .otherwise(F.col("text")).alias("text"))
    return frames.flag_empty(T.clean_text(frames.fill_text(r))).select("ID", "is_empty")
