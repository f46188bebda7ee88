"""Properties of the sampling, dedup, metric and job operators on sf0.001."""

from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.operators import frames, metrics as M, sampling as SMP
from reviewlab.operators.ranking import rank_within, seeded_hash
from reviewlab.plans import jobs
from reviewlab.sources import testviews as V
from tests.conftest import SF001


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert {"src", "n_0", "n_1", "n_2", "total"} <= set(df.columns)


def test_every_query_has_unique_name_and_most_have_sql():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 60


def test_rank_within_matches_window_and_hot_groups(spark):
    d = V.table(spark, SF001, "documents").select(F.col("doc_id").alias("ID"),
                                                   (F.col("doc_id") % 3 == 0).alias("g"))
    d = d.withColumn("h", seeded_hash(42, "ID"))
    # tiny target forces many hash buckets per group (the hot-group path)
    a = rank_within(d, ["g"], "h", "ID", "r", target_rows=4).select("ID", "r")
    from pyspark.sql import Window
    b = d.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h", "ID"))).select("ID", "r")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_cap_per_group_bounds_and_drops_null(spark):
    r = V.reviews(spark, SF001)
    c = SMP.cap_per_group(r, "src", 3)
    assert c.filter(F.col("src").isNull()).count() == 0
    assert c.groupBy("src").count().agg(F.max("count")).first()[0] <= 3


def test_split_partitions_input(spark):
    r = frames.drop_unusable(V.reviews(spark, SF001))
    s = SMP.stratified_split(r)
    assert s.count() == r.count()
    assert s.select("ID").distinct().count() == r.count()
    assert s.filter("split = 'val'").count() > 0


def test_prepare_inference_keeps_rows_and_ids(spark):
    r = V.reviews(spark, SF001).select("ID", "text", "src")
    p = jobs.prepare_inference(r)
    assert p.count() == r.count()
    assert p.select("ID").exceptAll(r.select("ID")).count() == 0
    assert p.filter(F.length("text") > K.MAX_TEXT_LEN_TRAIN + 40).count() == 0


def test_balance_never_exceeds_max_class(spark):
    out = jobs.prepare_training(V.reviews(spark, SF001))
    tr = out.filter("split = 'train'").groupBy("label").count().collect()
    orig = out.filter("split = 'train' AND aug = 0").groupBy("label").count()
    top = orig.agg(F.max("count")).first()[0]
    assert max(r["count"] for r in tr) <= top


def test_confusion_sums_to_join(spark):
    p = V.preds(spark, SF001)
    c = M.confusion(p)
    assert c.count() == 9
    assert c.agg(F.sum("n")).first()[0] == p.count()


def test_macro_modes_differ_when_class_absent(spark):
    p = V.preds(spark, SF001).filter("y_true <> 1 AND y_pred <> 1")
    s = M.summary(p).first()
    assert s["macro_f1_present"] >= s["macro_f1_fixed"]


def test_empty_overlap_is_zero(spark):
    p = V.preds(spark, SF001).filter("ID < 0")
    s = M.summary(p).first()
    assert s["n"] == 0 and s["accuracy"] == 0.0 and s["macro_f1_fixed"] == 0.0


def test_results_unchanged_by_repartition(spark):
    r = frames.drop_unusable(V.reviews(spark, SF001))
    a = SMP.assign_folds(r.select("ID", "label"))
    b = SMP.assign_folds(r.select("ID", "label").repartition(7))
    assert a.exceptAll(b).count() == 0


def test_early_stop_reference_history(spark):
    h = spark.createDataFrame([("r", e, f) for e, f in
                               enumerate([0.60, 0.66, 0.65, 0.66, 0.70, 0.69], start=1)],
                              "run string, epoch int, val_f1 double")
    row = M.early_stop(h, patience=2).first()
    assert (row["best_epoch"], row["stop_epoch"]) == (2, 4)
