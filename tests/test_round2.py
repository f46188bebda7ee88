"""Readers by column name, cleaning without repeated work, sparse projection, last-wins sources."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.linalg import Vectors

from reviewlab import session
from reviewlab.functions import text as TX
from reviewlab.operators import features as FT
from reviewlab.operators import frames, sparse
from reviewlab.session import scratch_path
from reviewlab.sources import io


def test_columns_are_found_by_name(spark):
    path = scratch_path(spark, "t-order")
    spark.createDataFrame([("web", "a, \"b\"\nc", 2, 7)], "src string, text string, label int, ID long") \
        .write.option("header", True).option("escape", '"').csv(path)
    assert [tuple(r) for r in io.read_reviews(spark, path, with_id=True).collect()] == [(7, 'a, "b"\nc', 2, "web")]
    assert [tuple(r) for r in io.read_reviews(spark, path, labelled=False).collect()] == [(7, 'a, "b"\nc', "web")]
    bare = scratch_path(spark, "t-bare")
    spark.createDataFrame([("t", "x")], "text string, label string").write.option("header", True).csv(bare)
    with pytest.raises(PySparkException):
        io.read_reviews(spark, bare).collect()
    with pytest.raises(Exception, match="(?i)id"):
        io.read_reviews(spark, bare, labelled=False)


def test_history_without_run_column(spark):
    path = scratch_path(spark, "t-history")
    spark.createDataFrame([(1, 0.5, 0.25)], "epoch int, val_f1 double, train_loss double").write.option("header", True).csv(path)
    r = io.read_history(spark, path).first()
    assert (r["run"], r["epoch"], r["val_f1"], r["train_loss"], r["lr"]) == (None, 1, 0.5, 0.25, None)


def test_filters_do_not_repeat_the_cleaning_chain(spark):
    df = spark.createDataFrame([(i, f"Text {i} !!!") for i in range(5)], "ID long, text string")
    plan = frames.drop_empty(TX.clean_text(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_") <= 70


def test_new_emoji_stay(spark):
    df = spark.createDataFrame([("a\U0001FAE0b\U0001F979​c",)], "text string")
    assert df.select(TX.strip_nonprintable("text")).first()[0] == "a\U0001FAE0b\U0001F979c"


def test_projection_of_sparse_rows(spark):
    rows = [(1, Vectors.sparse(4, [0, 3], [1.0, 2.0])), (2, Vectors.sparse(4, [], [])), (3, Vectors.dense([0, 1, 0, 0]))]
    m = np.arange(8.0).reshape(4, 2)
    table = sparse.compact(spark.createDataFrame(rows, ["ID", "features"]), "ID")
    assert {r["ID"]: r["svd"] for r in FT.project(table, m).collect()} == {1: [12.0, 15.0], 2: [0.0, 0.0], 3: [2.0, 3.0]}


def test_last_source_wins(spark):
    reviews = spark.createDataFrame([(1, "zeta", 0), (1, "alpha", 1), (2, "b", 0)], "ID long, src string, at int")
    pred = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "ID long, label int")
    for order in ("at", None):
        got = {r["ID"]: r["src"] for r in frames.join_source(pred, reviews.coalesce(1), order=order).collect()}
        assert got[1] == "alpha" and got[2] == "b"


def test_no_scratch_folder_off_local_masters():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())
