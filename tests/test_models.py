"""Letters of all scripts, the whole search space, unaligned scores."""

import numpy as np
import pytest

from reviewlab.operators import ensemble as E
from reviewlab.operators import models as ML
from reviewlab.session import scratch_path


def test_letter_model_reads_all_letters():
    p = ML.letter_model_factory()()(np.array(["плохо", "хорошо", "", "Été", "t"], object))
    assert p.shape == (5, 3) and np.allclose(p.sum(axis=1), 1)
    assert len({tuple(np.round(r, 9)) for r in p}) == 5


def test_search_draws_from_the_whole_space():
    drawn = [ML.random_params(np.random.RandomState(s)) for s in range(400)]
    assert min(p.C for p in drawn) < 0.01 and max(p.C for p in drawn) > 50
    assert {p.penalty for p in drawn} == {"l1", "l2", "elasticnet"} and {p.fit_intercept for p in drawn} == {True, False}
    tf = [p.features for p in drawn]
    assert {(t.analyzer, t.ngram) for t in tf} == {("word", (1, n)) for n in (1, 2, 3)} | {("char", (3, n)) for n in (5, 6, 7)}
    assert {t.max_features for t in tf} == {30_000, 50_000, 80_000, 120_000} and {t.min_df for t in tf} == {2, 5, 10}
    assert {t.max_df for t in tf} == {0.9, 0.95, 1.0} and {(t.sublinear_tf, t.norm, t.use_idf) for t in tf} == {
        (a, b, c) for a in (True, False) for b in ("l2", None) for c in (True, False)}


def test_sublinear_counts_without_idf_and_norm_are_kept_by_a_saved_model(spark):
    rows = [(1, "aa aa aa bb", 0), (2, "aa bb bb", 1), (3, "aa cc", 2), (4, "cc bb aa", 0)]
    train = spark.createDataFrame(rows, "ID long, text string, label int")
    tf = ML.TextFeatures("word", (1, 1), 1, 1.0, 100, sublinear_tf=True, norm=None, use_idf=False)
    model = ML.train_logreg(train, ML.LogRegParams(features=tf, fit_intercept=False, max_iter=5))
    path = scratch_path(spark, "t-model")
    ML.save_model(model, path)
    out = {r["ID"]: r["features"] for r in ML.load_model(path).transform(ML._with_terms(train, tf)).collect()}
    assert sorted(out[1].values) == pytest.approx([1.0, 1 + np.log(3)])
    assert sorted(out[2].values) == pytest.approx([1.0, 1 + np.log(2)])
    assert list(model.stages[-1].interceptVector) == [0, 0, 0]


def test_ensemble_of_unaligned_scores_raises(spark):
    a, b = (spark.createDataFrame([(i, [0.5, 0.5]) for i in ids], "ID long, p array<double>") for ids in ((1, 2), (2, 3)))
    with pytest.raises(ValueError, match="aligned"):
        E.ensemble(a, b, 0.5, 0.5)
    assert E.ensemble(a, b, 0.5, 0.5, strict=False).filter("p IS NULL").count() == 2
