"""Classifiers and scoring on MLlib.

Features are n-gram counts (of the F1/F2 terms, cut and counted in Arrow
batches), reweighted by the smooth IDF ``ln((1+n)/(1+df)) + 1`` with
``ElementwiseProduct`` (a vector of vocabulary size, bounded by
``max_features``), then l2-normalised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab import constants as K
from reviewlab.operators import baselines, boosting, linear
from reviewlab.operators import ensemble as E
from reviewlab.operators import features as FT
from reviewlab.operators import metrics as M
from reviewlab.operators.profile import class_weights
from reviewlab.session import cut_lineage, spread, stored


TextFeatures = FT.TextFeatures


@dataclass(frozen=True)
class LogRegParams:
    C: float = 1.0
    penalty: str = "l2"             # l2, l1, elasticnet
    l1_ratio: float = 0.5
    class_weight: str | None = "balanced"
    max_iter: int = 100
    fit_intercept: bool = True
    features: TextFeatures = TextFeatures()


def _with_terms(df: DataFrame, tf: TextFeatures, text: str = "text") -> DataFrame:
    return df.withColumn("terms", tf.terms(text))


class Sublinear(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts as ``1 + ln(count)``; zeros stay."""

    def _transform(self, df: DataFrame) -> DataFrame:
        """In Arrow batches; a vector reaches a task as a struct of its arrays."""
        place, out = df.columns.index(self.getInputCol()), self.getOutputCol()
        schema = T.StructType([*df.schema.fields, T.StructField(out, VectorUDT())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = batch.column(place)
                kind, size, indices, values = vectors.flatten()
                flat = values.flatten().to_numpy(zero_copy_only=False)
                logs = np.where(flat > 0, 1.0 + np.log(np.where(flat > 0, flat, 1.0)), flat)
                sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                field = vectors.type.field("values")
                made = pa.ListArray.from_arrays(offsets, pa.array(logs), type=field.type)
                new = pa.StructArray.from_arrays([kind, size, indices, made], fields=list(vectors.type), mask=vectors.is_null())
                yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, out])

        return df.mapInArrow(run, schema)


def fit_vectorizer(train: DataFrame, tf: TextFeatures) -> PipelineModel:
    """Counts of the vocabulary of ``train``'s texts, smooth-IDF reweighting
    and l2 norm; with sublinear counts, or without either step, as ``tf`` says."""
    (terms,), (idf,) = baselines.vocabularies(train.select("text", F.lit(0).alias("place")), [baselines.Spec(tf)])
    scale = idf if tf.use_idf else np.ones(len(terms))
    stages = [CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="tf")]
    if tf.sublinear_tf:
        sub = Sublinear()
        sub._set(inputCol="tf", outputCol="logtf")
        stages.append(sub)
    stages.append(ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="logtf" if tf.sublinear_tf else "tf",
                                     outputCol="tfidf" if tf.norm else "features"))
    if tf.norm:
        stages.append(Normalizer(inputCol="tfidf", outputCol="features", p={"l1": 1.0, "l2": 2.0}[tf.norm]))
    return PipelineModel(stages=stages)


def _weights(train: DataFrame, mode: str | None, label: str = "label") -> DataFrame:
    if not mode:
        return train.withColumn("weight", F.lit(1.0))
    w = class_weights(train, label, mode).select(label, F.col("weight").cast("double"))
    return train.join(F.broadcast(w), label)   # one row per class


# C1 ------------------------------------------------------------------------
#: Part of the first gradient at which the fit ends.
LOGREG_TOL = 5e-5


def train_logreg(train: DataFrame, p: LogRegParams = LogRegParams(), label: str = "label") -> PipelineModel:
    """Multinomial logistic regression. The library's ``C`` scales the
    summed loss; MLlib's ``regParam`` the mean, so ``regParam = 1/(C n)``.
    Labels 0, 1, ... that all occur are fitted by ``linear.fit``, and the weights
    put into MLlib's model; others are MLlib's to fit or to refuse."""
    train = spread(train.select("text", label))
    vec = fit_vectorizer(train, p.features)
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    enet = {"l2": 0.0, "l1": 1.0, "elasticnet": p.l1_ratio}[p.penalty]

    def estimator(n: int) -> LogisticRegression:
        return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight",
                                  family="multinomial", regParam=1.0 / (p.C * n), elasticNetParam=enet,
                                  standardization=False, maxIter=p.max_iter, fitIntercept=p.fit_intercept)

    terms = vec.stages[0].vocabulary
    if len(counts) < 2 or set(counts) != set(range(len(counts))) or not terms:
        # weighted first: the classes are counted from the rows, not from their features
        d = cut_lineage(_scored(_weights(train, p.class_weight, label), vec, p.features, "text").select("features", label, "weight"))
        return PipelineModel(stages=[*vec.stages, estimator(d.count()).fit(d)])

    n, classes = sum(counts.values()), sorted(counts)
    weights = np.ones(len(classes))
    if p.class_weight:
        weights = np.array([w for _, w in sorted((r[label], float(r["weight"])) for r in class_weights(train, label, p.class_weight).collect())])
    weights *= n / sum(weights[c] * counts[c] for c in classes)  # MLlib's loss is a weighted mean
    scale = next(s for s in vec.stages if isinstance(s, ElementwiseProduct)).getScalingVec().toArray()
    setting = linear.Setting("logistic", len(terms), C=p.C, class_weight=weights, l1_ratio=enet, fit_intercept=p.fit_intercept, max_iter=p.max_iter,
                             tol=LOGREG_TOL, scale=scale, sublinear=p.features.sublinear_tf, norm=p.features.norm)
    rows = stored(FT.count_rows(train, p.features, terms, label).withColumnRenamed(label, "label"), "logreg")
    return PipelineModel(stages=[*vec.stages, _fitted(estimator(n), linear.fit(rows, [setting], classes)[0])])


def _fitted(estimator: LogisticRegression, weights: np.ndarray) -> LogisticRegressionModel:
    """MLlib's model with these weights (classes x (columns, then intercept)),
    the intercepts around zero as MLlib puts them."""
    context = SparkContext._active_spark_context
    matrix = DenseMatrix(len(weights), weights.shape[1] - 1, weights[:, :-1].ravel(order="F"))
    intercepts = Vectors.dense(weights[:, -1] - weights[:, -1].mean())
    java = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        estimator.uid, _py2java(context, matrix), _py2java(context, intercepts), len(weights), True)
    return estimator._copyValues(LogisticRegressionModel(java))


# C2 ------------------------------------------------------------------------
def train_svm(train: DataFrame, C: float = K.SVC_C, tf: TextFeatures = baselines.SVC_FEATURES, label: str = "label",
              max_iter: int = K.SVC_MAX_ITER, tol: float = 1e-4) -> PipelineModel:
    """One-against-the-rest linear SVM with squared hinge loss, by L-BFGS on
    summed sparse gradients."""
    table = baselines.term_table(train.withColumnRenamed(label, "label"), [baselines.Spec(tf)])
    setting = table.setting(0, loss="squared_hinge", C=C, max_iter=max_iter, tol=tol)
    return table.pipeline(0, setting, linear.fit(table.rows, [setting])[0])


# C3 ------------------------------------------------------------------------
def train_trees(train: DataFrame, k: int = K.SVD_COMPONENTS, params: boosting.Params = boosting.Params(),
                tf: TextFeatures = baselines.TREES_FEATURES, label: str = "label") -> baselines.TreesModel:
    """Truncated SVD of the term counts, then boosted trees of all classes."""
    table = baselines.term_table(train.withColumnRenamed(label, "label"), [baselines.Spec(tf)])
    return baselines.fit_trees(table, 0, k, params)


def score_trees(df: DataFrame, model: baselines.TreesModel, text: str = "text") -> DataFrame:
    return model.predict(df, text).select("ID", "label")


# C4 ------------------------------------------------------------------------
def random_params(rng: np.random.RandomState) -> LogRegParams:
    """A draw from the search space. A solver is drawn first: one of the two
    knows l2 only, so that l2 comes up in two draws of three."""
    def one(*of):
        return of[rng.randint(len(of))]
    analyzer = one(*K.SEARCH_ANALYZERS)
    tf = TextFeatures(analyzer, one(*K.SEARCH_NGRAMS[analyzer]), max_features=one(*K.SEARCH_MAX_FEATURES),
                      min_df=one(*K.SEARCH_MIN_DF), max_df=one(*K.SEARCH_MAX_DF), sublinear_tf=one(True, False),
                      norm=one("l2", None), use_idf=one(True, False))
    penalty = rng.choice(["l1", "l2", "elasticnet"], p=[1 / 6, 2 / 3, 1 / 6])
    return LogRegParams(C=float(10 ** rng.uniform(*K.SEARCH_C_EXPONENTS)), penalty=str(penalty),
                        l1_ratio=float(rng.uniform()) if penalty == "elasticnet" else 0.5,
                        class_weight=one(None, "balanced"), max_iter=K.SEARCH_MAX_ITER, fit_intercept=one(True, False), features=tf)


def random_search(train: DataFrame, val: DataFrame, n_trials: int = K.SEARCH_TRIALS, seed: int = K.SEED,
                  sample: float = K.SEARCH_SAMPLE_FRACTION, label: str = "label"):
    """Seeded random search over the logistic-regression space, scored by
    present-label macro-F1 on ``val``; the best draw is refitted on the
    whole train set. Each trial is a distributed fit; trials run in turn."""
    from reviewlab.operators.sampling import sample_fraction
    rng = np.random.RandomState(seed)
    sub = sample_fraction(train, sample, seed)
    trials = []
    for t in range(n_trials):
        p = random_params(rng)
        m = train_logreg(sub, p, label)
        f1 = M.summary(predict(val, m, p.features).join(val.select("ID", F.col(label).alias("y_true")), "ID")
                       .withColumnRenamed("label", "y_pred")).first()["macro_f1_present"]
        trials.append((t, f1, p))
    best = max(trials, key=lambda x: (x[1], -x[0]))
    return train_logreg(train, best[2], label), best[2], [(t, f) for t, f, _ in trials]


# C5 ------------------------------------------------------------------------
def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# C6 ------------------------------------------------------------------------
def _scored(df: DataFrame, model: PipelineModel, tf: TextFeatures, text: str) -> DataFrame:
    """What the model makes of the texts. Its first stage's vocabulary is
    counted in Arrow batches, from the texts instead of arrays of all terms."""
    cv = model.stages[0]
    if not isinstance(cv, CountVectorizerModel) or cv.getMinTF() != 1.0 or cv.getBinary():
        return model.transform(_with_terms(df, tf, text))
    counted = FT.count_rows(df, tf, cv.vocabulary, *df.columns, text=text, vector=cv.getOutputCol())
    return PipelineModel(stages=model.stages[1:]).transform(counted)


def predict(df: DataFrame, model: PipelineModel, tf: TextFeatures = TextFeatures(),
            text: str = "text", key: str = "ID") -> DataFrame:
    """``key, label, p`` (probabilities as ``array<double>``)."""
    out = _scored(df, model, tf, text)
    cols = [F.col(key), F.col("prediction").cast("int").alias("label")]
    if "p" in out.columns:
        cols.append(F.col("p"))
    elif "probability" in out.columns:
        cols.append(vector_to_array("probability").alias("p"))
    else:
        cols.append(E.one_hot(F.col("prediction").cast("int"), 3).alias("p"))
    return out.select(*cols)


def scorer(model: PipelineModel, tf: TextFeatures = TextFeatures(), text: str = "text"):
    """A function that adds ``label`` to a table, for streams too."""
    def score(df: DataFrame) -> DataFrame:
        out = _scored(df, model, tf, text)
        return out.select(*df.columns, F.col("prediction").cast("int").alias("label"))
    return score


# C7 ------------------------------------------------------------------------
def batch_score(df: DataFrame, make_predict_fn, text: str = "text", key: str = "ID",
                batch_size: int = K.SCORING_BATCH_SIZE, num_labels: int = 3) -> DataFrame:
    """Score with a user model through ``predict_batch_udf``: the model is
    built once per Python worker and fed Arrow batches of ``batch_size``.
    ``make_predict_fn()`` returns ``fn(texts: np.ndarray) -> np.ndarray``
    of shape (batch, num_labels) with probabilities."""
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()),
                            batch_size=batch_size, input_tensor_shapes=None)
    # the one-row explode keeps the expressions that made the text out of the
    # model's argument: Spark does not extract a Python function over lambdas
    s = df.select(key, F.explode(F.array(text)).alias("__t")).select(key, udf(F.col("__t")).alias("p"))
    return s.select(key, E.argmax_label("p").alias("label"), "p")


def letter_weights(seed: int = K.SEED, num_labels: int = 3) -> np.ndarray:
    return np.random.RandomState(seed).normal(size=(27 + 256, num_labels))


def letter_model_factory(seed: int = K.SEED, num_labels: int = 3):
    """A tiny NumPy model for tests and demos: frequencies of all letters,
    a-z each and others by code point in 256 places, and a fixed random
    linear layer, softmax output."""
    def make():
        w = letter_weights(seed, num_labels)

        def fn(texts):
            x = np.zeros((len(texts), len(w)))
            for r, t in enumerate(texts):
                b = np.array([ord(c) for c in str(t).lower() if c.isalpha()], np.int64)
                place = np.where((b >= 97) & (b <= 122), b - 97, 27 + b % 256)
                x[r] = np.bincount(place, minlength=len(w)) / max(len(b), 1)
                x[r, 26] = 1.0
            z = x @ w
            z = np.exp(z - z.max(axis=1, keepdims=True))
            return z / z.sum(axis=1, keepdims=True)
        return fn
    return make
