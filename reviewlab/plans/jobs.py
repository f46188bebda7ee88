"""End-to-end jobs composed from the operators: Q1 `prepare_training`, Q2
`prepare_inference`, Q3 `predict_table`, Q4 `evaluate`, Q5
`compare_ensemble`, Q6 `dashboard`, Q7 `train_baselines`."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.functions import sentences as S
from reviewlab.functions import text as T
from reviewlab.operators import baselines, boosting, frames, linear
from reviewlab.operators import ensemble as E
from reviewlab.operators import features as FT
from reviewlab.operators import metrics as M
from reviewlab.operators import models as ML
from reviewlab.operators import profile as G
from reviewlab.session import stored
from reviewlab.sources import io


def prepare_inference(raw: DataFrame, max_len: int = K.MAX_TEXT_LEN_TRAIN,
                      profile: str = "train", text: str = "text", src: str = "src") -> DataFrame:
    """P2 fill -> T19 clean -> P4 flag empties -> T22 shorten ->
    P13 source token. One narrow stage: no shuffle, row count and keys
    unchanged, so it scales linearly with the input."""
    frames.require_columns(raw, [text])
    df = frames.fill_text(raw, text)
    df = T.clean_text(df, text, profile=profile)
    df = df.withColumn(text, S.shorten(text, max_len))
    df = frames.flag_empty(df, text)
    if src in df.columns:
        df = frames.add_source_token(df, text, src)
    return df


def prepare_training(raw: DataFrame, seed=K.SEED, max_per_src: int | None = K.MAX_SAMPLES_PER_SRC,
                     max_len: int = K.MAX_TEXT_LEN_TRAIN, max_total: int | None = None,
                     val_size: float = K.VAL_SIZE, max_aug_per_row: int = K.MAX_AUG_PER_SAMPLE,
                     key: str = "ID", materialise: bool = True) -> DataFrame:
    """Q1: the training-set build, returned as one table with ``split`` in
    {train, val}, ``aug`` (0 = original row, n = n-th augmented copy) and
    ``ord`` (seeded shuffle position of train rows).

    Order of steps is the original's: drop unusable -> exact dedup (before
    cleaning) -> clean -> drop empty -> shorten -> cap per source -> optional
    stratified total cap -> stratified split -> augment train only ->
    source token -> shuffle. The split result feeds three branches, so it
    is checkpointed to the shared folder once instead of recomputing the
    cleaning chain for each branch.
    """
    from reviewlab.operators import sampling
    from reviewlab.session import cut_lineage, spread

    frames.require_columns(raw, ["text", "label"])
    has_src = "src" in raw.columns
    df = frames.drop_unusable(raw)
    df = frames.dedup_exact(df, ("text", "label"), key)
    if materialise:
        # store the deduplicated rows, then spread them over the cores: the
        # cleaning after the dedup shuffle is CPU-bound
        df = spread(cut_lineage(df))
    df = T.clean_text(df, "text")
    df = frames.drop_empty(df)
    df = df.withColumn("text", S.shorten("text", max_len))
    if materialise:
        # the caps and the split read the cleaned rows in several branches
        # (counts, bucket counts, ranks): store them once instead of
        # re-running the regex chain per branch
        df = cut_lineage(df)
    if has_src and max_per_src is not None:
        df = sampling.cap_per_group(df, "src", max_per_src, seed, key)
    df = sampling.cap_total_stratified(df, "label", max_total, seed, key)
    df = sampling.stratified_split(df, "label", val_size, seed, key, rank=False)
    if materialise:
        df = cut_lineage(df)
    train = df.filter(F.col("split") == "train")
    val = df.filter(F.col("split") == "val").withColumn("aug", F.lit(0))
    extra = sampling.balance_by_augmentation(train, "label", "text", key, max_aug_per_row, seed)
    train = frames.append_rows(train.withColumn("aug", F.lit(0)), extra)
    if has_src:
        train = frames.add_source_token(train)
        val = frames.add_source_token(val)
    train = train.withColumn("__k", F.concat(F.col(key).cast("string"), F.lit("|"),
                                             F.col("aug").cast("string")))
    train = sampling.shuffle_rows(train, seed, "__k").drop("__k")
    return frames.append_rows(train, val.withColumn("ord", F.lit(None).cast("bigint")))


# Q3 --------------------------------------------------------------------------
def predict_table(unlabelled: DataFrame, model: PipelineModel, features: FT.TextFeatures, path: str | None = None,
                  max_len: int = K.MAX_TEXT_LEN_SERVE) -> DataFrame:
    """Q3: reviews ``ID, text, src`` -> cleaned for serving -> ``ID, label`` of
    each, also of empty ones; written to ``path`` (IO6) where it is given and
    read back from there. The three columns must be there."""
    frames.require_columns(unlabelled, ["ID", "text", "src"])
    prepared = prepare_inference(unlabelled.select("ID", "text", "src"), max_len=max_len, profile="serve")
    out = ML.predict(prepared, model, features).select("ID", "label")
    if path is None:
        return out
    io.write_submission(out, path)
    return out.sparkSession.read.option("header", True).schema("ID bigint, label int").csv(path)


# Q4 --------------------------------------------------------------------------
def evaluate(pred: DataFrame, truth: DataFrame, key: str = "ID", order: str | None = None) -> DataFrame:
    """Q4: two label tables (as IO3 reads them) -> one row of M3-M5. Of rows
    with one ID the last counts, on both sides, by ``order`` or by place in the
    files; IDs on one side only are left out."""
    pred, truth = (frames.last_by_id(d, key, order) for d in (pred, truth))
    return M.summary(frames.join_truth(pred.select(key, "label"), truth.select(key, "label"), key))


# Q5 --------------------------------------------------------------------------
def compare_ensemble(scores: dict[str, DataFrame], truth: DataFrame, config: DataFrame) -> DataFrame:
    """Q5: two models' ``ID, label, p`` and their mix by the weights of an
    ensemble config (IO4), ranked by macro-F1 against ``ID, label`` (M8)."""
    (first, a), (second, b) = scores.items()
    weights = config.select("bert_weight", "lr_weight").first()
    mixed = E.ensemble(a.select("ID", "p"), b.select("ID", "p"), weights["bert_weight"], weights["lr_weight"])
    long = (a.select(F.lit(first).alias("model"), "ID", "label")
            .unionByName(b.select(F.lit(second).alias("model"), "ID", "label"))
            .unionByName(mixed.select(F.lit("ensemble").alias("model"), "ID", E.argmax_label("p").alias("label"))))
    return M.leaderboard(long, truth.select("ID", "label"))


# Q6 --------------------------------------------------------------------------
@dataclass
class Dashboard:
    """What the report page shows: classes, classes by source, and with a
    truth table the scores and the confusion matrix."""
    classes: DataFrame
    sources: DataFrame
    scores: DataFrame | None = None
    confusion: DataFrame | None = None


def dashboard(pred: DataFrame, reviews: DataFrame, truth: DataFrame | None = None, key: str = "ID") -> Dashboard:
    """Q6: predictions ``ID, label``, reviews ``ID, src`` and optionally a truth
    table. The last of repeated IDs counts."""
    pred = frames.valid_labels(frames.last_by_id(pred, key))
    out = Dashboard(G.class_distribution(pred), G.source_distribution(pred, reviews, key))
    if truth is not None:
        joined = frames.join_truth(pred, frames.last_by_id(truth, key), key)
        out.scores, out.confusion = M.summary(joined), M.confusion(joined)
    return out


# Q7 --------------------------------------------------------------------------
@dataclass
class Baselines:
    """``predictions``: model, ID, y_true, y_pred, text of the validation rows.
    ``search``: macro-F1 of each setting of the logistic regression."""
    predictions: DataFrame
    search: list[tuple[str, float]] = field(default_factory=list)
    pipelines: dict[str, PipelineModel] = field(default_factory=dict)
    trees: baselines.TreesModel | None = None

    def report(self) -> DataFrame:
        """M6 of each model."""
        parts = [M.classification_report(self.predictions.filter(F.col("model") == m)).withColumn("model", F.lit(m)) for m in MODELS]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def errors(self, n: int = 10) -> DataFrame:
        """M7 of each model, with texts."""
        parts = [M.error_examples(self.predictions.filter(F.col("model") == m), n) for m in MODELS]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])


MODELS = ("logreg", "svm", "trees")
#: Settings that the logistic regression is searched over, all in the same passes.
SEARCH = [ML.LogRegParams(C=c, class_weight=w, max_iter=K.SEARCH_MAX_ITER) for c in (0.1, 1.0, 10.0) for w in (None, "balanced")]


def train_baselines(train: DataFrame, val: DataFrame, search: list[ML.LogRegParams] | None = None, k: int = K.SVD_COMPONENTS,
                    trees: boosting.Params = boosting.Params(), tol: float = 1e-3) -> Baselines:
    """Q7: the three classical models on one table of term counts.

    ``train`` and ``val`` have ``ID, text, label``. Texts are cut into terms
    once. The SVM (on 40 % of the rows) and all settings of the logistic
    regression (on 30 %) are fitted in the same passes over the table; the
    setting of the best macro-F1 on ``val`` is fitted again on all rows. The
    trees read components of their own columns of the table. All models score
    one table of ``val``'s counts.
    """
    search = SEARCH if search is None else search
    specs = [baselines.Spec(p.features, K.SEARCH_SAMPLE_FRACTION) for p in search]
    specs += [baselines.Spec(p.features) for p in search] + [baselines.Spec(baselines.SVC_FEATURES, K.SVC_SAMPLE_FRACTION), baselines.Spec(baselines.TREES_FEATURES)]
    distinct = list(dict.fromkeys(specs))
    table = baselines.term_table(train, distinct)

    def setting(i: int, p: ML.LogRegParams) -> linear.Setting:
        return table.setting(distinct.index(specs[i]), loss="logistic", C=p.C, class_weight=p.class_weight, fit_intercept=p.fit_intercept, max_iter=p.max_iter, tol=tol)

    svm = table.setting(distinct.index(specs[-2]), loss="squared_hinge", C=K.SVC_C, max_iter=K.SVC_MAX_ITER, tol=tol)
    tried = [setting(i, p) for i, p in enumerate(search)]
    *fitted, svm_weights = linear.fit(table.rows, [*tried, svm])

    counted = stored(table.counted(val, "ID", "label", "text"), "baselines-val")
    names = [str(i) for i in range(len(tried))]
    found = linear.predict(counted, dict(zip(names, zip(tried, fitted, strict=True), strict=True)), "ID", "label")
    scores = {r["model"]: r["macro_f1_present"] for r in
              M.summary(found.select("model", "ID", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred")), by=["model"]).collect()}
    best = max(names, key=lambda n: (scores.get(n, 0.0), -int(n)))
    whole = setting(len(search) + int(best), search[int(best)])
    weights = linear.fit(table.rows, [whole])[0]

    last = linear.predict(counted, {"logreg": (whole, weights), "svm": (svm, svm_weights)}, "ID", "label", "text")
    model = baselines.fit_trees(table, distinct.index(specs[-1]), k, trees)
    by_trees = boosting.predict(FT.project(counted.select("ID", "indices", "values"), model.projection, table.columns(distinct.index(specs[-1])), out="x"), model.trees)
    predictions = (last.select("model", "ID", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"), "text")
                   .unionByName(counted.select("ID", F.col("label").alias("y_true"), "text").join(by_trees.select("ID", F.col("label").alias("y_pred")), "ID")
                                .select(F.lit("trees").alias("model"), "ID", "y_true", "y_pred", "text")))
    return Baselines(stored(predictions, "baselines"), [(str(search[int(n)]), scores.get(n, 0.0)) for n in names],
                     {"logreg": table.pipeline(distinct.index(specs[len(search) + int(best)]), whole, weights),
                      "svm": table.pipeline(distinct.index(specs[-2]), svm, svm_weights)}, model)
