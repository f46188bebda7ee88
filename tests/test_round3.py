"""Digits of all scripts, digests, counters, streams that restart, vocabularies of any size, jobs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlab.functions import sentences as S
from reviewlab.functions import text as TX
from reviewlab.operators import baselines, boosting, frames
from reviewlab.operators import features as FT
from reviewlab.operators import models as ML
from reviewlab.operators import profile as G
from reviewlab.plans import jobs
from reviewlab.session import scratch_path, stored
from reviewlab.sources import io
from reviewlab.streaming import stream


@pytest.mark.parametrize("text, marked", [
    ("٨ из 10", "[HIGH_SCORE] ٨ из 10"), ("٠٣ / 10", "[LOW_SCORE] ٠٣ / 10"), ("०५/10", "[MID_SCORE] ०५/10"), ("१२ из 10", "[HIGH_SCORE] १२ из 10"),
    ("٣ из 5", "[MID_SCORE] ٣ из 5"), ("๔/5", "[HIGH_SCORE] ๔/5"), ("٢/5 4/10", "[LOW_SCORE] ٢/5 [LOW_SCORE] 4/10"), ("² из 10", "² из 10")])
def test_ratings_in_digits_of_other_scripts(spark, text, marked):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(TX.mark_rating5(TX.mark_rating10("text"))).first()[0] == marked


def test_texts_without_a_rules_marks_are_left_alone(spark):
    texts = ["plain text", "a < b > c", "http only", "at @ sign", "8 из", "/10", "★", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for rule in (TX.mask_url, TX.mask_email, TX.mark_emoji, TX.mark_rating10, TX.mark_rating5, TX.mark_stars, TX.mark_slang):
        assert [r[0] for r in df.select(rule("text")).collect()] == texts


def test_digest_follows_rows_and_not_their_order(spark):
    rows = [(1, "a", None), (2, None, 0.5), (2, None, 0.5)]
    def digest(rows, schema="ID long, text string, x double", parts=2):
        return io.table_digest(spark.createDataFrame(rows, schema).repartition(parts))
    same = digest(rows)
    assert digest(rows[::-1], parts=3) == same
    assert io.table_digest(spark.createDataFrame(rows, "ID long, text string, x double").select("x", "ID", "text")) == same
    others = [digest(rows[:2]), digest([(1, None, None), *rows[1:]]), digest([(1, "a", None), (2, None, 0.5), (2, None, 0.25)]), digest(rows, "ID long, text string, y double"), digest([], parts=1)]
    assert len({same, *others}) == 6


def test_changed_rows_under_one_path_are_scored_again(spark):
    path, base, calls = scratch_path(spark, "t-input"), scratch_path(spark, "t-scores"), []
    def compute():
        calls.append(1)
        return spark.read.parquet(path).select("ID", F.array(F.lit(float(len(calls)))).alias("p"))
    def scored(model):
        return io.cached_scores(spark, base, spark.read.parquet(path), model, compute).first()["p"]
    spark.createDataFrame([(1, "a")], "ID long, text string").write.parquet(path)
    assert [scored("m"), scored("m"), scored("other")] == [[1.0], [1.0], [2.0]]
    spark.createDataFrame([(1, "b")], "ID long, text string").write.mode("overwrite").parquet(path)
    assert [scored("m"), scored("m")] == [[3.0], [3.0]]


def test_counters_of_one_write(spark):
    rows = [(1, "a", 0), (2, "a", 0), (3, "​", 1), (4, "bb cc dd ee", 2)]
    steps = G.StepCounters(5)
    raw = steps.watch(spark.createDataFrame(rows, "ID long, text string, label int"), "raw")
    cleaned = steps.watch(TX.clean_text(steps.watch(frames.dedup_exact(raw), "deduped")), "cleaned")
    short = steps.watch(frames.drop_empty(cleaned).withColumn("text", S.shorten("text", 5)), "shortened")
    stored(short, "t-counters")
    assert tuple(steps.report(spark).first())[:4] == (4, 1, 1, 1)


def _files(spark, inbox, rows):
    io.write_reviews(spark.createDataFrame(rows, "ID string, text string, src string").coalesce(1), inbox, "csv", mode="append")


def test_stream_quarantines_bad_rows_and_goes_on_after_a_restart(spark):
    inbox, out, bad, ck = (scratch_path(spark, f"t-stream-{x}") for x in ("in", "out", "bad", "ck"))
    _files(spark, inbox, [("1", "one, \"two\"\nthree", "web"), ("x7", "bad id", "web"), (" 2 ", "", None)])
    stream.run_predictions(spark, inbox, out, ck, stream.default_scorer, bad)
    first = {r["ID"] for r in spark.read.parquet(out).collect()}
    _files(spark, inbox, [("3", "more", "app"), (None, "no id", "app")])
    for _ in range(2):  # the second finds nothing new
        stream.run_predictions(spark, inbox, out, ck, stream.default_scorer, bad)
    assert first == {1, 2} and sorted(r["ID"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    kept = spark.read.parquet(bad).collect()
    assert sorted(r["text"] for r in kept) == ["bad id", "no id"] and all(r["file"].endswith(".csv") and "t-stream-in" in r["file"] for r in kept)


def test_a_batch_that_runs_again_replaces_its_output(spark, monkeypatch):
    inbox, out, ck = (scratch_path(spark, f"t-again-{x}") for x in ("in", "out", "ck"))
    _files(spark, inbox, [("1", "one", "web"), ("2", "two", "web")])
    def breaks(df):
        raise RuntimeError("lost")
    with pytest.raises(Exception, match="lost"):
        stream.run_predictions(spark, inbox, out, ck, breaks)
    for _ in range(2):
        stream.run_predictions(spark, inbox, out, ck, stream.default_scorer)
    assert sorted(r["ID"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_counts_are_written_as_changes(spark):
    inbox, out, ck = (scratch_path(spark, f"t-counts-{x}") for x in ("in", "out", "ck"))
    one = lambda df: df.withColumn("label", F.lit(1))
    _files(spark, inbox, [("1", "a", "web"), ("2", "b", "app"), ("3", "c", " ")])
    stream.run_source_counts(spark, inbox, out, ck, one)
    _files(spark, inbox, [("4", "d", "web")])
    stream.run_source_counts(spark, inbox, out, ck, one)
    assert {tuple(r) for r in stream.read_source_counts(spark, out).collect()} == {("web", 1, 2), ("app", 1, 1), ("Не указан", 1, 1)}
    changes = Counter(r["batch"] for r in spark.read.parquet(out).collect())
    assert changes[max(changes)] <= 1 and sum(changes.values()) == 4


@pytest.mark.parametrize("most", [None, 7])
def test_vocabulary_is_numbered_in_order(spark, most):
    texts = [(i, [f"t{j:02d}" for j in range(40) if i % (j % 9 + 1) == 0 for _ in range(j % 3 + 1)]) for i in range(60)]
    counts = FT.term_counts(spark.createDataFrame(texts, "ID long, terms array<string>"))
    got = FT.vocabulary(counts, F.lit(60), min_df=2, max_df=50, max_features=most).collect()
    tf, df = Counter(t for _, ts in texts for t in ts), Counter(t for _, ts in texts for t in set(ts))
    order = sorted((t for t in tf if 2 <= df[t] <= 50), key=lambda t: (-tf[t], t))[:most]
    assert [(r["term"], r["tf"], r["df"], r["idx"]) for r in sorted(got, key=lambda r: r["idx"])] == [(t, tf[t], df[t], i) for i, t in enumerate(order)]


def test_terms_are_not_exchanged_by_document(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "ID long, terms array<string>")
    counts = FT.term_counts(df)
    vocab = FT.vocabulary(counts, F.lit(1), max_features=5)
    plan = FT.tfidf(counts, vocab, F.lit(1), vocab_bound=5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ID" in plan and "hashpartitioning(ID#" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(ID" in line and "term" in line]


def _reviews(n, seed=0):
    words = {0: "bad awful poor", 1: "plain so usual", 2: "good fine great"}
    return [(i, f"{words[i % 3]} item{(i * 7 + seed) % 11}" if i % 10 else "mixed words", i % 3) for i in range(n)]


def test_baselines_share_one_table(spark):
    train, val = (spark.createDataFrame(_reviews(n, s), "ID long, text string, label int") for n, s in ((180, 0), (60, 3)))
    search = [ML.LogRegParams(C=c, class_weight=w) for c, w in ((0.01, None), (10.0, "balanced"))]
    out = jobs.train_baselines(train, val, search, k=8, trees=boosting.Params(rounds=5))
    report = {(r["model"], r["row"]): r for r in out.report().collect()}
    assert {m for m, _ in report} == set(jobs.MODELS) and all(report[m, "accuracy"]["support"] == 60 for m in jobs.MODELS)
    assert all(report[m, "accuracy"]["f1"] > 0.85 for m in jobs.MODELS)
    errors = out.errors(3).collect()
    assert {r["text"] for r in errors} == {"mixed words"} and max(r["rank"] for r in errors) <= 3
    again = ML.predict(val, out.pipelines["svm"], baselines.SVC_FEATURES).collect()
    assert {(r["ID"], r["label"]) for r in again} == {(r["ID"], r["y_pred"]) for r in out.predictions.filter("model = 'svm'").collect()}


def test_dashboard_counts_the_last_of_repeated_ids(spark):
    pred = spark.createDataFrame([(1, 0, 0), (1, 2, 1), (2, 1, 2), (3, 7, 3)], "ID long, label int, pos int")
    reviews = spark.createDataFrame([(1, "web", 0), (1, "app", 1)], "ID long, src string, pos int")
    truth = spark.createDataFrame([(1, 2, 0), (2, 0, 1), (9, 1, 2)], "ID long, label int, pos int")
    page = jobs.dashboard(pred, reviews, truth)
    assert {r["label"]: r["n"] for r in page.classes.collect()} == {0: 0, 1: 1, 2: 1}
    assert {(r["src"], r["total"]) for r in page.sources.collect()} == {("app", 1), ("Не указан", 1)}
    assert page.scores.first()["accuracy"] == 0.5 and page.confusion.filter("n > 0").count() == 2


def test_prediction_job_keeps_every_row(spark):
    train = spark.createDataFrame(_reviews(90), "ID long, text string, label int")
    model = ML.train_svm(train)
    rows = spark.createDataFrame([(1, "good great", "web"), (2, None, None), (3, "​", "app")], "ID long, text string, src string")
    out = jobs.predict_table(rows, model, baselines.SVC_FEATURES, scratch_path(spark, "t-submission"))
    assert sorted(r["ID"] for r in out.collect()) == [1, 2, 3] and out.columns == ["ID", "label"]
    with pytest.raises(ValueError, match="src"):
        jobs.predict_table(rows.drop("src"), model, baselines.SVC_FEATURES)


def test_dedup_finds_copies_without_moving_texts(spark):
    rows = [(i, f"text {i % 40}", i % 2 if i % 7 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "ID long, text string, label int, extra int").repartition(4)
    first = {}
    for r in rows:
        first.setdefault((r[1], r[2]), r)
    out = frames.dedup_exact(df)
    assert sorted(map(tuple, out.collect())) == sorted(first.values()) and out.columns == df.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortAggregate" not in plan
    nulls = df.withColumn("text", F.when(F.col("ID") % 3 > 0, F.col("text")))
    assert frames.dedup_exact(nulls).count() == len({(None if r[0] % 3 == 0 else r[1], r[2]) for r in rows})
    assert frames.dedup_exact(df.limit(0)).count() == 0


def test_dedup_of_repeated_keys_compares_rows(spark):
    rows = [(1, "a", 0), (1, "a", 0), (1, "b", 0), (2, "b", 0), (None, "c", 1), (None, "c", 1), (3, "d", None)]
    out = frames.dedup_exact(spark.createDataFrame(rows, "ID long, text string, label int"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "a", 0), (1, "b", 0), (None, "c", 1), (3, "d", None)]))
    # a key that is a copy's in one group stays in another
    two = [(5, "x", 0), (4, "x", 0), (5, "y", 0)]
    assert sorted(map(tuple, frames.dedup_exact(spark.createDataFrame(two, "ID long, text string, label int")).collect())) == [(4, "x", 0), (5, "y", 0)]
