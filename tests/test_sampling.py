"""Caps, samples, splits and augmentation against plain Python, with hot
groups narrowed down step by step, nulls, ties and empty tables."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reviewlab.operators import ranking as R
from reviewlab.operators import sampling as S
from reviewlab.session import scratch_path
from reviewlab.sources import io
from reviewlab.operators import frames
from reviewlab.plans import jobs


def _hash(key, seed=42):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


def _rows(n=500):
    return [(i, "hot" if i % 3 else f"s{i % 7}" if i % 10 else None, i % 4 if i % 11 else 0, f"word{i} two three four five") for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), "ID long, src string, label int, text string").repartition(5)


def _firsts(rows, group, quota):
    groups = defaultdict(list)
    for r in rows:
        groups[r[group]].append(r[0])
    return {i for g, ids in groups.items() if quota(g, len(ids)) for i in sorted(ids, key=lambda i: (_hash(i), i))[:quota(g, len(ids))]}


@pytest.mark.parametrize("target", [1_000_000, 4])
@pytest.mark.parametrize("n", [1, 17, 400])
def test_caps_keep_the_first_by_hash(table, monkeypatch, target, n):
    monkeypatch.setattr(R.cut_points, "__defaults__", (None, target))
    monkeypatch.setattr(R, "DIGITS", (1, 2))
    rows = [r for r in _rows() if r[1] is not None]
    assert {r["ID"] for r in S.cap_per_group(table, "src", n).collect()} == _firsts(rows, 1, lambda g, size: n)
    every = S.cap_per_group(table, "src", n, keep_null=True)
    assert {r["ID"] for r in every.collect()} == _firsts(_rows(), 1, lambda g, size: n) and every.columns == table.columns
    assert {r["ID"] for r in S.sample_n(table, n).collect()} == set(sorted(range(500), key=lambda i: (_hash(i), i))[:n])


def test_a_cap_moves_no_texts(table):
    plan = S.cap_per_group(table, "src", 5)._jdf.queryExecution().executedPlan().toString()
    kept = plan.split("cut-points")[0]
    assert "Window" not in kept and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_split_without_ranks_is_the_split_with_them(table):
    ranked = {(r["ID"], r["split"]) for r in S.stratified_split(table).collect()}
    assert {(r["ID"], r["split"]) for r in S.stratified_split(table, rank=False).collect()} == ranked
    assert Counter(s for _, s in ranked)["val"] == 50


def test_samples_of_empty_tables(table):
    none = table.limit(0)
    assert S.cap_per_group(none, "src", 3).count() == 0 and S.sample_n(none, 3).count() == 0
    assert S.cap_total_stratified(none, "label", 3).count() == 0 and S.stratified_split(none, rank=False).count() == 0
    assert S.balance_by_augmentation(none).count() == 0 and S.sample_n(table, 0).count() == 0


@pytest.mark.parametrize("most", [1, 3])
def test_copies_of_a_row_follow_the_deficit(spark, most):
    """A class gets deficit div rows copies a row, 1 to ``most``, until its deficit is met."""
    sizes = {0: 50, 1: 7, 2: 20, 3: 45, 4: 16}
    ids = iter(range(1000))
    rows = [(next(ids), c, "one two three four five six") for c, n in sizes.items() for _ in range(n)]
    out = S.balance_by_augmentation(spark.createDataFrame(rows, "ID long, label int, text string"), max_per_row=most).collect()
    want = []
    for c, n in sizes.items():
        missing, left = 50 - n, 50 - n
        per = min(most, max(1, missing // n))
        for i in sorted((r[0] for r in rows if r[1] == c), key=lambda i: (_hash(i), i)):
            want += [(i, a + 1) for a in range(min(per, left))]
            left -= min(per, left)
    assert sorted((r["ID"], r["aug"]) for r in out) == sorted(want)


def test_the_last_row_of_a_file_counts(spark):
    path = scratch_path(spark, "t-last")
    rows = [(i % 40, (i * 7) % 3) for i in range(400)]
    spark.createDataFrame(rows, "ID long, label int").coalesce(1).write.option("header", True).csv(path)
    labels = io.read_labels(spark, path, position=True)
    got = {int(r["ID"]): r["label"] for r in frames.last_by_id(labels.repartition(7)).collect()}
    assert got == {i: (7 * (360 + i)) % 3 for i in range(40)}
    one = jobs.evaluate(labels.repartition(5), labels).first()
    assert one["n"] == 40 and one["accuracy"] == 1.0


def test_keyword_modes(spark):
    df = spark.createDataFrame([(1, "Red car"), (2, "redcar BLUE"), (3, "red blue")], "ID long, text string")
    found = {m: {r["ID"] for r in frames.filter_keyword(df, ["red", "blue"], mode=m).collect()} for m in ("any", "all", "contains")}
    assert found == {"any": {1, 2, 3}, "all": {3}, "contains": {1, 2, 3}}
    assert {r["ID"] for r in frames.filter_keyword(df, ["dca"], mode="contains").collect()} == {2}
    with pytest.raises(ValueError, match="mode"):
        frames.filter_keyword(df, ["red"], mode="some")
