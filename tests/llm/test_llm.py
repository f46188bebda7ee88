"""The operators of reviewlab.llm against brute force on small tables with
nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reviewlab.llm import ann, common, graph, lm, minhash, mixing, packing, pii, quality, suffix, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts(seed=1, n=60):
    rng = np.random.default_rng(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    return [" ".join(rng.choice(words, rng.integers(30, 90))) for _ in range(n)]


def _rows():
    texts = _texts()
    base = texts[0].split()
    near = [" ".join([*base[:i], "changed", *base[i + 1:]]) for i in (3, 9, 20)]
    shared = "passage " * 5 + " ".join(f"p{i}" for i in range(70))
    texts += near + [texts[1]] * 3 + [f"before {i} {shared} after {i}" for i in range(3)] + ["", " \t\n", "one", "two words", "x" * 700, "ab " * 400]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "no id here at all", None, None, 3), (500, None, "en", None, None), (501, None, None, "s1", None)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(d):
    return (d is None, d or 0)


# --- 1: repeated strings --------------------------------------------------------------

def _brute_repeats(rows, length=200):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, data):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((r[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda x: (_key(x[0]), *x[1:]))


def test_repeats_match_brute_force(docs, rows, empty):
    got = [tuple(r) for r in suffix.remove_repeats(docs).drop("kept").collect()]
    assert sorted(got, key=lambda x: (_key(x[0]), *x[1:])) == _brute_repeats(rows)
    assert suffix.remove_repeats(empty).count() == 0


def test_repeats_where_partners_differ_on_both_sides(spark):
    """Anchors whose nearest suffix is not the one that agrees to the left."""
    rng = np.random.default_rng(3)
    part = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    a, b, c = part(120), part(100), part(120)
    texts = [part(50) + a + b + c, a + b + part(150), part(150) + b + c, a[10:] + b + part(1) + c, part(40) + b + c[:100] + part(9), part(300)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = [tuple(r) for r in suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA)).drop("kept").collect()]
    assert sorted(got, key=lambda x: (_key(x[0]), *x[1:])) == _brute_repeats(rows)


def test_loser_tree_merges_front_coded_runs():
    rng = np.random.default_rng(0)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(200)]
    runs = []
    for i in range(7):
        shared, sizes, tails = suffix.front_coded(sorted(strings[i::7]))
        runs.append(suffix.Run(np.frombuffer(shared, "<u2").tolist(), np.frombuffer(sizes, "<u2").tolist(), tails))
    out, before = [], b""
    parts = [sorted(strings[i::7]) for i in range(7)]
    for r, p, lcp in suffix.merge(runs):
        s = parts[r][p]
        assert lcp == suffix.common_prefix(before, s, 0)
        out.append(s)
        before = s
    assert out == sorted(strings)


# --- 2, 4: vectors -------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, score double"


def _vectors(n=400, width=16):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[40:60] = x[0]  # ties
    rows = [(i, [float(v) for v in r], 0, 9.0) for i, r in enumerate(x)]
    return rows + [(1000, None, 0, 1.0), (1040, [float("nan")] * width, 0, 1.0), (1060, [0.0] * width, 0, 1.0), (1080, [None, *[1.0] * (width - 1)], 0, 1.0), (None, [1.0] * width, 0, 0.0)]


def test_neighbours_reach_recall_and_are_exact(spark):
    rows = _vectors()
    df = spark.createDataFrame(rows, VECTORS)
    x = {r[0]: np.array(r[1], float) for r in rows[:400]}
    for sample, least in ((8192, 1.0), (128, 0.9)):
        got = ann.neighbours(df, F.col("vec_id") % 20 == 0, k=10, sample=sample, leaf=16, block=150, recall=0.97).collect()
        found = Counter()
        for q in range(0, 400, 20):
            mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            assert [r["rank"] for r in mine] == list(range(1, 11))
            assert all(abs(r["score"] - float(x[q] @ x[r["vec_id"]])) < 1e-12 and r["vec_id"] != q for r in mine)
            best = sorted(((-float((x[q] * v).sum()), i) for i, v in x.items() if i != q))[:10]
            found[q] = len({i for _, i in best} & {r["vec_id"] for r in mine})
            if least == 1.0:
                assert [r["vec_id"] for r in mine] == [i for _, i in best]
        assert sum(found.values()) / (10 * len(found)) >= least
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert {r["query_id"] for r in got} == set(range(0, 400, 20))


def test_neighbours_visits_reach_recall_for_each_row_asked():
    x = np.random.default_rng(4).normal(size=(250, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    indexed = np.column_stack([x, np.zeros(len(x))])
    forest = ann.Forest(indexed, 4, 8)
    visits = ann.calibrated(x, indexed, forest, 10, 0.85)
    placed, product = forest.place(indexed), x @ x.T
    np.fill_diagonal(product, -np.inf)
    best = np.argsort(-product, axis=1)[:, :10]

    def worst(visits):  # neighbours found for the row that finds fewest
        return min(np.isin(placed[best[q]], forest.search(indexed[q], visits)).any(axis=1).sum() for q in range(len(x)))

    assert worst(visits) >= 9 > worst(visits - 1) and visits < forest.leaves
    assert ann.calibrated(x[:0], indexed[:0], ann.Forest(indexed[:0]), 10, 0.85) == ann.calibrated(x[:1], indexed[:1], ann.Forest(indexed[:1]), 10, 0.85) == 1


def test_neighbours_search_the_same_way_at_any_size(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(10, 16)) * 8
    x = {i: centres[i % 10] + rng.normal(size=16) for i in range(300)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()] * 2, "vec_id long, embedding array<double>")  # each row twice
    set_visits, seen = ann.calibrated, []

    def watched(rows, indexed, forest, k, recall):
        seen.append((len(rows), set_visits(rows, indexed, forest, k, recall), forest.leaves))
        return seen[-1][1]

    monkeypatch.setattr(ann, "calibrated", watched)
    for sample in (8192, 600, 599):  # more than all rows, all, one less
        got = ann.neighbours(df, F.col("vec_id") % 7 == 0, k=10, sample=sample, leaf=8).collect()
        assert len(seen) == 1, "the table's size decides whether the search is set"
        rows, visits, leaves = seen.pop()
        assert rows == 300 and visits < leaves
        for q in range(0, 300, 7):
            best = sorted(((-float((x[q] * v).sum()), i) for i, v in x.items() if i != q))[:10]
            assert len({i for _, i in best} & {r["vec_id"] for r in got if r["query_id"] == q}) >= 9


def test_neighbours_score_a_row_once_and_drop_only_what_cannot_be_among_the_best(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(600, 8)), 1)
    x[100:180] = x[3]  # ties across blocks
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    stored, made = ann.stored, []

    def counted(frame, name):
        out = stored(frame, name)
        if name == "ann-found":
            made.append((out.count(), out.select("query_id", "vec_id").distinct().count()))
        return out

    def search():
        return sorted(ann.neighbours(df, F.col("vec_id") % 3 == 0, k=6, sample=200, leaf=16, block=60).collect())

    monkeypatch.setattr(ann, "stored", counted)
    got = search()
    floor = ann.floor_of
    monkeypatch.setattr(ann, "floor_of", lambda *_: float("-inf"))
    assert search() == got and len(got) == 200 * 6
    assert all(rows == pairs for rows, pairs in made) and made[0][0] < made[1][0] / 2
    # below the k-th best of the rows met by itself, and no floor with fewer
    rows, bits, placed = np.array([[1.0], [5.0], [3.0], [4.0]]), np.array([True, False]), np.array([[0], [1], [0], [0]])
    others = np.array([True, True, True, False])
    assert floor(np.array([2.0]), bits, rows, placed, others, 2, 0.5) == 1.5 and floor(np.array([2.0]), bits, rows, placed, others, 3, 0.5) == -np.inf


def test_neighbours_take_the_most_frequent_length(spark):
    good = [(i, [float(i + 1), 1.0, -float(i % 3)]) for i in range(30)]
    ids = spark.range(2000).orderBy(F.xxhash64("id")).limit(1).first()[0]  # the first by hash is odd
    rows = [(i, v) for i, v in good if i != ids] + [(ids, [1.0, 2.0])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 5, k=3).collect()
    assert {r["query_id"] for r in got} == {0, 1, 2, 3, 4} - {ids} and ids not in {r["vec_id"] for r in got}


def test_neighbours_bound_rows_and_queries_of_a_task(spark, monkeypatch):
    df = spark.createDataFrame(_vectors(), VECTORS)
    whole = ann.neighbours(df, F.col("vec_id") % 2 == 0, k=5, leaf=16, block=150).collect()
    rerank = ann._rerank

    def watched(k):
        run = rerank(k)

        def check(part):
            assert part["query"].sum() <= 60, "too many queries in one task"
            return run(part)
        return check

    monkeypatch.setattr(ann, "_rerank", watched)
    cut = ann.neighbours(df, F.col("vec_id") % 2 == 0, k=5, leaf=16, block=150, query_block=25).collect()
    assert len({r["query_id"] for r in cut}) > 150 and sorted(map(str, cut)) == sorted(map(str, whole))


def test_top_k_is_exact_across_blocks(spark):
    rows = _vectors()
    df = spark.createDataFrame(rows, VECTORS)
    x = {r[0]: np.floor(256 * np.array(r[1], float)).astype(int) for r in rows if r[0] is not None and r[0] not in (1000, 1040, 1080)}
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, candidates=70, query_block=3).collect()
    for q in [i for i in x if i % 50 == 0]:
        best = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best
    few = topk.top_k(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0], 0, 0.0), (1, [1e30, 0.0], 0, 0.0)], VECTORS)
    assert topk.top_k(huge, F.col("vec_id") == 0).first()["score"] == 2**63 - 1


# --- 3, 8: language models ------------------------------------------------------------

def test_language_model_counts_and_sums_to_one(docs, rows, empty):
    model = lm.train(docs)
    counts = Counter(w for r in rows for w in [*(r[1] or "").encode().lower().split(), None])
    assert model.tokens == sum(counts.values()) and model.distinct == len(counts)
    scored = {(r["doc_id"], r["text"]): r for r in lm.score(docs.withColumn("score", F.lit("old")), model).collect()}
    below = model.tokens + 0.5 * (model.distinct + 1)
    for r in rows:
        words, got = [*(r[1] or "").encode().lower().split(), None], scored[r[0], r[1]]
        assert got["n_tokens"] == len(words) == got["n_known"]
        assert got["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.5) / below) for w in words))
    every = np.append(np.arange(model.distinct), -1)
    for before in (-1, 0, 7, model.distinct):
        assert (10 ** model.log10(np.full(len(every), before), every)).sum() == pytest.approx(1.0, abs=1e-9)
    nothing = lm.train(empty)
    assert nothing.tokens == 0 and lm.score(docs, nothing).filter("score IS NULL OR isnan(score)").count() == 0


def test_language_model_pairs_are_kneser_ney(spark):
    texts = ["a b a b a c", "b a b", "c c a b", "d a"]
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    sequences = [["<s>", *t.split(), "</s>"] for t in texts]
    pairs = Counter(p for s in sequences for p in zip(s, s[1:]))
    follow = Counter(w for _, w in pairs)
    n = [sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)]
    assert list(model.pair_counts) == n and list(model.word_counts) == [sum(c == k for c in follow.values()) for k in (1, 2, 3, 4)]
    d, e = model.discounts(tuple(n)), model.discounts(model.word_counts)
    low = lambda w: (follow[w] - e[min(follow[w], 3)]) / sum(follow.values()) + sum(e[min(c, 3)] for c in follow.values()) / sum(follow.values()) / (len(follow) + 1)

    def p(v, w):
        after = {x: c for (u, x), c in pairs.items() if u == v}
        return (after.get(w, 0) - d[min(after.get(w, 0), 3)] + sum(d[min(c, 3)] for c in after.values()) * low(w)) / sum(after.values())

    got = lm.score(spark.createDataFrame([("a b c b",)], "text string"), model).first()["score"]
    s = ["<s>", "a", "b", "c", "b", "</s>"]
    assert got == pytest.approx(sum(np.log10(p(v, w)) for v, w in zip(s, s[1:])))


def test_quality_keeps_trusted_text_and_drops_noise(spark, docs, empty):
    good = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(9))) for i in range(40)]).alias("text"),
                                   F.lit("en").alias("lang"), F.lit(0).alias("keep"))
    noise = spark.range(1000, 1030).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("z"), F.xxhash64("id", F.lit(i))) for i in range(40)]).alias("text"),
                                           F.lit(None).cast("string").alias("lang"), F.lit(1).alias("keep"))
    out = quality.classify(good.unionByName(noise), good.filter("doc_id < 300").select("doc_id"))
    assert out.filter("doc_id >= 1000 AND keep").count() == 0
    assert out.filter("doc_id < 1000 AND keep").count() > 360
    assert quality.classify(docs, empty.select("doc_id")).filter("NOT keep").count() == 0
    assert quality.classify(empty, empty.select("doc_id")).count() == 0


def test_quality_learns_and_sets_thresholds_from_all_trusted_text(spark, monkeypatch):
    word = [F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50))) for i in range(6)]
    lang = F.when(F.col("id") % 1500 == 0, "rare").when(F.col("id") % 3 == 0, "fr").otherwise("en")
    docs = common.stored(spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *word).alias("text"), lang.alias("lang")), "test-quality")
    train, learnt = lm.train, []
    monkeypatch.setattr(quality.lm, "train", lambda d, name: learnt.append(d.count()) or train(d, name))
    out = quality.classify(docs, docs.select("doc_id")).toPandas()
    held = docs.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(quality.HELD)) == 0).toPandas()["doc_id"]
    assert learnt == [24_000 - len(held)]
    for name, own in out.groupby("lang"):
        values = np.sort(own.loc[own["doc_id"].isin(held), "perplexity"].to_numpy())
        assert len(values) and set(own["threshold"]) == {values[int(np.ceil(quality.QUANTILE * len(values))) - 1]}, name


def test_rows_with_ids_are_a_semi_join(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(quality.lm, "FILE_IDS", 7)
    ids = spark.createDataFrame([(i,) for i in (*range(-5, 40, 2), 7, 7, 500, 10**12, None)], "doc_id long")
    chosen = docs.select("doc_id", "text")
    assert sorted(map(str, quality.with_ids(chosen, ids).collect())) == sorted(map(str, chosen.join(ids, "doc_id", "left_semi").collect()))
    assert quality.with_ids(chosen, ids.limit(0)).count() == quality.with_ids(empty.select("doc_id", "text"), ids).count() == 0


# --- 5: near-duplicates ------------------------------------------------------------------

def _components(rows, width, percent):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                root[y] = x
    return {(r[0], len(s), find(r[0]) if r[0] is not None else None) for r, s in zip(rows, sets)}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(docs, rows, empty, width, percent):
    out = minhash.near_duplicates(docs, width, percent).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out} == _components(rows, width, percent)
    assert len(out) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one(docs, width, percent)
    assert kept.columns == docs.columns and kept.filter("doc_id IS NULL OR doc_id = 500").count() == 2


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    texts = _texts(12, 6)
    rows = [(4, texts[0], "b"), (4, texts[0], "b"), (3, texts[0], "a"), (None, texts[0], "n"), (None, texts[1], "n"), (None, texts[1], "n"),
            (7, texts[2], "x"), (7, texts[3], "y"), (7, texts[2], "x"), (8, "", "e"), (8, "", "e"), (9, None, "z")]
    out = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    wanted = [(3, texts[0], "a"), (None, texts[1], "n"), (7, texts[2], "x"), (7, texts[3], "y"), (8, "", "e"), (8, "", "e"), (9, None, "z")]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, wanted))


def test_near_duplicates_in_a_family_without_one_centre(spark):
    """A chain: each text differs from the next in one word, the ends in many."""
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(40):
        base = base.copy()
        base[(i * 7) % 120] = f"c{i}"
        texts.append(" ".join(base))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == _components(rows, 3, 85)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (2, 1), (12, 11), (11, 10), (10, 13), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 10, 11: 10, 12: 10, 13: 10}


# --- 6: packing -------------------------------------------------------------------------

def test_packing_is_a_round_trip(docs, rows, empty):
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    out = packing.pack(docs, packing.vocabulary(), with_ids=True).collect()
    want = Counter((r[0], (*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0)) for r in rows)
    pieces = {}
    for p in sorted(out, key=lambda p: (_key(p["doc_id"]), p["start"])):
        ids = np.frombuffer(p["ids"], "<u4")
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(ids) == p["length"] > 0
        pieces.setdefault((p["doc_id"], p["start"]), []).append(p)
    joined = Counter()
    for (doc, ids), n in want.items():
        parts, at = [], 0
        while at < len(ids):
            match = next(p for p in pieces[doc, at] if p["doc_tokens"] == len(ids) and tuple(np.frombuffer(p["ids"], "<u4")) == ids[at:at + p["length"]])
            parts.append(match)
            at += match["length"]
        joined[doc, ids] = n
    assert joined == want and sum(p["length"] for p in out) == sum(len(i) * n for (_, i), n in want.items())
    for sequence in {p["sequence_id"] for p in out}:
        own = sorted((p for p in out if p["sequence_id"] == sequence), key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
        assert sum(p["length"] for p in own) <= 1024
    assert packing.pack(empty, packing.vocabulary()).count() == 0


def test_words_are_encoded_as_in_the_text():
    words = packing._words(packing.vocabulary())
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids.count(50256) == 1
    texts = ["", " ", "a  b", "one <|endoftext|>two <|endoftext", "ʼn ɐlpha ꟲ ⅷ a\u0301 ß. ſ, word! (word) word... 12, x1. \x1cq r\x85s\u2003 t", "Слово, слово. 中文 字。 ½ ²", "x \n y", "a\nb c\nd, e.\n\nf g", "don't stop. it's a_b 3rd x²   z", "tab\tx y\t z", "<|endoftext|> a <|endoftext|>", "é,\nÉa (b) 'c' d'", "a\r\nb c\r\n", "\n", "w\n\nx y"]
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [w.tolist() for w in words(texts)] == expected
    assert [w.tolist() for w in words(texts[::-1])] == expected[::-1]  # known by now
    assert words([]) == []


def test_cached_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 5000)
    words, texts = packing._Words(Tokenizer.from_file(packing.vocabulary())), _texts(5, 200)
    for at in range(0, 200, 10):
        found = words(texts[at:at + 10])
        assert [w.tolist() for w in found] == [e.ids for e in words.tokenizer.encode_batch(texts[at:at + 10], add_special_tokens=False)]
        assert words.bytes < 5000 + 10 * 90 * 300


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = sorted(set(rng.integers(1, 40, 6).tolist()), reverse=True)
        counts = [0] * 41
        for n in lengths:
            counts[n] = int(rng.integers(1, 4))
        room = int(rng.integers(1, 100))
        sums = {0}
        for n in lengths:
            sums = {s + n * k for s in sums for k in range(counts[n] + 1)}
        used = packing.fullest(counts, lengths, room)
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)
        assert all(0 < k <= counts[n] for n, k in used.items())


# --- 7: toxicity ------------------------------------------------------------------------

def test_toxicity_learns_words_and_scores_every_row(spark, docs, empty):
    texts = _texts(4, 400)
    rows = [(i, t + (" awful, vile" if i % 5 == 0 else ""), "en", "s", 1) for i, t in enumerate(texts)]
    train = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score(train.withColumn("score", F.lit("old")), toxicity.fit(train, labels)).collect()
    held = [r for r in scored if r["doc_id"] >= 300]
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in held)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).filter("score < 0.5").count() == docs.count()
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def _plain_ftrl(rows, labels):
    """FTRL-proximal as published, one coordinate at a time."""
    z, n, (alpha, beta, l1, l2) = {}, {}, (toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i]**0.5) / alpha + l2)
    prior = (sum(labels) + 0.1) / (len(labels) + 1)
    bias, bias_n = float(np.log(prior / (1 - prior))), 0.0
    for _ in range(toxicity.EPOCHS):
        for row, y in zip(rows, labels):
            w = {i: weight(i) for i in row}
            g = 1 / (1 + np.exp(-(bias + sum(w.values())))) - y
            for i in row:
                sigma = ((n.get(i, 0.0) + g * g)**0.5 - n.get(i, 0.0)**0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
            bias_n += g * g
            bias -= 0.05 / (1 + bias_n**0.5) * g
    return bias, {i: weight(i) for i in z if weight(i)}


def test_toxicity_weights_and_scores_match_a_plain_ftrl(spark):
    texts = _texts(21, 120)
    rows = [(i, t + (" awful vile" if i % 3 == 0 else " nice day"), "en", "s", 1) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    labels = [(i, int(i % 3 == 0)) for i in range(100)]
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int"))
    made = {r[0]: [int(x) for x in toxicity.features([(r[1] or "").encode()])[0]] for r in rows}
    order = np.random.default_rng(5).permutation(100)
    bias, weights = _plain_ftrl([made[i] for i in order], [labels[i][1] for i in order])
    got = dict(zip(model["feature"].tolist(), model["weight"].tolist()))
    assert got.pop(-1) == pytest.approx(bias, rel=1e-9)
    assert weights and got == pytest.approx(weights, rel=1e-9)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert scores == pytest.approx({i: 1 / (1 + np.exp(-(bias + sum(weights.get(f, 0.0) for f in fs)))) for i, fs in made.items()}, rel=1e-9)


# --- 9: private data --------------------------------------------------------------------

def test_surrogates_keep_type_format_and_identity(spark, empty):
    text = ('Mail Jo.Doe@mail.org, JO.DOE@MAIL.ORG or 152.143.1.9. Call +1 (017) 555-7713 980. Card 4111 1111 1111 1111, not 4111111111111112. '
            'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"\nMrs Anna Smith and Mr Smith; version 1.2.3 and 45250. GB82 WEST 1234 5698 7654 32')
    rows = [(1, text), (2, text), (2, "clean text, nothing private 12345"), (None, "a@b.org"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("mine"))
    out = pii.replace(df, b"k", counts="found").collect()
    got = [r for r in out if r["doc_id"] in (1, 2) and r["text"] != rows[2][1]]
    assert got[0]["text"] == got[1]["text"] and sum(r["text"] == rows[2][1] for r in out) == 1
    assert {r["kind"] for r in out} == {"mine"} and [r["text"] for r in out if r["doc_id"] in (3, 4)] == [None, ""]
    new = got[0]["text"]
    for secret in ("Doe", "DOE", "152.143.1.9", "555-7713", "4111 1111 1111 1111", "04dbebab", "Anna", "Smith", "GB82"):
        assert secret not in new
    for clean in ("not 4111111111111112", "version 1.2.3 and 45250.", " 980. Card ", "Mrs ", " and Mr "):
        assert clean in new
    found = pii.entities(new)
    assert [k for _, _, k, _ in found] == [k for _, _, k, _ in pii.entities(text)]
    names = [v for _, _, k, v in found if k == "surname"]
    assert names[0] == names[1] and len({v for _, _, k, v in found if k == "email"}) == 1
    assert got[0]["found"]["card"] == 1 and pii.replace(empty, b"k").count() == 0


@pytest.mark.parametrize("text, kind, shown", [
    ("paid with 4111111111111111 12/25 today", "card", "4111111111111111"),
    ("4111 1111 1111 1111 123", "card", "4111 1111 1111 1111"),
    ("4111-1111-1111-1111-12/25", "card", "4111-1111-1111-1111"),
    ("order 55 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
    ("378282246310005 1234", "card", "378282246310005"),
    ("4111 1111 1111 1113 555-123-4567", "phone", "555-123-4567"),
    ("BE68 5390 0754 7034 OK", "iban", "BE68 5390 0754 7034"),
    ("BE68539007547034 1234 5678", "iban", "BE68539007547034"),
    ("AB12 CD34 EF56 BE68 5390 0754 7034 NOW", "iban", "BE68 5390 0754 7034"),
])
def test_numbers_are_found_beside_other_groups(text, kind, shown):
    assert [(k, text[a:b]) for a, b, k, _ in pii.entities(text)] == [(kind, shown)]
    assert shown not in pii.replaced(text, b"k", {})[0]


@pytest.mark.parametrize("text, hidden, kept", [
    ("Dr. J. Smith came. Smith and Anna Smith's dog left SMITH; blacksmith, smithy.", "J. Smith SMITH", ["Dr. ", "'s dog", "blacksmith, smithy"]),
    ("Mr John Paul Smith met John", "John Paul Smith", ["Mr ", " met "]),
    ("Mr Łukasz Żak, Łukasz", "Łukasz Żak", ["Mr "]),
    ("Prof. Dr. J.R.R. van der Berg-Owen and Berg-Owen", "J. R. Berg Owen", ["Prof. Dr. ", " van der "]),
    ("Madame d'Aubigny; Mr O’Neill, O'Neill; Mr Smith I think", "Aubigny Neill Smith", ["Madame ", " I think"]),
    ("госпожа Анна Ивановна Петрова. Петрова ушла", "Анна Ивановна Петрова", ["госпожа ", " ушла"]),
    ("Frau Smith, smith@mail.org, Smith-Jones", "Smith smith@mail.org", ["Frau ", "-Jones"]),
])
def test_names_are_found_whole_and_again(text, hidden, kept):
    new = pii.replaced(text, b"k", {})[0]
    assert not [h for h in hidden.split() if h in new] and not [k for k in kept if k not in new]
    assert [k for *_, k, _ in pii.entities(new)] == [k for *_, k, _ in pii.entities(text)]
    for value in {(k, v) for *_, k, v in pii.entities(text)}:
        shown = {pii.rendered(text[a:b], k, pii.surrogate(b"k", k, v)).casefold() for a, b, k, v in pii.entities(text) if (k, v) == value}
        assert len(shown) == 1


def test_surrogates_that_clash_try_again(spark, monkeypatch):
    values = [f"u{i}@x.org" for i in range(30)]
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, value, attempt=0: f"s{(int(value[1:-6]) + 7 * attempt) % 40}@x.org" if value[0] == "u" else value)
    table = [("email", v) for v in values] + [("email", "s3@x.org")]
    out = pii.settled(spark.createDataFrame(table, "kind string, value string"), b"k").collect()
    assert len({r["surrogate"] for r in out}) == len(out) == 31


# --- 10: mixing ---------------------------------------------------------------------------

def test_mix_meets_targets(spark, docs, rows, empty):
    out = mixing.mix(docs.withColumn("taken", F.lit("old"))).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in held)
        share = {s: 3 * sizes[s] if s in held else weight[s] * left / sum(weight[x] for x in order if x not in held) for s in order}
        over = {s for s in order if s not in held and share[s] > 3 * sizes[s]}
        if not over:
            break
        held |= over
    for s in order:
        mine = [r for r in out if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(share[s]) and 0 <= r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - share[s]) <= max([r["size"] for r in mine])
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0


def test_mix_order_matches_brute_force(spark):
    """Probabilities in proportion to sizes, the order by odds, and where it ends."""
    rng = np.random.default_rng(12)
    rows = [(i, "w " * int(rng.pareto(1.2) * 20 + 1) if i % 17 else "", f"s{i % 3}" if i % 5 else "s3") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = {r["doc_id"]: r for r in mixing.mix(df).withColumn("h", F.xxhash64(F.lit(17), "doc_id", F.crc32("text"))).collect()}
    uneven = 0
    for source in ("s0", "s1", "s2", "s3"):
        own = [r for r in out.values() if r["source"] == source]
        whole = int(own[0]["target"] // own[0]["source_size"])
        words = own[0]["target"] - whole * own[0]["source_size"]
        certain, per_word = 0, None
        by_size = sorted((r["size"] for r in own if r["size"]), reverse=True)
        for k, size in enumerate(by_size):  # the largest so many are certain
            per_word = (words - sum(by_size[:k])) / sum(s * s for s in by_size[k:])
            if per_word * size <= 1:
                break
            certain += 1
        chance = {r["doc_id"]: min(1.0, per_word * r["size"]) for r in own}
        uneven += len(set(chance.values())) > 10
        assert sum(chance[r["doc_id"]] * r["size"] for r in own) == pytest.approx(words)
        def place(r):
            u, p = (((r["h"] % 2**64) >> 12) + 0.5) / 2.0**52, chance[r["doc_id"]]
            return (u / (1 - u) * (1 - p) / p if p else float("inf")), r["h"]
        taken, left = set(), words
        order = sorted((r for r in own if r["size"]), key=place)
        for at, r in enumerate(order):
            if r["size"] > left:
                near = min(order[at:], key=lambda x: (abs(x["size"] - left), place(x)))
                if abs(near["size"] - left) < left:
                    taken.add(near["doc_id"])
                break
            taken.add(r["doc_id"])
            left -= r["size"]
        assert {r["doc_id"]: r["copies"] for r in own if r["size"]} == {r["doc_id"]: whole + (r["doc_id"] in taken) for r in own if r["size"]}
    assert uneven >= 3


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, "a b c " * (i % 5 + 1), "s", i, float(i), True, "x", i * 10) for i in range(20)]
    names = "doc_id long, text string, source string, size int, _q double, _whole boolean, copies string, `mix_size` long"
    out = mixing.mix(spark.createDataFrame(rows, names), out_prefix="mix_")
    assert out.columns == ["doc_id", "text", "source", "size", "_q", "_whole", "copies", "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]
    assert sorted(tuple(r)[:7] for r in out.collect()) == [r[:7] for r in rows]
    assert {r["mix_size"] for r in out.collect()} == {3, 6, 9, 12, 15}


def test_keep_one_keeps_columns_of_any_name(spark):
    rows = [(i, "same text in all of these rows here", i * 7, "c") for i in range(3)] + [(9, "another one", 5, "d")]
    out = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _row int, component_id string"))
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[3]]


def test_initials_stay_apart():
    for kind in ("given_m", "surname"):
        for letters in pii.ALPHABETS:
            shown = [pii.surrogate(b"k", kind, c) for c in letters]
            assert sorted(shown) == sorted(letters) and not [c for c, s in zip(letters, shown) if c == s]
    assert pii.initials(b"k", "surname") != pii.initials(b"l", "surname")
    text = "Dr. E. Smith, Dr. I. Smith, Dr. R. Smith, Dr. S. Smith and Dr. W. Smith"
    assert len(set(re.findall(r"Dr\. (\w)\.", pii.replaced(text, b"k", {})[0]))) == 5


def test_top_k_of_repeated_ids_equals_its_sql(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 60 if i % 3 else 50, [float(v) for v in rng.integers(-3, 4, 6)]) for i in range(150)]
    rows += [rows[0], rows[0], (None, [1.0] * 6), (100, None), (150, [float("nan")] * 6), (200, [])]
    held = pd.DataFrame({"vec_id": pd.array([r[0] for r in rows], "Int64"), "embedding": [r[1] for r in rows]})
    con = duckdb.connect()
    con.register("held", held)
    con.execute("CREATE TABLE embeddings AS SELECT vec_id, embedding::DOUBLE[] AS embedding FROM held")
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0, candidates=40, query_block=4)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(topk.OP4_SQL).fetchall())


def test_mix_counts_equal_rows(spark):
    rows = [(1, "a b c", "en", "s", 1)] * 50 + [(2, "a b c d e f", "en", "t", 1)] * 10
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 6


# --- the pipeline -------------------------------------------------------------------------

def test_pipeline_stages_keep_columns_and_take_effect(spark, docs, tmp_path):
    bad = [(900 + i, t + " awful vile", "en", "s1", 1) for i, t in enumerate(_texts(9, 60))]
    table = docs.unionByName(spark.createDataFrame([*bad, (990, "write to jo@mail.org now please", "en", "s2", 1)], SCHEMA))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0) for i in range(60)] + [(900 + i, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = stage.columns, {}
    for name, f in corpus_pipeline.STAGES:
        stage = common.stored(f(spark, stage, str(tmp_path)), "test-stage")
        ids[name] = {r[0] for r in stage.select("doc_id").distinct().collect()}
        if name != "packing":
            assert stage.columns == columns
        if name == "pii":
            assert stage.filter("text LIKE '%jo@mail.org%'").count() == 0 and stage.filter("doc_id = 990").count() == 1
    assert not ids["toxicity"] & {r[0] for r in bad} and ids["toxicity"] >= set(range(60))
    assert 0 in ids["minhash_near_dedup"] and not ids["minhash_near_dedup"] & {60, 61, 62, 63, 64, 65}
    assert ids["packing"] == ids["mixing"] <= ids["pii"] == ids["minhash_near_dedup"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == stage.count()
