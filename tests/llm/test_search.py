"""Lexical search, SimHash and hard negatives against brute force, on small
tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reviewlab.llm import lexical, negatives, simhash

DOCS = "doc_id long, text string, n long, term string, score double"
ITEMS = "item_id long, text string, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def _texts(n=300, seed=4):
    rng = np.random.default_rng(seed)
    words = ["w%d" % i if i % 5 else "É%dß" % i for i in range(120)]
    p = 1 / np.arange(1, 121)
    return [" ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum())) for _ in range(n)]


def _doc_rows():
    texts = _texts()
    texts += [texts[3]] * 5 + ["W1, w1;W2 (w3) -- w1\tw1\x00w7", "", " .,; ", "x" * 3000, "w1 " * 5000, "中文 w1 中文"]
    rows = [(i, t, 1, "clash", 0.5) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[3], 1, None, None), (None, None, 1, None, None), (900, None, None, None, None)]


def _item_rows():
    texts = _texts(12, 9)
    return [(i, t, 1) for i, t in enumerate(texts)] + [
        (50, "", 1), (51, None, 1), (52, "unknown", 1), (53, "É5ß w1 w1", 1), (None, "w1", 1), (54, "w2", 1), (54, "w2 w3", 1), (55, _doc_rows()[3][1], 1)]


def _brute_search(docs, items, k=20):
    found = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t, *_ in docs]
    n_docs, length = sum(1 for _, c in found if c), sum(c.total() for _, c in found)
    holding = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t, *_ in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(UPPER)))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c in found:
            m = 100 - 25 + 25 * c.total() * n_docs // length if c else 0
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in q.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, pairs", [(40, 10_000), (2048, 20)])
def test_search_matches_brute_force(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = _doc_rows(), _item_rows()
    got = lexical.ranked(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), pairs=pairs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == _brute_search(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame(_doc_rows()[:5], DOCS), spark.createDataFrame(_item_rows()[:2], ITEMS)
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0


def test_terms_are_the_same_when_a_text_is_cut(monkeypatch):
    text = "one two; Three\nfour " * 50 + "x" * 300 + " é"
    whole = lexical.term_counts(text.encode())
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert lexical.term_counts(text.encode()) == whole == Counter(t.encode() for t in TERM.findall(text.translate(UPPER)))


def test_no_row_exceeds_the_bound_of_a_ball_and_most_are_pruned():
    rng = np.random.default_rng(0)
    width, centres = 200, [rng.choice(200, 20, replace=False) for _ in range(12)]
    rows = []
    for i in range(600):
        terms = np.unique(rng.choice(centres[i % 12], rng.integers(1, 15)))
        rows.append((terms, rng.integers(1, 10**12, len(terms))))
    sparse = lexical.Rows(np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])]), np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]))
    tree = lexical.Tree(sparse, width, leaf=8)
    below = [None] * len(tree.children)
    for node in reversed(range(len(tree.children))):
        below[node] = tree.leaves[node][0].tolist() if tree.leaves[node] else sum((below[c] for c in tree.children[node]), [])
    assert sorted(below[0]) == list(range(600))
    visited = 0
    for centre in centres:
        terms, counts = np.sort(centre)[:10], rng.integers(1, 4, 10)
        query = dict(zip(terms.tolist(), counts.tolist()))
        exact = [sum(int(v) * query.get(int(t), 0) for t, v in zip(*r)) for r in rows]
        for node, bound in enumerate(tree.bounds(terms, counts)):
            assert max(exact[i] for i in below[node]) <= bound
        best = lexical.Best(5)
        visited += lexical.search(tree, np.zeros(600, bool), np.arange(600), terms, counts, best)
        assert best.ids.tolist() == sorted((i for i in range(600) if exact[i]), key=lambda i: (-exact[i], i))[:5]
    assert visited < 0.7 * len(centres) * sum(x is not None for x in tree.leaves)


# --- SimHash --------------------------------------------------------------------------

def _brute_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    runs = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _reached(nodes, near):
    """The smallest node reachable from each."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_fingerprints_and_components_match_brute_force(spark):
    texts = _texts(60, 2)
    long = " ".join(f"t{i}" for i in range(2000))
    texts += [long, long.replace("t77 ", "other "), long + " end", texts[0].upper(), "", None, " \t", "one", "One two", "a b c", "é b\x0bc\x0cd", "x" * 4000]
    rows = [(i, t, 1, "c", 0.0) for i, t in enumerate(texts)] + [(None, texts[1], 1, "c", 0.0), (5, texts[6], 1, "c", 0.0), (0, texts[0], 1, "c", 0.0)]
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()), key=str)
    prints = [(d, _brute_print(t)) for d, t, *_ in rows]
    named = [(d, p) for d, p in prints if d is not None]
    near = [(a, b) for a, p in named for b, q in named if (p ^ q).bit_count() <= 2]
    low = _reached({d for d, _ in named}, near)
    assert got == sorted([(d, f"{p:016x}", low.get(d)) for d, p in prints], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("distance, hot", [(0, 4), (1, 4), (2, 4), (2, 1000)])
def test_links_connect_all_near_fingerprints_and_no_others(spark, distance, hot):
    """Families around centres, so that some chains' buckets exceed ``hot``."""
    rng = np.random.default_rng(distance)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(6):
        centre = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(40):
            x = centre
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "id long, print long")
    edges = [tuple(e) for e in simhash.links(df, distance, hot).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= distance for a, b in edges)
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= distance]
    assert _reached(prints, edges) == _reached(prints, near)
    if hot > 100:
        assert set(edges) == set(near)


def test_words_are_the_same_when_a_text_is_cut(monkeypatch):
    text = ("One two\nthree  four \t" * 40 + "y" * 90 + " é z").encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 11)
    monkeypatch.setattr(simhash, "COUNTED", 5)
    assert simhash.fingerprint(text) == whole == _brute_print(text.decode())


# --- hard negatives --------------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<double>, row string, score double"


def _vectors(n=260, width=13):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=width)
    x = rng.normal(size=(n, width)) * 0.4 + centre
    x[30:50] = x[10]  # ties, of several labels
    rows = [(i, int(i % 3 if i % 2 else 0), [float(v) for v in r], "r", 1.0) for i, r in enumerate(x)]
    rows += [rows[20], rows[21], (20, 1, rows[40][2], "again", 0.0)]  # equal rows, and an id of two vectors
    rows += [(300, 0, None, "", 0.0), (310, 0, [float("inf")] * width, "", 0.0), (320, 1, [None] * width, "", 0.0), (330, None, [1.0] * width, "", 0.0),
             (None, 1, [1.0] * width, "", 0.0), (340, 1, [], "", 0.0), (350, 2, [1.0, 2.0], "", 0.0), (360, 9, [0.5] * width, "", 0.0), (370, 0, [-9.0] * width, "", 0.0)]
    return rows


def _brute_negatives(rows, anchors, positives=5, k=5):
    held = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v, *_ in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, l, v) in enumerate(held):
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for n, (j, m, w) in enumerate(held) if n != at)
        for s, j, m in [x for x in scored if x[2] == l][:positives]:
            fits = [x for x in scored if x[2] != l and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [(8192, 256), (40, 3)])
def test_negatives_match_brute_force(spark, block):
    rows = _vectors()
    got = negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 10 == 0, candidates=block[0], anchor_block=block[1])
    assert sorted(map(tuple, got.collect())) == _brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(got.columns) == 6


def test_negatives_of_empty_tables_and_without_anchors(spark):
    df = spark.createDataFrame(_vectors(60)[:40], VECTORS)
    assert negatives.mine(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.mine(df, F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("high", [3, 200, 2**31, 2**62, 2**70])
def test_lookups_give_exact_products(high):
    rng = np.random.default_rng(1)
    draw = lambda n: [int(rng.integers(-2**30, 2**30)) * high // 2**30 for _ in range(n)]
    vectors = [draw(n) for n in (16, 16, 13, 0, 1, 8)] + [[0] * 16, [-1] * 16, [high, -high]]
    packed = [negatives.planes(v) for v in vectors]
    table = negatives.Candidates(np.array([b for b, _ in packed]), [p for _, p in packed])
    for (bits, data), v in zip(packed, vectors):
        assert negatives.whole(bits, data, object).tolist()[:len(v)] == v
        assert [int(s) for s in table.scores(bits, data)] == [sum(a * b for a, b in zip(v, w)) for w in vectors]
