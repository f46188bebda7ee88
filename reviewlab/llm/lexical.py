"""Ranked lexical search: document vectors in ball trees, searched best first by
centroid and radius, with exact integer scores at the leaves."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.llm.common import documents, stored, text_chunks

#: Terms of the items that are searched together, about: their (item, term) pairs. An item is never split.
PAIRS = 16_384
#: Documents of a tree, and of a leaf; the numbers that a tree's centroids hold.
BLOCK, LEAF, CELLS = 2048, 32, 1 << 21
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20

#: A-Z as a-z, all other ASCII but letters and digits as a space; bytes above ASCII belong to terms.
FOLD = bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a text, which is cut at spaces into pieces."""
    folded, at, counts = text.translate(FOLD), 0, Counter()
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


# --- terms of items and documents ---------------------------------------------------

def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches):
        rows = [(i, t, n) for i, text in zip(batch.column(0).to_pylist(), texts, strict=True) for t, n in term_counts(text).items()]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()), strict=True)],
                                         ["item_id", "term", "n"])


def _document_rows(place: dict[bytes, int]):
    """doc_id, all terms counted, and those of ``place`` with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            sizes, terms, counts = [], [], []
            for text in texts:
                found = term_counts(text)
                held = sorted((place[t], n) for t, n in found.items() if t in place)
                sizes.append(found.total())
                terms.append([t for t, _ in held])
                counts.append([n for _, n in held])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "counts"])
    return run


# --- the tree ------------------------------------------------------------------------

class Rows:
    """Sparse rows: row i holds terms and values from begin[i] to begin[i + 1], one at least."""

    def __init__(self, begin: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.begin, self.term, self.value = begin, term, value

    def __len__(self) -> int:
        return len(self.begin) - 1

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.begin)[rows]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(begin[-1]) + np.repeat(self.begin[rows] - begin[:-1], sizes)
        return Rows(begin, self.term[at], self.value[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Inner products of all rows with a dense vector, in its numbers."""
        return np.add.reduceat(self.value.astype(dense.dtype, copy=False) * dense[self.term], self.begin[:-1])

    def dense(self, row: int, width: int) -> np.ndarray:
        out, at = np.zeros(width), slice(self.begin[row], self.begin[row + 1])
        out[self.term[at]] = self.value[at]
        return out


class Tree:
    """A ball tree. Node i has a centroid, a radius, and two children or, as
    a leaf, the numbers of its rows and the rows themselves.

    Radii are rounded up: each sum of n products is off by n units in the last
    place of the sum of its terms at most, and all terms here are above zero."""

    def __init__(self, rows: Rows, width: int, leaf: int = LEAF):
        leaf = max(leaf, -(-2 * len(rows) * width // CELLS))
        self.width, self.radii, self.children, self.leaves, centroids = width, [], [], [], []
        self.unit = (width + int(np.diff(rows.begin).max()) + 64) * 2.0**-51
        norms = np.add.reduceat(rows.value.astype(float)**2, rows.begin[:-1])
        stack = [(np.arange(len(rows)), rows, norms, -1)]
        while stack:
            at, own, norm, parent = stack.pop()
            node = len(centroids)
            centre = np.bincount(own.term, weights=own.value, minlength=width) / len(own)
            square, dot = centre @ centre, own.dot(centre)
            far = norm - 2 * dot + square
            centroids.append(centre)
            self.radii.append(math.sqrt(max(0.0, float((far + self.unit * (norm + 2 * dot + square)).max()))) * (1 + self.unit))
            self.children.append([])
            self.leaves.append(None)
            if parent >= 0:
                self.children[parent].append(node)
            sides = self._split(own, norm, far) if len(own) > leaf else None
            if sides is None:
                self.leaves[node] = (at, own)
            else:
                stack += [(at[s], own.take(np.flatnonzero(s)), norm[s], node) for s in (sides, ~sides)]
        self.centroids = np.array(centroids)
        self.radii = np.array(self.radii)

    def _split(self, rows: Rows, norm: np.ndarray, far: np.ndarray) -> np.ndarray | None:
        """Which of two distant rows each row is nearer to; None if all are the same."""
        a = int(far.argmax())
        from_a = norm + norm[a] - 2 * rows.dot(rows.dense(a, self.width))
        b = int(from_a.argmax())
        if from_a[b] <= self.unit * norm.max():
            return None
        lean = from_a - (norm + norm[b] - 2 * rows.dot(rows.dense(b, self.width)))
        side = lean <= 0
        if not len(rows) <= 16 * side.sum() <= 15 * len(rows):  # a few far rows would make a deep tree
            side = np.zeros(len(rows), bool)
            side[np.argsort(lean, kind="stable")[:len(rows) // 2]] = True
        return side

    def bounds(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each node a whole number that no row below it exceeds: q.c + |q| r, rounded up."""
        size = math.sqrt(float((counts.astype(float)**2).sum()))
        upper = self.centroids[:, terms] @ counts.astype(float) + size * self.radii
        return np.floor(upper * (1 + self.unit)) + 1


class Best:
    """The k best (score, row's id) of an item so far, ties to smaller ids, null last."""

    def __init__(self, k: int):
        self.k, self.scores, self.none, self.ids = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """Scores below it cannot enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        enter = scores >= self.least
        if enter.any():
            scores, none, ids = (np.concatenate([a, b[enter]]) for a, b in ((self.scores, scores), (self.none, none), (self.ids, ids)))
            order = np.lexsort((ids, none, -scores))[:self.k]
            self.scores, self.none, self.ids = scores[order], none[order], ids[order]


def search(tree: Tree, none: np.ndarray, ids: np.ndarray, terms: np.ndarray, counts: np.ndarray, best: Best) -> int:
    """Offers ``best`` all rows that can enter; the number of leaves visited."""
    bounds = tree.bounds(terms, counts).tolist()
    query = np.zeros(tree.width, np.int64)
    query[terms] = counts
    heap, visited = [(-bounds[0], 0)], 0
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < best.least:
            break
        if tree.leaves[node] is None:
            for child in tree.children[node]:
                heapq.heappush(heap, (-bounds[child], child))
        else:
            at, rows = tree.leaves[node]
            visited += 1
            best.offer(rows.dot(query), none[at], ids[at])
    return visited


# --- the operator ----------------------------------------------------------------------

def term_weight(total: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * holding + 1)))


def _values(weights: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, per_row: np.ndarray, total: int, length: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 12 m)) for each term of each row, in 64 bits."""
    m = np.array([75 + 25 * n * total // length for n in sizes.tolist()], np.int64)
    return weights[terms] * (10**9 * counts // (1000 * counts + 12 * np.repeat(m, per_row)))


def _searched(items: list[tuple[int, list[int], list[int]]], weights: np.ndarray, total: int, length: int, k: int):
    """Each task's k best rows of each item. The task's rows are put into
    trees block by block; what is found in one block prunes the next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        asked = [(np.array(t), np.array(n, np.int64)) for _, t, n in items]
        held: list[tuple] = []

        def flush():
            none, ids, per_row, term, value = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            tree = Tree(Rows(np.concatenate([[0], np.cumsum(per_row)]), term, value), len(weights))
            for (terms, counts), b in zip(asked, best, strict=True):
                search(tree, none, ids, terms, counts, b)

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                per_row = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                term, counts = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                value = _values(weights, term, counts, part.column(1).to_numpy(), per_row, total, length)
                none = part.column(0).is_null().to_numpy(zero_copy_only=False)
                held.append((none, part.column(0).fill_null(0).to_numpy(), per_row, term, value))
                if sum(len(h[0]) for h in held) >= BLOCK:
                    flush()
        if held:
            flush()
        for (item, _, _), b in zip(items, best, strict=True):
            if len(b.ids):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(b.ids), pa.int64()), pa.array(b.ids, mask=b.none), pa.array(b.scores)],
                                                 ["item_id", "doc_id", "score"])
    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the ``k`` documents of the
    highest score above 0, ties to the smaller doc_id.

    Items are searched in blocks of about ``pairs`` (item, term) pairs, which
    alone are sent to the tasks. For a block, each document's counts of the
    block's terms are written once: other terms add nothing to its items'
    scores. From their totals each document becomes a sparse vector whose
    inner product with an item's counts is the score. Each task puts its
    vectors into ball trees and gives its ``k`` best of each item; a subtree is
    left out only if its bound, rounded up, lies below a score that already
    holds the last place. No rows are exchanged but those.

    A null or empty text has no terms, is not found and finds nothing. Each row
    of ``docs`` is a document; equal doc_ids tie, and a null one comes last
    among equal scores. Rows with one item_id are one item of several texts;
    items without an id take no part. Other columns are not read. Without
    documents or items there are no rows.
    """
    spark = docs.sparkSession
    asked = stored(items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL")
                   .mapInArrow(_item_rows, "item_id long, term binary, n long")
                   .groupBy("item_id", "term").agg(F.sum("n").alias("n")), "lexical-items")
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    blocks = -(-asked.count() // pairs)
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        place = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in rows}))}
        own: dict[int, dict[int, int]] = {}
        for r in rows:
            own.setdefault(r.item_id, {})[place[bytes(r.term)]] = r.n
        counted = stored(docs.select("doc_id", "text").mapInArrow(_document_rows(place), "doc_id long, n long, terms array<int>, counts array<long>"), "lexical-terms")
        total, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = dict(map(tuple, counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()))
        weights = np.array([term_weight(total, holding.get(t, 0)) for t in range(len(place))], np.int64)
        block_items = [(i, sorted(c), [c[t] for t in sorted(c)]) for i, c in sorted(own.items())]
        found = found.unionByName(stored(counted.filter(F.size("terms") > 0).mapInArrow(_searched(block_items, weights, total, length, k), "item_id long, doc_id long, score long"), "lexical-best"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), s AS (
  SELECT count(*)::BIGINT AS big_n, sum(len(t))::BIGINT AS big_l FROM d WHERE len(t) > 0
), tf AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, s GROUP BY term
), q AS (
  SELECT item_id, term, count(*)::BIGINT AS n
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE item_id IS NOT NULL)
  GROUP BY ALL
), scored AS (
  SELECT item_id, r, doc_id,
         sum(q.n * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * tf.n * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
