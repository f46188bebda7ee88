"""Approximate nearest neighbours: a forest of random-projection trees, searched
through one priority queue, and exact reranking of the leaves' rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.llm.common import stored
from reviewlab.llm.topk import best, valid

#: Vectors on which the trees are grown and the search is set, the first by a hash of their id.
SAMPLE = 8192
TREES, LEAF = 4, 64
#: Of a sample row's true neighbours, the share that the search must reach, for each row asked. On all rows more is found.
RECALL = 0.93
#: Rows of one tree's leaves that a task reranks.
BLOCK = 8192
#: Queries of a block.
QUERIES = 8192


class Forest:
    """Trees as arrays: a split node has a direction, a threshold and two
    children; a child below zero is leaf -1 - child. Grown on a sample and
    broadcast: its size hangs on the sample's alone."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.roots, self.directions, self.thresholds, self.children, self.leaves = [], [], [], [], 0
        self.firsts = []  # each tree's first leaf
        for _ in range(trees):
            self.firsts.append(self.leaves)
            self.roots.append(self._grow(sample, rng, leaf))
        width = sample.shape[1] if sample.ndim == 2 else 0
        self.directions = np.array(self.directions).reshape(len(self.directions), width)
        self.thresholds = np.array(self.thresholds)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, rows: np.ndarray, rng, leaf: int) -> int:
        if len(rows) > leaf:
            for _ in range(3):
                a, b = rows[rng.choice(len(rows), 2, replace=False)]
                norm = np.linalg.norm(a - b)
                if norm > 0:
                    direction = (a - b) / norm
                    side = rows @ direction
                    threshold = float(np.median(side))
                    if 0 < (side > threshold).sum() < len(rows):
                        node = len(self.directions)
                        self.directions.append(direction)
                        self.thresholds.append(threshold)
                        self.children.append(None)
                        self.children[node] = (self._grow(rows[side <= threshold], rng, leaf), self._grow(rows[side > threshold], rng, leaf))
                        return node
        self.leaves += 1
        return -self.leaves

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(rows), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(rows), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                nodes = at[inner]
                side = np.einsum("ij,ij->i", rows[inner], self.directions[nodes]) > self.thresholds[nodes]
                at[inner] = self.children[nodes, side.astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, query: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves of all trees from one queue, by the
        smallest margin on the way to a leaf."""
        side = (self.directions @ query - self.thresholds if len(self.thresholds) else self.thresholds).tolist()
        children = self.children.tolist()
        queue = [(-np.inf, i, root) for i, root in enumerate(self.roots)]
        heapq.heapify(queue)
        out, n = [], len(queue)
        while queue and len(out) < visits:
            cost, _, node = heapq.heappop(queue)
            while node >= 0:
                margin, (low, high) = side[node], children[node]
                near, far = (high, low) if margin > 0 else (low, high)
                heapq.heappush(queue, (max(cost, abs(margin)), n, far))
                n += 1
                node = near
            out.append(-1 - node)
        return out


def inner(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products added up the same way for each pair, so that equal rows tie."""
    return (queries * rows).sum(axis=-1)


def calibrated(rows: np.ndarray, indexed: np.ndarray, forest: Forest, k: int, recall: float) -> int:
    """The fewest visits with which each of the sample rows asked reaches
    ``recall`` of its ``k`` best in the sample: a floor, not a mean, since a
    mean over the few rows of a small table says little of any one query.
    With more rows a query's best are nearer and fall more often into the
    leaves it sees first."""
    asked = np.arange(0, len(rows), max(1, len(rows) // 256))
    product = rows[asked] @ rows.T
    product[np.arange(len(asked)), asked] = -np.inf
    order = np.argsort(-product, axis=1)[:, :max(0, min(k, len(rows) - 1))]
    least = min(max(1, int(np.ceil(recall * k))), order.shape[1])
    placed, needed = forest.place(indexed), [1]
    for q, true in zip(rows[asked], order, strict=True):
        turn = {leaf: i + 1 for i, leaf in enumerate(forest.search(np.append(q, 0.0), forest.leaves))}
        needed += sorted(min(turn[x] for x in placed[i].tolist()) for i in true)[:least]
    return max(needed)


def floor_of(query: np.ndarray, bits: np.ndarray, rows: np.ndarray, placed: np.ndarray, others: np.ndarray, k: int, slack: float) -> float:
    """A score that the query's ``k`` best cannot fall below: the k-th best of
    the sample rows in the leaves it visits, less the rounding of a sum."""
    met = (rows @ query)[np.logical_or.reduce([bits[x] for x in placed.T]) & others]
    low = np.partition(met, len(met) - k)[len(met) - k] - slack if len(met) >= k else -np.inf
    return float(low) if np.isfinite(low) else -np.inf


def _rerank(k: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["query"].to_numpy()
        rows, ask = part[~asks], part[asks]
        if rows.empty or ask.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, table, leaves = rows["id"].to_numpy(), np.stack(rows["vector"].to_numpy()), np.stack(rows["leaves"].to_numpy())
        own = np.flatnonzero(leaves[0] == int(rows["leaf"].iloc[0]))[0]  # a block's rows are of one tree
        out: tuple[list, list, list] = [], [], []
        for at in range(0, len(ask), 128):
            some = ask.iloc[at:at + 128]
            vectors = np.stack(some["vector"].to_numpy())
            bits = np.ascontiguousarray(np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in some["seen"]]), axis=1).T.astype(bool))
            seen = bits[leaves[:, own]]
            for tree in range(own):  # a row that an earlier tree shows is scored there
                seen &= ~bits[leaves[:, tree]]
            rough = vectors @ table.T
            near = seen.T & (ids[None, :] != some["id"].to_numpy()[:, None]) & (rough >= some["floor"].to_numpy()[:, None])
            for i, query in enumerate(some["id"]):  # exact sums for all that may be among the k
                places = np.flatnonzero(near[i])
                if len(places) > k:
                    close = rough[i, places]
                    edge = np.partition(close, len(close) - k)[len(close) - k]
                    places = places[close >= edge - 1e-9 * (1 + abs(edge))] if np.isfinite(edge) else places[close >= edge]
                exact = inner(vectors[i], table[places])
                top = best(exact, ids[places], k)
                for column, new in zip(out, (np.full(len(top), query), ids[places][top], exact[top]), strict=True):
                    column.append(new)
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})
    return run


def neighbours(vectors: DataFrame, queries: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding",
               sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, block: int = BLOCK,
               query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that ``queries`` marks, the
    ``k`` nearest other rows found, by inner product in double precision,
    ties to the smaller id.

    The trees split vectors lengthened by sqrt(M^2 - |v|^2), M the largest
    norm: among those the largest inner product is the smallest angle. They
    are grown on at most ``sample`` rows, and the number of leaves a search
    visits is set there, by one rule for tables of any size, so that each row
    asked reaches ``recall``; every row is indexed. A leaf's
    rows beyond ``block`` are cut into more blocks, all of which are
    searched, so a leaf of copies has no cap. Queries fall into blocks of
    about ``query_block`` by a hash of the id, and a task meets one block of
    rows and one of queries. Each leaves at most k rows a query, none below
    what the k-th best of the sample rows met promises; a row met in several
    trees is scored in the first.

    Vectors that are null, zero, or hold a null or non-finite component take
    no part, nor do rows without an id or of another length than the most
    frequent one, of equally frequent ones the smallest. Rows with one id are one row; a query's own id is never
    its neighbour. Fewer candidates than k are all given if the search meets
    them, as it does up to ``leaf`` rows. Other columns are not read.
    """
    rows = (vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
            .filter(F.col("id").isNotNull() & valid("vector") & F.exists("vector", lambda x: x != 0)))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = length["n"] if length else 0
    rows = rows.filter(F.size("vector") == width)
    longest = rows.agg(F.max(norm)).first()[0] or 0.0
    hashed = F.xxhash64("id")
    drawn = rows.orderBy(hashed, "id").limit(sample).select("id", "vector", hashed.alias("hash")).collect()  # at most ``sample`` rows
    border = drawn[-1]["hash"] if drawn else 0
    drawn = {r["id"]: r["vector"] for r in drawn}  # a row given twice would be its own neighbour

    def lengthened(table: np.ndarray) -> np.ndarray:
        return np.column_stack([table, np.sqrt(np.maximum(0.0, longest - (table * table).sum(1)))])

    grown = np.array([*drawn.values()], np.float64).reshape(len(drawn), width)
    indexable = lengthened(grown)
    forest = Forest(indexable, trees, leaf)
    visits = calibrated(grown, indexable, forest, k, recall)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(forest)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, width)
            placed = shared.value.place(lengthened(table))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(placed.tolist(), pa.list_(pa.int64()))], ["id", "vector", "asks", "leaves"])

    index = stored(rows.dropDuplicates(["id"])
                   .mapInArrow(indexed, "id long, vector array<double>, asks boolean, leaves array<long>"), "ann-index")
    # the sample as indexed: of rows with one id the index holds one
    known = index.filter(hashed <= border).select("id", "vector", "leaves").collect()  # at most ``sample`` rows
    pilot = spark.sparkContext.broadcast((np.array([r["id"] for r in known], np.int64), np.array([r["vector"] for r in known], np.float64).reshape(len(known), width),
                                          np.array([r["leaves"] for r in known], np.int64).reshape(len(known), trees)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table, placed = pilot.value
        for b in batches:
            found, seen, floors = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                query, bits = np.array(v), np.zeros(shared.value.leaves, bool)
                found.append(shared.value.search(np.append(query, 0.0), visits))
                bits[found[-1]] = True
                seen.append(np.packbits(bits).tobytes())
                floors.append(floor_of(query, bits, table, placed, ids != i, k, 1e-9 * float(np.linalg.norm(query) * np.sqrt(longest))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(seen, pa.binary()), pa.array(floors, pa.float64())],
                                             ["id", "vector", "visits", "seen", "floor"])

    sizes = index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()  # one row a leaf
    # a tree's neighbouring leaves share a block up to its size; a larger leaf has several blocks
    plan, at, held, tree = {}, 0, 0, 0
    for x in sorted(sizes, key=lambda r: r["leaf"]):
        own = int(np.searchsorted(forest.firsts, x["leaf"], side="right"))
        if held and (held + x["count"] > block or own != tree):
            at, held = at + 1, 0
        tree = own
        n = -(-x["count"] // block)
        plan[x["leaf"]] = (at, n)
        held += x["count"]
        if n > 1:
            at, held = at + n, 0
    table = spark.createDataFrame([(int(l), int(a), int(n)) for l, (a, n) in plan.items()], "leaf long, first long, parts long")
    asking_blocks = max(1, -(-index.filter("asks").count() // query_block))
    query_part = F.pmod(F.shiftright(F.xxhash64("id"), 20), F.lit(asking_blocks))
    offered = (index.select("id", "vector", "leaves", F.explode("leaves").alias("leaf")).join(F.broadcast(table), "leaf")
               .select((F.col("first") + F.pmod(F.xxhash64("id"), "parts")).alias("block"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asking_blocks - 1).cast("long"))).alias("part"),
                       F.lit(False).alias("query"), "id", "vector", "leaf", "leaves", F.lit(None).cast("binary").alias("seen"), F.lit(None).cast("double").alias("floor")))
    seeking = stored(index.filter("asks").select("id", "vector")
                     .mapInArrow(searched, "id long, vector array<double>, visits array<long>, seen binary, floor double"), "ann-asked")
    visited = (seeking.select("id", F.explode("visits").alias("leaf")).join(F.broadcast(table), "leaf")
               .select("id", F.explode(F.sequence("first", F.expr("first + parts - 1"))).alias("block")).distinct())
    asking = visited.join(seeking, "id").select(
        "block", query_part.alias("part"), F.lit(True).alias("query"), "id", "vector", F.lit(None).cast("long").alias("leaf"),
        F.lit(None).cast("array<long>").alias("leaves"), "seen", "floor")
    found = stored(offered.unionByName(asking).groupBy("block", "part").applyInPandas(_rerank(k), "query_id long, vec_id long, score double"), "ann-found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank.cast("int"))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def op2_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
