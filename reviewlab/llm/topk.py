"""Exact top-k by integer inner product: term-at-a-time accumulation over postings, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.llm.common import stored

#: Candidates and queries of a block; their product is the scores a task holds.
CANDIDATES, QUERIES = 8192, 256
LONG = np.iinfo(np.int64)


def valid(vector: str) -> Column:
    """True for a vector without null, NaN or infinite components."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def scores(queries: list[np.ndarray], candidates: list[np.ndarray]) -> np.ndarray:
    """Scores of all queries against all candidates.

    Each term (component number) has a posting: the candidates in which it is
    not 0 and their weights. Term by term, a query that has it adds its
    weight times the posting's to its row of scores. Numbers that could leave
    64 bits are added up as Python's."""
    width = max([len(v) for v in (*queries, *candidates)], default=0)
    largest = [max([int(np.abs(v.astype(object)).max()) for v in vs if len(v)], default=0) for vs in (queries, candidates)]
    kind = np.int64 if largest[0] * largest[1] * max(width, 1) <= LONG.max else object
    out = np.zeros((len(queries), len(candidates)), kind)
    table = [np.zeros((len(vs), width), kind) for vs in (queries, candidates)]
    for rows, vs in zip(table, (queries, candidates), strict=True):
        for row, v in zip(rows, vs, strict=True):
            row[:len(v)] = v
    for term in range(width):
        weight = table[1][:, term]
        posting = np.flatnonzero(weight)
        held = weight[posting]
        for q in np.flatnonzero(table[0][:, term]):
            if len(posting) == len(weight):  # a posting of all rows needs no scatter
                out[q] += table[0][q, term] * held
            else:
                out[q, posting] += table[0][q, term] * held
    return out


def best(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values, ties to smaller ids: a partition, then a sort of what reaches the k-th."""
    if len(values) > k:
        edge = np.partition(values, len(values) - k)[len(values) - k]
        at = np.flatnonzero(values >= edge)
    else:
        at = np.arange(len(values))
    return at[np.lexsort((ids[at], -values[at]))][:k]


def _block(k: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["query"].to_numpy()
        ask, offer = part[asks], part[~asks]
        ids, rows, out = offer["id"].to_numpy(), offer["row"].to_numpy(), []
        weights = [np.asarray(v) for v in offer["vector"]]
        for at in range(0, len(ask), 64):
            some = ask.iloc[at:at + 64]
            for at_row, query, row in zip(some["row"], some["id"], scores([np.asarray(v) for v in some["vector"]], weights), strict=True):
                own = rows != at_row
                top = best(row[own], ids[own], k)
                out += [(at_row, query, i, int(np.clip(int(s), LONG.min, LONG.max))) for i, s in zip(ids[own][top], row[own][top], strict=True)]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"]).astype("int64")
    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id: str = "vec_id", vector: str = "embedding",
          candidates: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that ``queries`` marks, the
    ``k`` other rows with the highest integer inner product of floor(scale *
    component), ties to the smaller id.

    Candidates and queries fall into blocks of bounded size by a hash of the
    id; a task scores one block of queries against one of candidates and
    leaves k rows a query, which are merged by rank.

    Vectors that are null or hold a null, NaN or infinite component take no
    part, nor do rows without an id; an empty vector scores 0, and a shorter
    one counts as filled with 0. Each row is a row of its own, also where ids
    repeat: others of its id are candidates, and a query given twice is answered twice. With fewer than k candidates all are given. Scores
    beyond 64 bits are held at the limit. Other columns are not read.
    """
    rows = (vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
            .filter(F.col("id").isNotNull() & valid("v")))
    # stored, so that the keys are the same whenever they are read
    whole = stored(rows.select("row", "id", "asks", F.transform("v", lambda x: F.floor(x * scale)).alias("vector")), "topk-rows")
    total, asking = whole.agg(F.count("*"), F.count_if("asks")).first()
    n, q = -(-max(total, 1) // candidates), -(-max(asking, 1) // query_block)
    mine = F.xxhash64("row")
    offered = whole.select("row", "id", "vector", F.lit(False).alias("query"), F.pmod(mine, F.lit(n)).alias("c"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q - 1).cast("long"))).alias("q"))
    asked = whole.filter("asks").select("row", "id", "vector", F.lit(True).alias("query"),
                                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("c"),
                                        F.pmod(F.shiftright(mine, 20), F.lit(q)).alias("q"))
    found = stored(offered.unionByName(asked.select(*offered.columns)).groupBy("c", "q")
                   .applyInPandas(_block(k), "row long, query_id long, vec_id long, score long"), "topk")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id,
         coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r
), r AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
