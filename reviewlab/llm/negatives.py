"""Hard negatives by exact integer scores: an anchor's subset sums for groups of
eight dimensions, looked up by the candidates' bit planes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.llm.common import stored
from reviewlab.llm.topk import best, valid

#: Candidates and anchors of a block.
CANDIDATES, ANCHORS = 8192, 256
LONG = np.iinfo(np.int64)


# --- bit planes and tables -----------------------------------------------------------

def planes(vector: list[int]) -> tuple[int, bytes]:
    """How many bits the numbers need with their sign, and the bits: plane by
    plane from the lowest, each dimension a bit, eight dimensions a byte."""
    bits = 1 + max([(v if v >= 0 else ~v).bit_length() for v in vector], default=0)
    if bits <= 64:
        shifted = np.array(vector, np.int64)[None, :] >> np.arange(bits)[:, None]
        table = (shifted & 1).astype(np.uint8)
    else:
        table = np.array([[v >> b & 1 for v in vector] for b in range(bits)], np.uint8)
    return bits, np.packbits(table, axis=1, bitorder="little").tobytes()


def whole(bits: int, packed: bytes, kind=np.int64) -> np.ndarray:
    """The numbers again, with zeros up to a whole byte of dimensions."""
    table = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(bits, -1), axis=1, bitorder="little").astype(kind)
    return sum(table[b] * _weight(b, bits) for b in range(bits)).astype(kind)


def _weight(plane: int, bits: int) -> int:
    """What a bit of a plane counts: the highest one is the sign's."""
    return -(1 << plane) if plane == bits - 1 else 1 << plane


def tables(anchor: np.ndarray) -> np.ndarray:
    """For each eight dimensions the sums of all 256 subsets of the anchor's numbers."""
    groups = anchor.reshape(-1, 8)
    out = np.zeros((len(groups), 1), anchor.dtype)
    for d in range(8):  # each number doubles the subsets
        out = np.concatenate([out, out + groups[:, d:d + 1]], axis=1)
    return out


class Candidates:
    """Packed vectors of equal shape stand together, one array of bytes for each plane and group."""

    def __init__(self, bits: np.ndarray, packed: list[bytes]):
        self.count, self.parts = len(packed), []
        shapes: dict[tuple[int, int], list[int]] = {}
        for i, (b, p) in enumerate(zip(bits.tolist(), packed, strict=True)):
            shapes.setdefault((b, len(p) // b), []).append(i)
        for (b, groups), at in shapes.items():
            table = np.frombuffer(b"".join([packed[i] for i in at]), np.uint8).reshape(len(at), b, groups)
            self.parts.append((np.array(at), b, groups, np.ascontiguousarray(table.transpose(1, 2, 0))))

    def scores(self, bits: int, packed: bytes) -> np.ndarray:
        """Inner products of one vector with all candidates: for each plane
        the looked-up sums of all groups, shifted by the plane's place. In 64
        bits where no sum can leave them, else in Python's numbers."""
        groups = len(packed) // bits
        widest = max((b for _, b, _, _ in self.parts), default=1)
        kind = np.int64 if bits + widest + (8 * groups).bit_length() <= 62 else object
        table = tables(whole(bits, packed, kind)) if groups else np.zeros((0, 256), kind)
        out = np.zeros(self.count, kind)
        for at, b, own, codes in self.parts:
            total = np.zeros(len(at), kind)
            for plane in range(b):
                found = np.zeros(len(at), kind)
                for g in range(min(own, groups)):  # beyond the shorter vector all is zero
                    found += table[g].take(codes[plane, g])
                total += found * _weight(plane, b)
            out[at] = total
        return out


def _floor(x: float, scale: int) -> int:
    scaled = scale * x
    return math.floor(scaled) if math.isfinite(scaled) else scale * int(x)


def _packed(scale: int):
    """row, id, label, asks, bits, packed from row, id, label, asks, vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [planes([_floor(x, scale) for x in v]) for v in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([b for b, _ in made], pa.int32()), pa.array([p for _, p in made], pa.binary())],
                                             ["row", "id", "label", "asks", "bits", "packed"])
    return run


def _held(scores: np.ndarray) -> np.ndarray:
    return scores if scores.dtype == np.int64 else np.array([min(max(int(s), LONG.min), LONG.max) for s in scores], np.int64)


def _parts(part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, Candidates]:
    asks = part["asked"].to_numpy(bool)
    offer = part[~asks]
    return part[asks], offer, Candidates(offer["bits"].to_numpy(), offer["packed"].tolist())


def _positives(k: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        ask, offer, table = _parts(part)
        rows, ids, out = offer["row"].to_numpy(), offer["id"].to_numpy(), []
        for a in ask.itertuples():
            scores, other = _held(table.scores(a.bits, a.packed)), rows != a.row
            top = best(scores[other], ids[other], k)
            out += [(a.row, i, s) for i, s in zip(ids[other][top].tolist(), scores[other][top].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["row", "positive_id", "positive_score"]).astype("int64")
    return run


def _negatives(k: int, percent: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        ask, offer, table = _parts(part)
        ids, labels, out = offer["id"].to_numpy(), offer["label"].to_numpy(), []
        for a in ask.itertuples():
            scores, other = _held(table.scores(a.bits, a.packed)), labels != a.label
            for p in a.positives:
                positive, high = int(p["positive_id"]), int(p["positive_score"])
                low = -(-percent * high // 100)  # the least score with 100 * score >= percent * high
                fits = np.flatnonzero(other & (scores >= low) & (scores <= high))
                top = fits[best(scores[fits], ids[fits], k)]
                out += [(a.row, a.id, int(p["place"]), positive, high, i, s) for i, s in zip(ids[top].tolist(), scores[top].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]).astype("int64")
    return run


# --- the operator ----------------------------------------------------------------------

def _count(n: Column, block: int) -> Column:
    return F.greatest(F.ceil(n / block), F.lit(1)).cast("long")


def _met(offered: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Each block of candidates with each block of anchors; both have their numbers of
    blocks as n and q."""
    mine = F.xxhash64("row")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = offered.withColumn("c", F.pmod(mine, F.col("n"))).withColumn("b", every("q")).withColumn("asked", F.lit(False))
    right = asked.withColumn("b", F.pmod(F.shiftright(mine, 20), F.col("q"))).withColumn("c", every("n")).withColumn("asked", F.lit(True))
    return left.drop("n", "q").unionByName(right.drop("n", "q"), allowMissingColumns=True).groupBy(*keys, "c", "b")


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, k: int = 5, percent: int = 80, scale: int = 256,
         id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
         candidates: int = CANDIDATES, anchor_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for each row that ``anchors`` marks and each of its
    ``positives`` best other rows of its label, the ``k`` best rows of other
    labels whose score is at most the positive's and at least ``percent`` of it.

    A score is the inner product of floor(scale * component); ties go to the
    smaller id. Blocks of candidates meet blocks of anchors, within a label
    for the positives and over all rows for the negatives; each task leaves
    at most k rows for an anchor (and positive), which are merged by rank. A
    label that most rows have is only more blocks.

    Rows with a null label, null id, null vector or a null, NaN or infinite
    component take no part. A shorter vector counts as filled with 0, an empty
    one scores 0. Each row is a row of its own, also where ids repeat: the
    others of its id are candidates, and an anchor given twice is mined twice.
    Scores beyond 64 bits are held at the limit. Other columns are not read.
    """
    label = F.col(label) if isinstance(label, str) else label
    read = (vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), label.cast("long").alias("label"),
                           F.coalesce(anchors, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("v"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & valid("v")))
    rows = stored(read.mapInArrow(_packed(scale), "row long, id long, label long, asks boolean, bits int, packed binary"), "negatives")
    sizes = rows.groupBy("label").agg(_count(F.count("*"), candidates).alias("n"), F.count_if("asks").alias("asking")).filter("asking > 0")
    sizes = stored(sizes.select("label", "n", _count(F.col("asking"), anchor_block).alias("q")), "negatives-labels")
    within = rows.join(sizes, "label")
    alike = stored(_met(within.drop("asks"), within.filter("asks").drop("asks"), ["label"])
                   .applyInPandas(_positives(positives), "row long, positive_id long, positive_score long"), "negatives-positives")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = (alike.withColumn("place", place).filter(F.col("place") <= positives)
              .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives")))
    asked = stored(rows.filter("asks").drop("asks").join(chosen, "row"), "negatives-anchors")
    n, q = _count(F.lit(rows.count()), candidates), _count(F.lit(asked.count()), anchor_block)
    found = stored(_met(rows.drop("asks").withColumn("n", n).withColumn("q", q), asked.withColumn("n", n).withColumn("q", q), [])
                   .applyInPandas(_negatives(k, percent), "row long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"), "negatives-found")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return (found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=noisy)


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS alike,
         coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r
), p AS (
  SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS place FROM s WHERE alike
), n AS (
  SELECT p.ar, p.place, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.ar = s.ar AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score
  WHERE p.place <= 5
), r AS (
  SELECT *, row_number() OVER (PARTITION BY ar, place ORDER BY negative_score DESC, negative_id)::INTEGER AS rank FROM n
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""
