"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.llm.common import NOT_ALNUM, combine, documents, remainder, text_chunks, word_hashes

#: Width of the hash table, and with it of what is broadcast.
BITS = 20
#: Labelled rows that a fit uses at most, the first by a hash of doc_id.
MAX_ROWS = 24_000
#: Parts of the sample that are fitted side by side and averaged. Averaging
#: weakens rare features, so one part while the sample fits a task.
SHARDS = 1
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 6.0, 0.1, 4


def features(texts: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    """Each text's distinct hashed words, pairs of neighbours, and pairs with one word between."""
    hashes, begins = word_hashes(texts, NOT_ALNUM)
    shift = np.uint64(64 - bits)
    one = hashes >> shift
    two = combine([hashes[:-1], hashes[1:]], salt=2) >> shift
    skip = combine([hashes[:-2], hashes[2:]], salt=3) >> shift
    return [np.unique(np.concatenate([one[a:b], two[a:max(a, b - 1)], skip[a:max(a, b - 2)]])).astype(np.int32)
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]


def ftrl(rows: list[np.ndarray], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> tuple[float, np.ndarray]:
    """Intercept and weights. Rates are per coordinate; L1 holds a weight at 0
    until its gradients sum to more than ``L1``."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    positives = sum(labels)
    prior = (positives + 0.1) / (len(labels) + 1)
    bias, bias_n = float(np.log(prior / (1 - prior))), 0.0

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / ALPHA * w
            n[at] = squared
            bias_n += g * g
            bias -= 0.05 / (1 + np.sqrt(bias_n)) * g
    return bias, weights(np.arange(1 << bits))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, shards: int = SHARDS) -> dict[str, np.ndarray]:
    """Sparse weights from labels (doc_id, toxic 0/1) and the documents' texts.

    At most ``max_rows`` labelled documents are used, so the join is with a
    broadcast table of that size, each shard has about max_rows / shards rows
    of features, made where the texts are read, and the weights have 2**BITS
    entries at most. Null labels are left out; a document with both labels
    counts as toxic; equal texts in a shard count once. Without usable rows
    the weights are empty and the intercept stands for a rate below one half.
    """
    chosen = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    text = F.coalesce("text", F.lit(""))
    rows = (docs.select(F.col("doc_id").cast("long"), F.md5(text).alias("digest"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "digest", "y", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            made = [f.tobytes() for f in features(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.binary())], ["doc_id", "digest", "y", "shard", "features"])

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "digest"]).drop_duplicates("digest")
        part = part.iloc[np.random.default_rng(5).permutation(len(part))]
        bias, w = ftrl([np.frombuffer(f, np.int32) for f in part["features"]], part["y"].tolist())
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": np.append(at, -1), "weight": np.append(w[at], bias)})

    fitted = rows.mapInArrow(featured, "doc_id long, digest string, y int, shard int, features binary").groupBy("shard").applyInPandas(train, "feature long, weight double")
    shared = fitted.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect()
    found = max([r["n"] for r in shared if r["feature"] == -1], default=1)
    return {"feature": np.array([r["feature"] for r in shared], np.int64),
            "weight": np.array([r["weight"] / found for r in shared], np.float64)}


def score(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the probability of label 1, from whole
    texts. Null and empty texts get the intercept's. Other columns stay; one
    named ``out`` is replaced."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = shared.value["feature"], shared.value["weight"]
        dense = np.zeros(1 << BITS)
        dense[at[at >= 0]] = weight[at >= 0]
        bias = weight[at < 0].sum() if (at < 0).any() else np.log(0.1 / 0.9)
        for batch, texts in text_chunks(batches, text):
            logits = np.array([bias + dense[f].sum() for f in features(texts)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))))], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
