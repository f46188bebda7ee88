"""Quality classifier: perplexity under a Kneser-Ney model of trusted text,
with thresholds by language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm import lm
from reviewlab.llm.common import documents, stored
from reviewlab.session import scratch_path

#: One in ``HELD`` trusted documents, by a hash of doc_id, sets the thresholds and is not learnt from.
HELD = 4
#: The share of trusted text that a threshold lets through.
QUANTILE = 0.97


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id first) whose doc_id is in ``ids``: a semi
    join that moves no texts. Ids lie in the shared folder as sorted arrays of
    ranges, which workers map into memory."""
    base = scratch_path(docs.sparkSession, "quality-ids")
    ids = stored(ids.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct(), "quality-chosen")

    def id_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if parts:
            table = np.sort(np.concatenate(parts))
            yield pa.RecordBatch.from_pylist([{"first": int(table[0]), "path": lm.save(f"{base}/ids", table)}])

    ranges = ids.repartitionByRange(max(1, -(-ids.count() // lm.FILE_IDS)), "doc_id")
    files = sorted((r["first"], r["path"]) for r in ranges.mapInArrow(id_files, "first long, path string").collect())  # one row a file
    firsts = np.array([f for f, _ in files], np.int64)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0).cast(pa.int64())
            values, hit = pc.fill_null(column, 0).to_numpy(), np.zeros(b.num_rows, bool)
            file = np.searchsorted(firsts, values, side="right") - 1
            for f in np.unique(file[file >= 0]):
                at, table = np.flatnonzero(file == f), lm.load(files[f][1])
                hit[at] = table[np.minimum(np.searchsorted(table, values[at]), len(table) - 1)] == values[at]
            yield b.filter(pa.array(hit & column.is_valid().to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(kept, docs.schema)


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``docs`` with n_tokens, perplexity, threshold and keep (perplexity at most the threshold).

    ``trusted`` holds the doc_ids of trusted documents. The model is counted
    on three quarters of them, whatever their number; all the rest, by
    language, gives the quantile that is the threshold. A language without
    held-out text, a null one included, takes the threshold over all; without
    trusted text at all every document is kept. A null or empty text is
    scored as an end alone. Other columns stay; those named like a result are
    replaced.
    """
    docs = docs.drop("n_tokens", "n_known", "base_score", "score", "perplexity", "threshold", "keep")
    sample = stored(with_ids(docs.select("doc_id", "text", "lang"), trusted), "quality-trusted")
    held = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(HELD)) == 0
    model = lm.train(sample.filter(~held), "quality")
    scored = lm.score(docs, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).drop("n_known", "base_score", "score")
    measured = stored(lm.score(sample.filter(held).select("lang", "text"), model)
                      .select("lang", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")), "quality-held")
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("own")
    everywhere = measured.agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))).first()[0]
    languages = stored(measured.filter("lang IS NOT NULL").groupBy(F.col("lang").alias("_lang")).agg(cut), "quality-languages")
    out = scored.join(languages, F.col("lang") == F.col("_lang"), "left")
    out = out.withColumn("threshold", F.coalesce("own", F.lit(everywhere).cast("double")))
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).drop("_lang", "own")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = classify(documents(spark, sf_dir).select("doc_id", "text", "lang"), labels.filter("quality = 1"))
    return out.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", "keep")
