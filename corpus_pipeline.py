"""Documents to packed training sequences: toxicity, near-duplicates, private
data, mixing by source, packing. Each stage is one operator of
``reviewlab.llm`` and works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.llm import minhash, mixing, packing, pii, toxicity
from reviewlab.llm.common import documents, free_name, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5, by a model fitted to the labels of
    the documents at hand."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs.columns, "_toxicity")
    return toxicity.score(docs, model, out=score).filter(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, 0.8."""
    return minhash.keep_one(docs, width=5, percent=80)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets."""
    return pii.replace(docs, pii.EXAMPLE_KEY).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    mixed = mixing.mix(docs, out_prefix=prefix).filter(F.col(f"{prefix}copies") > 0)
    copies = F.explode(F.sequence(F.lit(1), F.col(f"{prefix}copies"))).alias(f"{prefix}copy")
    return mixed.select(*docs.columns, copies).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, packing.vocabulary(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("pii", replace_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted model, hashing and a tokenizer have no SQL form; tests/llm holds the operators against
#: brute force one by one, and of the whole checks columns, ids and a row count.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
