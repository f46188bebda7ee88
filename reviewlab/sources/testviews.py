"""Bindings of the driver's test tables to the review data model.

``documents`` plays the raw reviews (``doc_id -> ID``, ``source -> src``) and
``labels`` gives a three-class label. ``reviews`` decorates each text with a
short Russian phrase chosen by ``doc_id % 16`` so that every marker rule
fires on real rows. ``preds`` and ``scores`` are deterministic prediction
and score tables derived from ``labels``. The same views exist as SQL for
the DuckDB oracle (``reviewlab.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.session import spread

# fixed test phrases, indexed by doc_id % 16
DECORATIONS = [
    "Оценка 8 из 10",
    "Поставлю 2/10, вид 3/5",
    "⭐⭐⭐⭐ за вкус",
    "Это круууто!!!",
    "Почему так???",
    "😊 спасибо 😂",
    "😡 и 😢",
    "Люблю 😍 ✌️",
    "<b>итог</b> ok",
    "смотри https://x.example/a",
    "пиши a.b@x.example",
    "тел +7 999 123-45-67",
    "ОЧЕНЬ ПЛОХО СЕРВИС",
    "ну.... да,,,,",
    "Полный ОТСТОЙ и жесть",
    "не рекомендую фуфел",
]


TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; text tables are spread over the cores when the scan
    yields too few splits for CPU-bound text work."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def label_of(quality: Column, toxic: Column) -> Column:
    """Three classes: toxic -> 0, good quality -> 2, otherwise 1."""
    return (F.when(toxic == 1, F.lit(0)).when(quality == 1, F.lit(2))
            .when(quality == 0, F.lit(1)).cast("int"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ID, text, src, label``; label null where a document has no label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lab = table(spark, sf_dir, "labels").select(
        "doc_id", label_of(F.col("quality"), F.col("toxic")).alias("label"))
    phrase = F.element_at(F.array(*[F.lit(p) for p in DECORATIONS]),
                          (F.col("doc_id") % 16 + 1).cast("int"))
    src = (F.when(F.col("doc_id") % 29 == 0, F.lit(None).cast("string"))
           .when(F.col("doc_id") % 31 == 0, F.lit("  "))
           .otherwise(F.col("source")))
    return (d.join(lab, "doc_id", "left")
            .select(F.col("doc_id").alias("ID"),
                    F.concat(phrase, F.lit(". "), F.col("text")).alias("text"),
                    src.alias("src"), F.col("label")))


def _hash_digit(seed: int, key: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 1)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ID, y_true, y_pred`` with every confusion cell populated."""
    lab = table(spark, sf_dir, "labels")
    y_true = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    h = _hash_digit(7, F.col("doc_id"))
    shift = F.when(h < "2", 1).when(h < "4", 2).otherwise(0)
    return lab.select(F.col("doc_id").alias("ID"), y_true.cast("int").alias("y_true"),
                      ((y_true + shift) % 3).cast("int").alias("y_pred"))


def scores(spark: SparkSession, sf_dir: str, mult: int = 37, mod: int = 97) -> DataFrame:
    """Synthetic non-negative class scores ``ID, r0, r1, r2`` per labelled
    document; a second model uses other multipliers."""
    lab = table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    return lab.select(i.alias("ID"),
                      *[(1 + (i * mult + 101 * k) % mod).cast("double").alias(f"r{k}")
                        for k in range(3)])


def score_probs(spark: SparkSession, sf_dir: str, mult: int = 37, mod: int = 97) -> DataFrame:
    """``ID, p`` with ``p`` the row-normalised scores as ``array<double>``."""
    s = scores(spark, sf_dir, mult, mod)
    tot = F.col("r0") + F.col("r1") + F.col("r2")
    return s.select("ID", F.array(*[F.col(f"r{k}") / tot for k in range(3)]).alias("p"))
