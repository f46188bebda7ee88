"""Golden rows for the cleaning chain and the shortener (FIXTURES.md §4)."""

import pytest
from pyspark.sql import functions as F

from reviewlab.functions import sentences as S
from reviewlab.functions import text as T
from reviewlab.operators import frames

CLEAN_TRAIN = [
    ("Отлично! Оценка 8 из 10", "Отлично! Оценка [HIGH_SCORE] 8 из 10"),
    ("Ужас 2/10, 3/5 за вид", "[EN] Ужас [LOW_SCORE] 2/10, [MID_SCORE] 3/5 за вид"),
    ("5 из 10", "[MID_SCORE] 5 из 10"),
    ("12/10 и 0/5", "[EN] [ALL_CAPS] [HIGH_SCORE] 12/10 и [LOW_SCORE] 0/5"),
    ("1 из 10 из 10", "[LOW_SCORE] 1 из 10 из 10"),
    ("⭐⭐⭐⭐⭐⭐⭐⭐ ок", "[EN] [ALL_CAPS] [HIGH_SCORE] ⭐⭐⭐⭐⭐[MID_SCORE] ⭐⭐⭐ ок"),
    ("★★★ за уют и вид", "[MID_SCORE] ★★★ за уют и вид"),
    ("★ за уют", "★ за уют"),
    ("Это было круууто!!!", "[EN] Это было крууто [STRONG_EXCL]"),
    ("Да!! Нет??", "Да!! Нет??"),
    ("ну.... да,,,,", "ну... да,,,"),
    ("строка\nдругая", "строкадругая"),
    ("​\t", ""),
    ("", ""),
    ("<b>да</b> тут", "да тут"),
    ("смотри https://x.ru/a", "[EN] [ALL_CAPS] смотри [URL]"),
    ("пиши a@b.ru", "[EN] [ALL_CAPS] пиши [EMAIL]"),
    ("+7 999 123-45-67", "[EN] [ALL_CAPS] + [PHONE]"),
    ("ок ✌️", "[EN] [ALL_CAPS] ок [GESTURE] [LOVE]"),
    ("🤮 фу", "[EN] [ALL_CAPS] [DISGUST] фу"),
    ("🙈 ну вот", "[EN] [ALL_CAPS] [FACEPALM] ну вот"),
    ("😎 да", "[EN] [ALL_CAPS] [COOL] да"),
    ("🍷 вечер был тихим", "[DRINK] вечер был тихим"),
    ("говно", "[EN] [ALL_CAPS] [BAD_STRONG]"),
    ("Полный ОТСТОЙ и жесть", "[EN] [ALL_CAPS] Полный [BAD] и [WOW]"),
    ("фуффел тут у вас", "[EN] [BAD_QUALITY] тут у вас"),
    ("ну и фууфел", "ну и фууфел"),
    ("ах**х вот так да", "[STRONG] х вот так да"),
    ("ахх** вот", "ахх** вот"),
    ("ёкарныйбабай что это было", "[EXCLAIM] что это было"),
    ("ОЧЕНЬ ПЛОХО сервис", "[ALL_CAPS] ОЧЕНЬ ПЛОХО сервис"),
    ("This is fine", "[EN] This is fine"),
]

SHORTEN_40 = [
    ("Один. Два. Три. Четыре. Ужас пять. Шесть. Рекомендую семь.", "Один. Два. Три. Ужас пять."),
    ("Раз. Раз. Раз. Ужас. Ужас. Конец всему этому рассказу.", "Раз. Раз. Раз. Ужас."),
    ("А. Б. В. Ужас как длинно тянется это предложение. Ужас.", "А. Б. В."),
    ("Одно очень длинное предложение без точек внутри и с хвостом",
     "Одно очень длинное предложение без точек"),
    ("Коротко. Ясно.", "Коротко. Ясно."),
]


def _run(spark, rows, fn):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "id int, text string")
    got = dict(fn(df).select("id", "text").collect())
    return [(a, e, got[i]) for i, (a, e) in enumerate(rows)]


def test_clean_text_train(spark):
    bad = [(a, e, g) for a, e, g in _run(spark, CLEAN_TRAIN, lambda d: T.clean_text(d)) if e != g]
    assert not bad, bad


def test_clean_text_serve_skips_stars(spark):
    rows = [("★★★ за уют и вид", "★★★ за уют и вид"), ("5 из 10", "[MID_SCORE] 5 из 10")]
    bad = [(a, e, g) for a, e, g in _run(spark, rows, lambda d: T.clean_text(d, profile="serve")) if e != g]
    assert not bad, bad


def test_null_text_is_empty(spark):
    df = spark.createDataFrame([(1, None)], "id int, text string")
    assert T.clean_text(df).first()["text"] == ""


def test_shorten(spark):
    bad = [(a, e, g) for a, e, g in
           _run(spark, SHORTEN_40, lambda d: d.withColumn("text", S.shorten("text", 40))) if e != g]
    assert not bad, bad


def test_source_token(spark):
    df = spark.createDataFrame([(1, "т", "Sber Bank "), (2, "т", None), (3, "т", "  ")],
                               "ID int, text string, src string")
    got = dict(frames.add_source_token(df).select("ID", "text").collect())
    assert got == {1: "[SRC_sber_bank] т", 2: "[SRC_nan] т", 3: "т"}


def test_squeeze_space_idempotent(spark, ):
    from tests.conftest import SF001
    from reviewlab.sources import testviews as V
    r = V.reviews(spark, SF001).select(T.squeeze_space("text").alias("a"))
    assert r.filter(T.squeeze_space("a") != F.col("a")).count() == 0
