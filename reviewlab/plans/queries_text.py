"""Registered queries for the text operators.

Every query reads the decorated ``reviews`` view of the driver's
``documents`` and ``labels`` tables (or ``pages`` for HTML) and processes
whole texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.functions import sentences as S
from reviewlab.functions import text as T
from reviewlab.operators import frames
from reviewlab.plans import jobs
from reviewlab.plans import oracle as O
from reviewlab.plans.catalog import register
from reviewlab.sources import testviews as V

# single rewrite operators: name -> (spark fn, sql fn)
_SINGLE = {
    "strip_nonprintable": (T.strip_nonprintable, O.strip_nonprintable),
    "strip_html": (T.strip_html, O.strip_html),
    "mask_url": (T.mask_url, O.mask_url),
    "mask_email": (T.mask_email, O.mask_email),
    "mask_phone": (T.mask_phone, O.mask_phone),
    "mark_emoji": (T.mark_emoji, O.mark_emoji),
    "mark_rating10": (T.mark_rating10, O.mark_rating10),
    "mark_rating5": (T.mark_rating5, O.mark_rating5),
    "mark_stars": (T.mark_stars, O.mark_stars),
    "mark_exclaim": (T.mark_exclaim, O.mark_exclaim),
    "mark_question": (T.mark_question, O.mark_question),
    "squeeze_punct": (T.squeeze_punct, O.squeeze_punct),
    "squeeze_letters": (T.squeeze_letters, O.squeeze_letters),
    "mark_slang": (T.mark_slang, O.mark_slang),
    "mark_caps": (T.mark_caps, O.mark_caps),
    "mark_english": (T.mark_english, O.mark_english),
    "squeeze_space": (T.squeeze_space, O.squeeze_space),
}


def _single(name, spark_fn, sql_fn):
    def q(spark, sf):
        return V.reviews(spark, sf).select("ID", spark_fn(F.col("text")).alias("text"))

    def sql():
        return f"SELECT ID, {sql_fn('text')} AS text FROM ({O.reviews_sql()})"

    register(f"text_{name}", sql)(q)


for _n, (_f, _s) in _SINGLE.items():
    _single(_n, _f, _s)


def _pages_html_sql():
    return f"SELECT page_id, {O.strip_html('html')} AS text FROM pages"


@register("pages_strip_html", _pages_html_sql)
def pages_strip_html(spark, sf):
    """T2 on real HTML pages."""
    return V.table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


def _band_sql():
    v = "CAST(doc_id % 13 AS INTEGER)"
    return (f"SELECT doc_id AS ID, {v} AS v, CASE WHEN {v} <= 4 THEN '[LOW_SCORE]' "
            f"WHEN {v} >= 7 THEN '[HIGH_SCORE]' ELSE '[MID_SCORE]' END AS band FROM documents")


@register("text_rating_band", _band_sql)
def text_rating_band(spark, sf):
    v = (F.col("doc_id") % 13).cast("int")
    return V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("ID"), v.alias("v"), T.rating_band(v).alias("band"))


def _clean_sql(profile):
    def sql():
        base = f"SELECT ID, text FROM ({O.reviews_sql()})"
        return f"SELECT ID, text, length(text) AS n_chars FROM {O.clean_text_sql(base, 'text', profile)}"
    return sql


@register("clean_text_train", _clean_sql("train"))
def clean_text_train(spark, sf):
    df = T.clean_text(V.reviews(spark, sf).select("ID", "text"), profile="train")
    return df.select("ID", "text", T.char_len("text").alias("n_chars"))


@register("clean_text_serve", _clean_sql("serve"))
def clean_text_serve(spark, sf):
    df = T.clean_text(V.reviews(spark, sf).select("ID", "text"), profile="serve")
    return df.select("ID", "text", T.char_len("text").alias("n_chars"))


def _char_len_sql():
    return f"SELECT ID, length(text) AS n_chars FROM ({O.reviews_sql()})"


@register("text_char_len", _char_len_sql)
def text_char_len(spark, sf):
    return V.reviews(spark, sf).select("ID", T.char_len("text").alias("n_chars"))


def _cleaned_sql():
    return O.clean_text_sql(f"SELECT ID, text FROM ({O.reviews_sql()})", "text", "train")


def _sentences_sql():
    return f"""SELECT ID, unnest(generate_series(0, len(s) - 1)) AS idx, unnest(s) AS sentence
FROM (SELECT ID, {O.split_sentences('text')} AS s FROM {_cleaned_sql()})"""


def _sentences_signal_sql():
    return (f"SELECT ID, idx, sentence, {O.has_signal('sentence')} AS has_signal "
            f"FROM ({_sentences_sql()})")


@register("sentences_split", _sentences_signal_sql)
def sentences_split(spark, sf):
    """T20 + T21 on cleaned texts: one row per sentence with its signal flag."""
    df = T.clean_text(V.reviews(spark, sf).select("ID", "text"))
    return (df.select("ID", F.posexplode(S.split_sentences(F.col("text"))).alias("idx", "sentence"))
            .withColumn("idx", F.col("idx").cast("bigint"))
            .withColumn("has_signal", S.has_signal("sentence")))


def _shorten_sql(max_len):
    def sql():
        return (f"SELECT ID, text, length(text) AS n_chars FROM "
                f"{O.shorten_sql(_cleaned_sql(), 'text', max_len)}")
    return sql


@register("shorten_train", _shorten_sql(K.MAX_TEXT_LEN_TRAIN))
def shorten_train(spark, sf):
    """T22 with the training limit on cleaned texts."""
    df = T.clean_text(V.reviews(spark, sf).select("ID", "text"))
    return df.select("ID", S.shorten("text", K.MAX_TEXT_LEN_TRAIN).alias("text")) \
             .withColumn("n_chars", F.length("text"))


@register("shorten_serve", _shorten_sql(K.MAX_TEXT_LEN_SERVE))
def shorten_serve(spark, sf):
    df = T.clean_text(V.reviews(spark, sf).select("ID", "text"))
    return df.select("ID", S.shorten("text", K.MAX_TEXT_LEN_SERVE).alias("text")) \
             .withColumn("n_chars", F.length("text"))


def _src_token_sql(x_src, x_text):
    s = f"lower(regexp_replace(coalesce({x_src}, 'nan'), {O.q('^' + O.WS + '+|' + O.WS + '+$')}, '', 'g'))"
    s = f"replace({s}, ' ', '_')"
    return f"(CASE WHEN {s} = '' THEN '' ELSE '[SRC_' || {s} || '] ' END) || {x_text}"


def _source_token_sql():
    return f"SELECT ID, {_src_token_sql('src', 'text')} AS text FROM ({O.reviews_sql()})"


@register("add_source_token", _source_token_sql)
def add_source_token(spark, sf):
    """P13 on raw reviews (null source -> [SRC_nan], blank -> unchanged)."""
    return frames.add_source_token(V.reviews(spark, sf).select("ID", "text", "src")).drop("src")


def _raw_source_token_sql():
    return (f"SELECT ID, CASE WHEN src IS NULL THEN text "
            f"ELSE '[SRC_' || src || '] ' || text END AS text FROM ({O.reviews_sql()})")


@register("add_source_token_raw", _raw_source_token_sql)
def add_source_token_raw(spark, sf):
    """The notebook's un-normalised source prefix."""
    return frames.add_source_token(V.reviews(spark, sf).select("ID", "text", "src"),
                                   normalise=False).drop("src")


def _prepare_inference_sql(profile="train", max_len=K.MAX_TEXT_LEN_TRAIN):
    base = f"SELECT ID, text, src FROM ({O.reviews_sql()})"
    short = O.shorten_sql(O.clean_text_sql(base, "text", profile), "text", max_len)
    return (f"SELECT ID, {_src_token_sql('src', 'text')} AS text, src, "
            f"length(text) = 0 AS is_empty FROM {short}")


@register("prepare_inference", _prepare_inference_sql)
def prepare_inference(spark, sf):
    """Fill, clean, shorten, flag empties, source token; row count
    and IDs unchanged."""
    return jobs.prepare_inference(V.reviews(spark, sf).select("ID", "text", "src"))
