"""Registered queries for text features.

Input is the classifier's view of each review: the Q2 preparation
(cleaned, shortened, source token) of the decorated reviews.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlab.operators import features as FT
from reviewlab.plans import jobs
from reviewlab.plans import oracle as O
from reviewlab.plans.catalog import register
from reviewlab.plans.queries_text import _prepare_inference_sql
from reviewlab.session import cut_lineage
from reviewlab.sources import testviews as V

WORD = dict(lo=1, hi=2, min_df=2, max_df=0.95, max_features=2000)
CHAR = dict(lo=3, hi=5, min_df=2, max_df=0.95, max_features=5000)
SEQ_LEN = 192
TOKEN_RE = O.W + "{2,}"


def _docs(spark, sf):
    """Prepared texts, written once to the shared checkpoint folder like
    the original's saved preparation output; the feature stages then read
    the materialised table instead of re-running the cleaning chain."""
    prepared = jobs.prepare_inference(V.reviews(spark, sf).select("ID", "text", "src"))
    return cut_lineage(prepared.select("ID", "text"))


def _word_terms_sql(x, lo, hi):
    toks = f"regexp_extract_all(lower({x}), {O.q(TOKEN_RE)})"
    parts = [f"list_transform(generate_series(1, len(t) - {n} + 1), lambda i: array_to_string(t[i:i + {n - 1}], ' '))"
             for n in range(lo, hi + 1)]
    return f"(SELECT flatten([{', '.join(parts)}]) FROM (SELECT {toks} AS t))"


def _char_terms_sql(x, lo, hi):
    s = f"regexp_replace(lower({x}), {O.q(O.WS + '{2,}')}, ' ', 'g')"
    parts = [f"list_transform(generate_series(1, length(s) - {n} + 1), lambda i: substring(s, i, {n}))"
             for n in range(lo, hi + 1)]
    return f"(SELECT flatten([{', '.join(parts)}]) FROM (SELECT {s} AS s))"


def _vocab_sql(terms_fn, p):
    return f"""(WITH d AS (SELECT ID, {terms_fn('text', p['lo'], p['hi'])} AS terms FROM ({_prepare_inference_sql()})),
nd AS (SELECT count(*) AS n FROM d),
tc AS (SELECT ID, term, count(*) AS tf FROM (SELECT ID, unnest(terms) AS term FROM d) GROUP BY ALL),
v AS (SELECT term, sum(tf) AS tf, count(*) AS df FROM tc GROUP BY term),
f AS (SELECT v.* FROM v, nd WHERE df >= {p['min_df']} AND df <= n * CAST({p['max_df']} AS DOUBLE))
SELECT term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df,
  CAST(row_number() OVER (ORDER BY tf DESC, term) - 1 AS INTEGER) AS idx FROM f QUALIFY idx < {p['max_features']})"""


def _vocab(spark, sf, terms_fn, p):
    d = _docs(spark, sf)
    tc = FT.term_counts(d.select("ID", terms_fn("text", p["lo"], p["hi"]).alias("terms")))
    n = d.agg(F.count(F.lit(1))).scalar()
    return d, tc, n, FT.vocabulary(tc, n, p["min_df"], p["max_df"], p["max_features"])


@register("word_vocabulary", lambda: f"SELECT * FROM {_vocab_sql(_word_terms_sql, WORD)}")
def word_vocabulary(spark, sf):
    """F1 + F3: word uni/bi-grams, min_df 2, max_df 0.95, top 2000."""
    return _vocab(spark, sf, FT.word_ngrams, WORD)[3]


@register("char_vocabulary", lambda: f"SELECT * FROM {_vocab_sql(_char_terms_sql, CHAR)}")
def char_vocabulary(spark, sf):
    """F2 + F3: character 3-5-grams, min_df 2, max_df 0.95, top 5000."""
    return _vocab(spark, sf, FT.char_ngrams, CHAR)[3]


def _tfidf_sql():
    p = WORD
    return f"""WITH d AS (SELECT ID, {_word_terms_sql('text', p['lo'], p['hi'])} AS terms FROM ({_prepare_inference_sql()})),
nd AS (SELECT count(*) AS n FROM d),
tc AS (SELECT ID, term, count(*) AS tf FROM (SELECT ID, unnest(terms) AS term FROM d) GROUP BY ALL),
voc AS {_vocab_sql(_word_terms_sql, p)},
w AS (SELECT tc.ID, tc.term, voc.idx, (1 + ln(tc.tf)) * (ln((1 + nd.n) / (1 + voc.df)) + 1) AS weight
  FROM tc JOIN voc ON tc.term = voc.term, nd)
SELECT ID, term, idx, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY ID)), 6) AS weight FROM w"""


@register("tfidf_word", _tfidf_sql)
def tfidf_word(spark, sf):
    """Sublinear tf x smooth idf, l2-normalised, over the word
    vocabulary (broadcast: bounded by its max_features)."""
    d, tc, n, vocab = _vocab(spark, sf, FT.word_ngrams, WORD)
    w = FT.tfidf(tc, vocab, n, sublinear=True, vocab_bound=WORD["max_features"])
    return w.withColumn("weight", F.round("weight", 6))


def _token_ids_sql():
    toks = f"regexp_extract_all(lower(text), {O.q(TOKEN_RE)})[1:{SEQ_LEN}]"
    return f"""WITH d AS (SELECT ID, {toks} AS toks FROM ({_prepare_inference_sql()})),
voc AS {_vocab_sql(_word_terms_sql, WORD)},
t AS (SELECT ID, unnest(toks) AS term, unnest(generate_series(0, len(toks) - 1)) AS pos FROM d),
j AS (SELECT t.ID, t.pos, coalesce(voc.idx + 2, 1) AS tid FROM t LEFT JOIN voc ON t.term = voc.term),
s AS (SELECT ID, list(tid ORDER BY pos) AS s FROM j GROUP BY ID),
x AS (SELECT d.ID, coalesce(s.s, []) AS s FROM d LEFT JOIN s ON d.ID = s.ID)
SELECT ID, array_to_string(list_concat(s, list_transform(generate_series(1, {SEQ_LEN} - len(s)), lambda z: 0)), ' ') AS input_ids,
  CAST(len(s) AS INTEGER) AS n_tokens FROM x"""


@register("token_ids", _token_ids_sql)
def token_ids(spark, sf):
    """First 192 word tokens as vocabulary ids, padded, with mask."""
    d, tc, n, vocab = _vocab(spark, sf, FT.word_ngrams, WORD)
    t = FT.token_ids(d, vocab, n=SEQ_LEN, vocab_bound=WORD["max_features"])
    return t.select("ID", F.array_join("input_ids", " ").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"))
