"""Registered queries for dedup, sampling, augmentation, profiles and Q1."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.functions import text as T
from reviewlab.operators import frames, profile as G, sampling as SMP
from reviewlab.plans import jobs
from reviewlab.plans import oracle as O
from reviewlab.plans.catalog import register
from reviewlab.session import cut_lineage, spread, stored
from reviewlab.sources import testviews as V

SEED = K.SEED


def _h(key="ID", seed=SEED):
    return f"md5('{seed}|' || CAST({key} AS VARCHAR))"


def _rank(part, key="ID", seed=SEED):
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY {_h(key, seed)}, {key})"


def _labelled_sql():
    return f"SELECT * FROM ({O.reviews_sql()}) WHERE text IS NOT NULL AND label IS NOT NULL"


def _labelled(spark, sf):
    return frames.drop_unusable(V.reviews(spark, sf))


# G1 / G2 / G8 ------------------------------------------------------------------
@register("value_counts_label",
          lambda: f"SELECT label, CAST(count(*) AS BIGINT) AS n FROM ({O.reviews_sql()}) GROUP BY label")
def value_counts_label(spark, sf):
    return G.value_counts(V.reviews(spark, sf), "label")


@register("value_shares_src", lambda: f"""SELECT src, CAST(count(*) AS BIGINT) AS n,
  round(count(*) / (SELECT count(*) FROM ({O.reviews_sql()})), 6) AS share
FROM ({O.reviews_sql()}) GROUP BY src""")
def value_shares_src(spark, sf):
    return G.value_shares(V.reviews(spark, sf), "src")


def _class_weights_sql(mode):
    def sql():
        base = _labelled_sql()
        k = f"(SELECT count(DISTINCT label) FROM ({base}))"
        den = "count(*)" if mode == "inverse" else f"({k} * count(*))"
        return (f"SELECT label, CAST(count(*) AS BIGINT) AS n, "
                f"round((SELECT count(*) FROM ({base})) / {den}, 6) AS weight FROM ({base}) GROUP BY label")
    return sql


@register("class_weights", _class_weights_sql("inverse"))
def class_weights(spark, sf):
    return G.class_weights(_labelled(spark, sf), "label", "inverse")


@register("class_weights_balanced", _class_weights_sql("balanced"))
def class_weights_balanced(spark, sf):
    return G.class_weights(_labelled(spark, sf), "label", "balanced")


# J1 / J2 / J3 ----------------------------------------------------------------
@register("dedup_exact", lambda: f"""SELECT ID, label, src FROM ({_labelled_sql()})
QUALIFY row_number() OVER (PARTITION BY text, label ORDER BY ID) = 1""")
def dedup_exact(spark, sf):
    return frames.dedup_exact(_labelled(spark, sf), ("text", "label"), "ID").select("ID", "label", "src")


def _turns_sql():
    return ("SELECT conv_id AS ID, turn AS seq, CAST(length(text) % 3 AS INTEGER) AS label, role "
            "FROM conversations")


@register("last_by_id", lambda: f"""SELECT ID, label, role, seq FROM ({_turns_sql()})
QUALIFY row_number() OVER (PARTITION BY ID ORDER BY seq DESC) = 1""")
def last_by_id(spark, sf):
    """Per conversation the label of the last turn wins (turns play the
    role of repeated IDs in an upload)."""
    c = V.table(spark, sf, "conversations")
    t = c.select(F.col("conv_id").alias("ID"), F.col("turn").alias("seq"),
                 (F.length("text") % 3).cast("int").alias("label"), "role")
    return frames.last_by_id(t, "ID", "seq").select("ID", "label", "role", "seq")


@register("join_truth", lambda: f"""SELECT p.ID, r.label AS y_true, p.y_pred FROM ({O.preds_sql()}) p
JOIN ({O.reviews_sql()}) r ON p.ID = r.ID WHERE r.label IS NOT NULL""")
def join_truth(spark, sf):
    """Predictions x truth on ID; ids present on one side only drop."""
    truth = V.reviews(spark, sf).filter(F.col("label").isNotNull()).select("ID", "label")
    pred = V.preds(spark, sf).select("ID", F.col("y_pred").alias("label"))
    return frames.join_truth(pred, truth).select("ID", "y_true", "y_pred")


@register("apply_overrides", lambda: f"""SELECT p.ID, coalesce(o.label, p.y_pred) AS label
FROM ({O.preds_sql()}) p LEFT JOIN (SELECT doc_id AS ID, CAST(floor(doc_id / 25) AS INTEGER) % 3 AS label
  FROM documents WHERE doc_id % 25 = 0) o ON p.ID = o.ID""")
def apply_overrides(spark, sf):
    """P10: manual corrections (every 25th document) win over predictions."""
    ov = (V.table(spark, sf, "documents").filter(F.col("doc_id") % 25 == 0)
          .select(F.col("doc_id").alias("ID"), (F.floor(F.col("doc_id") / 25).cast("int") % 3).alias("label")))
    p = V.preds(spark, sf).select("ID", F.col("y_pred").alias("label"))
    return frames.apply_overrides(p, ov)


# P-filters -------------------------------------------------------------------
@register("valid_labels_blank_zero", lambda: """SELECT doc_id AS ID,
  CASE WHEN trim(raw) = '' THEN 0 ELSE CAST(TRY_CAST(trim(raw) AS DOUBLE) AS INTEGER) END AS label
FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN '' WHEN quality = 1 THEN ' 2 ' ELSE 'x' END AS raw FROM labels)
WHERE trim(raw) = '' OR TRY_CAST(trim(raw) AS DOUBLE) IN (0, 1, 2)""")
def valid_labels_blank_zero(spark, sf):
    """P6 with the JavaScript quirk: blank label counts as class 0; junk
    labels are skipped."""
    lab = V.table(spark, sf, "labels")
    raw = (F.when(F.col("toxic") == 1, "").when(F.col("quality") == 1, " 2 ").otherwise("x"))
    return frames.valid_labels(lab.select(F.col("doc_id").alias("ID"), raw.alias("label")),
                               "label", blank_as_zero=True)


@register("errors", lambda: f"SELECT ID, y_true, y_pred FROM ({O.preds_sql()}) WHERE y_true <> y_pred")
def errors(spark, sf):
    return frames.errors(V.preds(spark, sf))


@register("preview", lambda: f"SELECT ID, label FROM ({O.reviews_sql()}) ORDER BY ID LIMIT 10")
def preview(spark, sf):
    return frames.preview(V.reviews(spark, sf).select("ID", "label"), 10)


@register("filter_source_keyword", lambda: f"""SELECT ID FROM ({O.reviews_sql()})
WHERE src IN ('src1', 'src2', 'src3') AND regexp_matches(text, '(?i)(^|{O.NW})(?:рекомендую|отстой)($|{O.NW})')""")
def filter_source_keyword(spark, sf):
    """P8 + P9: reviews from three sources that mention a keyword."""
    r = frames.filter_source(V.reviews(spark, sf), ["src1", "src2", "src3"])
    return frames.filter_keyword(r, ["рекомендую", "отстой"]).select("ID")


# S1 - S7 ---------------------------------------------------------------------
@register("cap_per_source", lambda: f"""SELECT ID, src FROM ({O.reviews_sql()}) WHERE src IS NOT NULL
QUALIFY {_rank('src')} <= 20""")
def cap_per_source(spark, sf):
    return SMP.cap_per_group(V.reviews(spark, sf), "src", 20, SEED).select("ID", "src")


def _cap_total_sql():
    base = _labelled_sql()
    return f"""WITH b AS ({base}), c AS (SELECT label, count(*) AS cnt FROM b GROUP BY label),
q AS (SELECT label, CASE WHEN (SELECT sum(cnt) FROM c) > 200
      THEN least(cnt, greatest(1, floor(cnt * 200 / (SELECT sum(cnt) FROM c)))) ELSE cnt END AS quota FROM c)
SELECT b.ID, b.label FROM b JOIN q USING (label) QUALIFY {_rank('b.label', 'b.ID')} <= max(q.quota) OVER (PARTITION BY b.label)"""


@register("cap_total_stratified", _cap_total_sql)
def cap_total_stratified(spark, sf):
    return SMP.cap_total_stratified(_labelled(spark, sf), "label", 200, SEED).select("ID", "label")


def _split_sql(base):
    return f"""(WITH b AS ({base}), c AS (SELECT label, count(*) AS cnt FROM b GROUP BY label),
n AS (SELECT sum(cnt) AS n, sum(cnt) - ceil(sum(cnt) * {K.VAL_SIZE}) AS ntr FROM c),
f AS (SELECT label, cnt, floor(cnt * ntr / n) AS fl, cnt * ntr / n - floor(cnt * ntr / n) AS fr, ntr FROM c, n),
q AS (SELECT label, cnt - (fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, label)
      <= ntr - sum(fl) OVER () THEN 1 ELSE 0 END) AS test FROM f),
r AS (SELECT b.*, q.test, {_rank('b.label', 'b.ID')} AS r FROM b JOIN q USING (label))
SELECT * EXCLUDE (test, r), CASE WHEN r <= test THEN 'val' ELSE 'train' END AS split,
  CAST(r - CASE WHEN r <= test THEN 0 ELSE test END AS BIGINT) AS rank FROM r)"""


@register("stratified_split", lambda: f"SELECT ID, label, split, rank FROM {_split_sql(_labelled_sql())}")
def stratified_split(spark, sf):
    return SMP.stratified_split(_labelled(spark, sf), "label", K.VAL_SIZE, SEED).select(
        "ID", "label", "split", "rank")


@register("sample_fraction", lambda: f"""SELECT doc_id AS ID FROM documents
WHERE substr({_h('doc_id')}, 1, 8) < '{SMP.hash_threshold(K.SEARCH_SAMPLE_FRACTION)}'""")
def sample_fraction(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("ID"))
    return SMP.sample_fraction(d, K.SEARCH_SAMPLE_FRACTION, SEED)


@register("sample_n", lambda: f"SELECT doc_id AS ID FROM documents QUALIFY {_rank(None, 'doc_id')} <= 100")
def sample_n(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("ID"))
    return SMP.sample_n(d, 100, SEED)


@register("shuffle_rows", lambda: f"SELECT doc_id AS ID, CAST({_rank(None, 'doc_id')} AS BIGINT) AS ord FROM documents")
def shuffle_rows(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("ID"))
    return SMP.shuffle_rows(d, SEED)


@register("assign_folds", lambda: f"""SELECT ID, label, CAST(({_rank('label')} - 1) % {K.ENSEMBLE_FOLDS} AS INTEGER) AS fold
FROM ({_labelled_sql()})""")
def assign_folds(spark, sf):
    return SMP.assign_folds(_labelled(spark, sf).select("ID", "label"), K.ENSEMBLE_FOLDS, "label", SEED)


# A1 - A4 ---------------------------------------------------------------------
def _u_sql(key, copy, tag, i=None):
    s = f"'{SEED}|' || CAST({key} AS VARCHAR) || '|' || CAST({copy} AS VARCHAR) || '|{tag}'"
    if i is not None:
        s += f" || '|' || CAST({i} AS VARCHAR)"
    return f"(('0x' || substr(md5({s}), 1, 8))::UBIGINT / 4294967296.0)"


def augment_sql(base, key="ID", copy="aug", text="text"):
    """SQL of ``sampling.augment_text`` over ``base`` (replaces ``text``)."""
    ws = O.q(O.WS + "+")
    n = next(O._ids)
    return f"""(WITH a{n} AS (SELECT *, list_filter(string_split_regex({text}, {ws}), lambda w: w <> '') AS __w FROM ({base})),
b{n} AS (SELECT *, list_filter(__w, lambda w, i: {_u_sql(key, copy, 'd', 'i - 1')} > CAST({K.WORD_DROP_P} AS DOUBLE)) AS __k FROM a{n}),
c{n} AS (SELECT * EXCLUDE (__w, __k), CASE WHEN len(__w) < {K.MIN_WORDS_FOR_AUG} OR len(__k) = 0 THEN __w ELSE __k END AS __w1 FROM b{n}),
d{n} AS (SELECT *, CAST(floor({_u_sql(key, copy, 'i')} * len(__w1)) AS INTEGER) AS __i,
    CAST(floor({_u_sql(key, copy, 'j')} * (len(__w1) - 1)) AS INTEGER) AS __j0,
    len(__w1) >= {K.MIN_WORDS_FOR_AUG} AND {_u_sql(key, copy, 's')} <= CAST({K.WORD_SWAP_P} AS DOUBLE) AS __do FROM c{n}),
e{n} AS (SELECT *, CASE WHEN __j0 >= __i THEN __j0 + 1 ELSE __j0 END AS __j FROM d{n})
SELECT * EXCLUDE (__w1, __i, __j0, __j, __do) REPLACE (array_to_string(CASE WHEN __do THEN
  list_transform(__w1, lambda w, k: CASE WHEN k - 1 = __i THEN __w1[__j + 1] WHEN k - 1 = __j THEN __w1[__i + 1] ELSE w END)
  ELSE __w1 END, ' ') AS {text}) FROM e{n})"""


@register("augment_text", lambda: f"""SELECT ID, aug, text FROM {augment_sql(
    f"SELECT ID, 1 AS aug, text FROM {O.clean_text_sql(f'SELECT ID, text FROM ({O.reviews_sql()})')}")}""")
def augment_text(spark, sf):
    """A1-A3: one augmented copy of every cleaned review."""
    d = T.clean_text(V.reviews(spark, sf).select("ID", "text")).withColumn("aug", F.lit(1))
    return d.select("ID", "aug", SMP.augment_text(F.col("text"), F.col("ID"), F.col("aug"), SEED).alias("text"))


# G3 / G4 / G5 / Q1 -------------------------------------------------------------
def _prepared_sql():
    """SQL of Q1 up to the split (dedup, clean, drop empty, shorten, cap)."""
    dedup = f"SELECT * FROM ({_labelled_sql()}) QUALIFY row_number() OVER (PARTITION BY text, label ORDER BY ID) = 1"
    cleaned = f"SELECT * FROM {O.clean_text_sql(dedup)} WHERE length(text) > 0"
    short = O.shorten_sql(cleaned, "text", K.MAX_TEXT_LEN_TRAIN)
    return f"SELECT * FROM {short} WHERE src IS NOT NULL QUALIFY {_rank('src')} <= {K.MAX_SAMPLES_PER_SRC}"


def _prepared(spark, sf):
    df = spread(cut_lineage(frames.dedup_exact(_labelled(spark, sf), ("text", "label"), "ID")))
    df = frames.drop_empty(T.clean_text(df))
    from reviewlab.functions.sentences import shorten
    df = cut_lineage(df.withColumn("text", shorten("text", K.MAX_TEXT_LEN_TRAIN)))
    return SMP.cap_per_group(df, "src", K.MAX_SAMPLES_PER_SRC, SEED)


def _profile_sql():
    ps = ", ".join(f"round(quantile_cont(length(text), {p}), 6) AS p{int(round(p * 100))}" for p in G.PERCENTILES)
    return f"""SELECT CAST(count(*) AS BIGINT) AS count, round(avg(length(text)), 6) AS mean,
  round(stddev_samp(length(text)), 6) AS std, CAST(min(length(text)) AS INTEGER) AS min,
  CAST(max(length(text)) AS INTEGER) AS max, {ps} FROM ({_prepared_sql()})"""


@register("length_profile", _profile_sql)
def length_profile(spark, sf):
    """G3 over the prepared (cleaned, shortened, capped) reviews."""
    return G.length_profile(_prepared(spark, sf))


@register("length_profile_by_label", lambda: _profile_sql().replace(
    "SELECT CAST(count(*)", "SELECT label, CAST(count(*)", 1) + " GROUP BY label")
def length_profile_by_label(spark, sf):
    return G.length_profile(_prepared(spark, sf), by="label")


def _prep_report_sql():
    lab = _labelled_sql()
    dedup = f"SELECT * FROM ({lab}) QUALIFY row_number() OVER (PARTITION BY text, label ORDER BY ID) = 1"
    cleaned = O.clean_text_sql(dedup)
    nonempty = f"SELECT * FROM {cleaned} WHERE length(text) > 0"
    short = O.shorten_sql(nonempty, "text", K.MAX_TEXT_LEN_TRAIN)
    L = K.MAX_TEXT_LEN_TRAIN
    return f"""SELECT (SELECT count(*) FROM ({lab})) AS rows_raw,
  (SELECT count(*) FROM ({lab})) - (SELECT count(*) FROM ({dedup})) AS duplicates_removed,
  (SELECT count(*) FROM {cleaned}) - (SELECT count(*) FROM ({nonempty})) AS empty_removed,
  (SELECT count(*) FROM ({nonempty}) WHERE length(text) > {L}) AS long_before,
  (SELECT count(*) FROM {short} WHERE length(text) > {L}) AS long_after"""


@register("prep_report", _prep_report_sql)
def prep_report(spark, sf):
    """Step counters of the training preparation."""
    from reviewlab.functions.sentences import shorten
    steps = G.StepCounters(K.MAX_TEXT_LEN_TRAIN)
    raw = steps.watch(_labelled(spark, sf), "raw")
    dedup = steps.watch(frames.dedup_exact(raw, ("text", "label"), "ID"), "deduped")
    cleaned = steps.watch(T.clean_text(dedup), "cleaned")
    short = steps.watch(frames.drop_empty(cleaned).withColumn("text", shorten("text", K.MAX_TEXT_LEN_TRAIN)), "shortened")
    stored(short, "prepared")
    return steps.report(spark)


def _training_sql():
    split = _split_sql(_prepared_sql())
    deficits = f"""SELECT label, (SELECT max(c) FROM (SELECT count(*) AS c FROM s WHERE split = 'train' GROUP BY label)) - count(*) AS def
FROM s WHERE split = 'train' GROUP BY label"""
    aug_base = f"""SELECT s.* EXCLUDE (aug) , k.aug FROM s JOIN ({deficits}) d USING (label)
CROSS JOIN (SELECT unnest(generate_series(1, {K.MAX_AUG_PER_SAMPLE})) AS aug) k
WHERE s.split = 'train' AND (s.rank - 1) * {K.MAX_AUG_PER_SAMPLE} + k.aug <= d.def"""
    tok = "CASE WHEN x = '' THEN '' ELSE '[SRC_' || x || '] ' END"
    x = f"replace(lower(regexp_replace(coalesce(src, 'nan'), {O.q('^' + O.WS + '+|' + O.WS + '+$')}, '', 'g')), ' ', '_')"
    tok = tok.replace("x", x)
    return f"""WITH s AS (SELECT *, 0 AS aug FROM {split}),
tr AS (SELECT * EXCLUDE (rank) FROM s WHERE split = 'train'
       UNION ALL BY NAME SELECT * EXCLUDE (rank) FROM {augment_sql(aug_base)}),
trt AS (SELECT * REPLACE ({tok} || text AS text) FROM tr),
trk AS (SELECT *, CAST(ID AS VARCHAR) || '|' || CAST(aug AS VARCHAR) AS k FROM trt)
SELECT ID, aug, split, text, label, src, CAST(row_number() OVER (ORDER BY md5('{SEED}|' || k), k) AS BIGINT) AS ord FROM trk
UNION ALL
SELECT ID, aug, split, {tok} || text AS text, label, src, CAST(NULL AS BIGINT) AS ord FROM s WHERE split = 'val'"""


@register("prepare_training", _training_sql)
def prepare_training(spark, sf):
    """Q1: full training-set build with the original parameters."""
    out = jobs.prepare_training(V.reviews(spark, sf))
    return out.select("ID", "aug", "split", "text", "label", "src", "ord")


@register("retention", lambda: f"""SELECT a AS rows_raw, b AS rows_final, a - b AS rows_removed,
  round(b * 100.0 / a, 2) AS pct_kept, round((a - b) * 100.0 / a, 2) AS pct_removed
FROM (SELECT (SELECT count(*) FROM ({O.reviews_sql()})) AS a, (SELECT count(*) FROM ({_prepared_sql()})) AS b)""")
def retention(spark, sf):
    """Raw reviews kept through the preparation filters."""
    return G.retention(V.reviews(spark, sf), _prepared(spark, sf))
