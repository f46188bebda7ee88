"""Registered queries for grouping, sampling, metrics and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.operators import profile as G
from reviewlab.plans import oracle as O
from reviewlab.plans.catalog import register
from reviewlab.sources import testviews as V


def _pct_sql(n, tot, digits=1):
    """Percent ``100*n/tot`` rounded half-up in integer arithmetic."""
    s = 10 ** digits
    return f"CAST(floor(({n} * {200 * s} + {tot}) / ({tot} * 2)) / {float(s)} AS DOUBLE)"


# G6 / G7 --------------------------------------------------------------------
def _class_distribution_sql():
    p = f"SELECT y_pred AS label FROM ({O.preds_sql()}) WHERE y_pred IN (0, 1, 2)"
    return f"""WITH p AS ({p}), t AS (SELECT count(*) AS total FROM p),
c AS (SELECT label, count(*) AS n FROM p GROUP BY label)
SELECT g.label, CAST(coalesce(c.n, 0) AS BIGINT) AS n, t.total,
  CASE WHEN t.total > 0 THEN {_pct_sql('coalesce(c.n, 0)', 't.total')} ELSE 0.0 END AS pct,
  round(CASE WHEN t.total > 0 AND coalesce(c.n, 0) > 0
        THEN greatest(coalesce(c.n, 0) * 100.0 / t.total, {K.BAR_MIN_HEIGHT}) ELSE 0.0 END, 6) AS bar_height
FROM (SELECT unnest([0, 1, 2]) AS label) g CROSS JOIN t LEFT JOIN c ON g.label = c.label"""


@register("class_distribution", _class_distribution_sql)
def class_distribution(spark, sf):
    """G6 over predicted labels."""
    p = V.preds(spark, sf).select(F.col("y_pred").alias("label"))
    return G.class_distribution(p)


def _source_distribution_sql():
    r = f"""SELECT ID, max(coalesce(nullif(trim(src), ''), {O.q(K.UNKNOWN_SOURCE)})) AS src
FROM ({O.reviews_sql()}) GROUP BY ID"""
    j = f"""SELECT p.y_pred AS label, coalesce(r.src, {O.q(K.UNKNOWN_SOURCE)}) AS src
FROM ({O.preds_sql()}) p LEFT JOIN ({r}) r ON p.ID = r.ID WHERE p.y_pred IN (0, 1, 2)"""
    cnt = ", ".join(f"CAST(count(*) FILTER (WHERE label = {x}) AS BIGINT) AS n_{x}" for x in K.LABELS)
    pct = ", ".join(f"{_pct_sql(f'n_{x}', 'total')} AS pct_{x}" for x in K.LABELS)
    return f"""SELECT *, {pct} FROM (
SELECT src, {cnt}, CAST(count(*) AS BIGINT) AS total FROM ({j}) GROUP BY src)"""


@register("source_distribution", _source_distribution_sql)
def source_distribution(spark, sf):
    """G7 (flagship): predicted class x source with J4 and P7."""
    p = V.preds(spark, sf).select("ID", F.col("y_pred").alias("label"))
    return G.source_distribution(p, V.reviews(spark, sf))
