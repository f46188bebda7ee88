"""Small array helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``.

    A column expression referenced inside a higher-order lambda is
    re-evaluated for every element; binding it as the lambda variable of a
    one-element ``transform`` evaluates it once per row instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
