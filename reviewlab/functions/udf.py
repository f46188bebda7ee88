"""User-supplied text functions (U1): the slow path, Arrow-batched."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Bytes of text that are pandas strings at one time; a longer text stands alone.
CHUNK_BYTES = 1 << 20


def _chunks(texts: pa.Array) -> list[tuple[int, int]]:
    """(first, count) of runs of texts of about ``CHUNK_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    out, first, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > CHUNK_BYTES:
            out.append((first, i - first))
            first, held = i, 0
        held += n
    return [*out, (first, len(sizes) - first)]


def map_text(df: DataFrame, fn, col: str = "text", out: str | None = None) -> DataFrame:
    """Apply ``fn(pd.Series) -> pd.Series`` to a string column, text by text,
    through Arrow batches, which become pandas strings a run of texts at a
    time. Prefer the built-in column functions; this hook is for custom cleaners."""
    @arrow_udf("string")
    def _udf(texts: pa.Array) -> pa.Array:
        made = [pa.array(fn(texts.slice(first, n).to_pandas().fillna("")), pa.string(), from_pandas=True) for first, n in _chunks(texts)]
        return pa.concat_arrays(made)

    # as in models.batch_score: the argument must be a plain column
    arg = "__text"
    return df.withColumn(arg, F.explode(F.array(col))).withColumn(out or col, _udf(F.col(arg))).drop(arg)
