"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.session import scratch_path

#: Bytes of text that a task holds as NumPy arrays at once.
CHUNK_BYTES = 1 << 20

#: A word, as the contracts have it.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder and read again: cuts the
    lineage and keeps column pruning and sizes."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(column: str, modulus: int):
    """crc32 of an integer's decimal text, modulo ``modulus``; null counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about ``limit`` bytes of text (one long text may be more),
    with the texts as UTF-8 bytes; null is an empty text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate([*sizes.tolist(), limit + 1]):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start), [t or b"" for t in column.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += n
    release()


def release() -> None:
    """Gives a task's freed memory back to the system; a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


# --- word hashes ---------------------------------------------------------------

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)

#: Bytes between words: white space, or all of ASCII but letters and digits.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers in which each bit depends on all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 2**64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[_U(1)], np.cumprod(np.full(n, p, np.uint64))]) for p in (_BASE, inverse))


def word_hashes(texts: list[bytes], gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z as a-z) of all texts, one after the
    other, and the index at which each text's words begin, plus the end."""
    data = np.frombuffer((b" ".join(texts) + b" ").lower(), np.uint8)
    size = 1 << max(20, int(len(data)).bit_length())
    power, inverse = _powers(size)
    gap = gaps[data]
    before = np.concatenate([[True], gap[:-1]])
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    with np.errstate(over="ignore"):
        sums = np.cumsum(_TABLE[data] * power[:len(data)])
        low = np.where(starts > 0, sums[starts - 1], _U(0))
        hashes = mix64((sums[ends - 1] - low) * inverse[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins)


_MULTIPLIERS = [_U(int(x) | 1) for x in np.random.default_rng(77).integers(2**60, 2**63, 16)]


def combine(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """One hash of several columns of hashes, in order."""
    with np.errstate(over="ignore"):
        total = np.full(len(parts[0]), _U(salt) * _U(_BASE), np.uint64) if salt else np.zeros(len(parts[0]), np.uint64)
        for i, p in enumerate(parts):
            total = total + p * _MULTIPLIERS[i]
    return mix64(total)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``width`` words in a row. With
    fewer words the whole sequence is the one member; without words, none."""
    hashes, begins = word_hashes(texts)
    n = len(hashes) - width + 1
    rows = combine([hashes[i:i + n] for i in range(width)]) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rows[a:b - width + 1]))
        elif b > a:
            out.append(combine([hashes[i:i + 1] for i in range(a, b)], salt=b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
