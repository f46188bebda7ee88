"""Repeated byte strings: suffixes at anchors sorted in runs, exchanged
front-coded, and merged by loser trees that know common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import _TABLE, _powers, documents, mix64, signed, stored, text_chunks

#: Bytes of the string at an anchor; among the grams of each window the least hash is its anchor.
GRAM = 32
#: Bytes of a long text that are looked at together, and of a position in a packed number.
BLOCK, POSITION_BITS = 1 << 22, 26
#: Suffixes that one task merges, about.
MERGED = 40_000


# --- anchors -----------------------------------------------------------------------

def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(1 << max(20, len(data).bit_length()))
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[data] * power[:len(data)])]), inverse


def _string_hashes(sums: np.ndarray, inverse: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are the least, the last of equal
    ones, in any ``length`` bytes of ``data``. They hang on those bytes alone,
    so equal strings have equal anchors."""
    grams = len(data) - GRAM + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums, inverse = _prefix_sums(data)
    at = np.arange(grams)
    hashes = _string_hashes(sums, inverse, at, at + GRAM)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    least = (hashes & ~mask) | (mask - at.astype(np.uint64))
    span, width = 1, length - GRAM + 1
    while span * 2 <= width:  # minima of windows of doubling width
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    found = np.unique((mask - (least & mask)).astype(np.int64))
    return found, hashes[found]


def _document_anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes and context hashes. An anchor's context are the
    bytes of all strings of ``length`` that hold its gram."""
    data = np.frombuffer(text, np.uint8)
    reach, parts = length - GRAM, []
    for start in range(0, max(1, len(data) - length + 1), BLOCK):
        low, high = max(0, start - reach), min(len(data), start + BLOCK + 2 * length)
        piece = data[start:min(len(data), start + BLOCK + length - 1)]
        found, grams = anchors(piece, length)
        found = found + start
        sums, inverse = _prefix_sums(data[low:high])
        lo, hi = np.maximum(found - reach, 0) - low, np.minimum(found + length, len(data)) - low
        context = _string_hashes(sums, inverse, lo, hi) + mix64((found - low - lo).astype(np.uint64))
        parts.append((found, grams, context))
    found, grams, context = (np.concatenate(x) for x in zip(*parts, strict=True))
    found, first = np.unique(found, return_index=True)
    return found, grams[first], context[first]


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            long_enough = [i for i, t in enumerate(texts) if len(t) >= length]
            if not long_enough:
                continue
            found = [_document_anchors(texts[i], length) for i in long_enough]
            keys = np.repeat(batch.column(0).to_numpy()[long_enough], [len(f[0]) for f in found])
            at, grams, context = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(signed(grams)), pa.array(signed(context)), pa.array(keys), pa.array(at)], ["gram", "context", "key", "at"])
    return run


# --- sorted runs ---------------------------------------------------------------------

def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree in ``known`` bytes."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - (-(-(int.from_bytes(x) ^ int.from_bytes(y)).bit_length() // 8))


def front_coded(suffixes: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Of sorted strings below 65536 bytes: the lengths they share with the one
    before, their own lengths, and what follows the shared part."""
    shared, tails, before = [], [], b""
    for s in suffixes:
        n = common_prefix(before, s, 0)
        shared.append(n)
        tails.append(s[n:])
        before = s
    return np.array(shared, "<u2").tobytes(), np.array([len(s) for s in suffixes], "<u2").tobytes(), b"".join(tails)


@dataclass
class Run:
    """A front-coded run that is read string by string."""

    shared: list[int]
    sizes: list[int]
    tails: bytes
    place: int = -1
    offset: int = 0
    string: bytes | None = b""
    lcp: int = 0  # with the string that left the tree last

    def next(self) -> None:
        self.place += 1
        if self.place == len(self.sizes):
            self.string, self.lcp = None, -1
            return
        self.lcp = self.shared[self.place]
        end = self.offset + self.sizes[self.place] - self.lcp
        self.string = self.string[:self.lcp] + self.tails[self.offset:end]
        self.offset = end


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, place, common prefix with the string before) in sorted order.

    A loser tree over the runs. Each waiting string knows the prefix it shares
    with the last one out: of two the longer one is the smaller, and only at
    equal lengths are bytes compared, from there on; the loser then keeps what
    it shares with the winner. No known prefix is compared again."""
    size = 1
    while size < len(runs):
        size *= 2
    for r in runs:
        r.next()
        r.lcp = 0 if r.string is not None else -1  # nothing is known yet of different runs
    runs = [*runs, *[Run([], [], b"", string=None, lcp=-1) for _ in range(size - len(runs))]]
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = runs[a], runs[b]
        if x.lcp != y.lcp:
            return (a, b) if x.lcp > y.lcp else (b, a)
        if x.string is None:
            return a, b
        n = common_prefix(x.string, y.string, x.lcp)
        first = n == len(x.string) or n < len(y.string) and x.string[n] < y.string[n]
        (y if first else x).lcp = n
        return (a, b) if first else (b, a)

    winners = list(range(size))
    node = size
    while len(winners) > 1:
        node //= 2
        played = [play(winners[2 * i], winners[2 * i + 1]) for i in range(node)]
        losers[node:2 * node] = [p[1] for p in played]
        winners = [p[0] for p in played]
    top = winners[0]
    while runs[top].string is not None:
        yield top, runs[top].place, runs[top].lcp
        runs[top].next()
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def covered(order_lcp: np.ndarray, rights: np.ndarray, lefts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes with the bytes to their left, read outwards: the
    most and the fewest bytes to the left of an anchor with which a string of
    ``length`` over it occurs with another anchor too; -1 if none.

    A string with d bytes to the left is the same for two anchors if their
    suffixes share length - d bytes, so stand in one stretch of such common
    prefixes, and the d bytes are the same."""
    n, reach = len(lefts), length - GRAM
    sizes = np.array([len(x) for x in lefts])
    table = np.zeros((n, reach), np.uint8)
    for i, x in enumerate(lefts):
        table[i, :len(x)] = np.frombuffer(x, np.uint8)
    power, _ = _powers(1 << 20)
    most, fewest = np.full(n, -1), np.full(n, -1)
    left = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for d in range(reach + 1):
            if d:
                left = left + _TABLE[table[:, d - 1]] * power[d]
            may = np.flatnonzero((sizes >= d) & (rights >= length - d))
            stretch = np.cumsum(order_lcp < length - d)[may].astype(np.uint64)
            _, back, count = np.unique(mix64(mix64(stretch) + left[may]), return_inverse=True, return_counts=True)
            hit = may[count[back] > 1]
            most[hit] = d
            fewest[hit] = np.where(fewest[hit] < 0, d, fewest[hit])
    return most, fewest


def _runs(length: int, ranges: int):
    """From texts with anchors to a task's sorted, front-coded runs, one a range of grams."""
    reach = length - GRAM

    def out(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda x: (x[0], x[1]))
        rows, start = [], 0
        for i in range(1, len(held) + 1):
            if i == len(held) or held[i][0] != held[start][0]:
                part = held[start:i]
                lefts = [x[2] for x in part]
                rows.append((part[0][0], *front_coded([x[1] for x in part]), np.array([len(x) for x in lefts], "<u2").tobytes(), b"".join(lefts),
                             np.array([x[3] for x in part], "<i8").tobytes(), np.array([x[4] for x in part], "<i8").tobytes(), bytes(x[5] for x in part)))
                start = i
        kinds = [pa.int32(), *[pa.binary()] * 8]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          ["range", "shared", "sizes", "tails", "left_sizes", "lefts", "keys", "ats", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch, texts in text_chunks(batches):
            for key, points, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts, strict=True):
                for p in points:
                    a = p["at"]
                    held.append((p["gram"] % ranges, text[a:a + length], text[max(0, a - reach):a][::-1], key, a, p["open"]))
            if len(held) > 100_000:
                yield out(held)
                held = []
        if held:
            yield out(held)
    return run


def _merged(length: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        runs, lefts, keys, ats, is_open = [], [], [], [], []
        for r in part.itertuples():
            runs.append(Run(np.frombuffer(r.shared, "<u2").tolist(), np.frombuffer(r.sizes, "<u2").tolist(), r.tails))
            edges = np.concatenate([[0], np.cumsum(np.frombuffer(r.left_sizes, "<u2").astype(np.int64))]).tolist()
            lefts.append([r.lefts[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)])
            keys.append(np.frombuffer(r.keys, "<i8"))
            ats.append(np.frombuffer(r.ats, "<i8"))
            is_open.append(np.frombuffer(r.open, np.uint8))
        order = list(merge(runs))
        which, place, lcp = (np.array(x) for x in zip(*order, strict=True))
        flat = which_offsets(runs)[which] + place
        most, fewest = covered(lcp, np.array([runs[r].sizes[p] for r, p, _ in order]), [lefts[r][p] for r, p, _ in order], length)
        at, hit = np.concatenate(ats)[flat], (most >= 0) & (np.concatenate(is_open)[flat] > 0)
        return pd.DataFrame({"key": np.concatenate(keys)[flat][hit], "lo": (at - most)[hit], "hi": (at - fewest + length)[hit]})
    return run


def which_offsets(runs: list[Run]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(r.sizes) for r in runs])])[:-1]


# --- the operator ------------------------------------------------------------------

def spans(covers: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes below ``n``."""
    out: list[list[int]] = []
    for lo, hi in sorted(covers):
        lo, hi = max(lo, 0), min(hi, n)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif lo < hi:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def repeated(docs: DataFrame, length: int = 200) -> DataFrame:
    """key, lo, hi: bytes lo to hi of the text of the rows with that key
    (xxhash64 of doc_id and text) are covered by strings of ``length`` bytes
    that start anywhere else too. Together the rows cover all such bytes.

    Suffixes are taken at anchors, which each string of ``length`` bytes has
    and shares with its copies. Anchors whose gram occurs once are done. So
    are those whose whole context occurs twice: all of it is covered. Of the
    rest, and one for each context they may meet, the suffixes are sorted in
    runs, exchanged front-coded and merged; the common prefixes that come out
    of the merge, with the bytes to the left, give the strings that agree.
    All counts are partial sums before they are shuffled, and a context that
    many rows share is sorted once.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    points = keyed.mapInArrow(_anchor_rows(length), "gram long, context long, key long, at long")
    # stored, so that the join is of two plain exchanges and Spark can split a gram of many rows
    twice = stored(points.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "suffix-twice")
    shared = stored(points.join(twice, "gram"), "suffix-anchors")
    contexts = shared.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("first"))
    contexts = stored(contexts.select("gram", "context", "n", "first.key", "first.at"), "suffix-contexts")
    many = contexts.filter("n > 1").select("gram", "context")
    reach = length - GRAM
    whole = shared.join(many, ["gram", "context"]).select("key", (F.col("at") - reach).alias("lo"), (F.col("at") + length).alias("hi"))

    meeting = contexts.groupBy("gram").agg(F.count_if(F.col("n") == 1).alias("open"), F.count("*").alias("m")).filter("open > 0 AND m > 1").select("gram")
    wanted = stored(contexts.join(meeting, "gram").select("key", "at", "gram", (F.col("n") == 1).cast("int").alias("open")), "suffix-wanted")
    ranges = max(1, -(-wanted.count() // MERGED))
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("at", "gram", "open")).alias("points")).withColumnRenamed("key", "_key")
    once = keyed.join(per_text, F.col("key") == F.col("_key")).select("key", "text", "points")
    runs = once.mapInArrow(_runs(length, ranges), "range int, shared binary, sizes binary, tails binary, left_sizes binary, lefts binary, keys binary, ats binary, open binary")
    partly = runs.groupBy("range").applyInPandas(_merged(length), "key long, lo long, hi long")
    return stored(whole.unionByName(partly), "suffix-covered")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches):
        rows = []
        for t, covers in zip(texts, batch.column(2).to_pylist(), strict=True):
            gone = spans([(c["lo"], c["hi"]) for c in covers or ()], len(t))
            edges = [0, *(x for s in gone for x in s), len(t)]
            kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(t), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest(), kept))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary): each
    text, as UTF-8 bytes, without the bytes that ``repeated`` finds.

    What is left need not be UTF-8. Texts shorter than ``length`` stay whole;
    a null text is empty. Equal rows are each other's repeats; a null doc_id
    is a value like others. Other columns are not read.
    """
    found = repeated(docs, length).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("covers")).withColumnRenamed("key", "_key")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    joined = keyed.join(found, F.col("key") == F.col("_key"), "left").select("doc_id", "text", "covers")
    return joined.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


OP1_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT k, h, unnest(generate_series(0, length(h) // 2 - 200)) AS i FROM d WHERE length(h) >= 400
), w AS (
  SELECT k, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM s
), c AS (
  SELECT k, i, count(*) OVER (PARTITION BY m) AS n FROM w
), g AS (
  SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 200 THEN 0 ELSE 1 END AS new_run FROM c WHERE n > 1
), r AS (
  SELECT k, i, sum(new_run) OVER (PARTITION BY k ORDER BY i) AS run FROM g
), x AS (
  SELECT k, run, min(i) AS lo, max(i) + 200 AS hi FROM r GROUP BY k, run
), y AS (
  SELECT x.k, x.lo, x.hi, coalesce(lag(x.hi) OVER (PARTITION BY x.k ORDER BY x.lo), 0) AS since FROM x
), z AS (
  SELECT y.k, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last,
         string_agg(substr(d.h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS pieces
  FROM y JOIN d ON y.k = d.k GROUP BY y.k
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(z.n_removed, 0)::BIGINT AS n_removed,
       coalesce(z.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(z.pieces, '') || substr(d.h, (2 * coalesce(z.last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN z ON d.k = z.k
"""
