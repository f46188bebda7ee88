"""Near-duplicates: one-permutation MinHash with optimal densification, banded
buckets, star-shaped candidate edges, and an exact check on whole sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import combine, documents, free_name, mix64, shingle_sets, signed, stored, text_chunks
from reviewlab.llm.graph import components

#: A pair at 0.85 shares no band with probability (1 - 0.85**5)**24, below one in a million.
BANDS, ROWS = 24, 5
#: Members of a group, and their shingles in all, of which two such blocks are compared in a task.
BLOCK, HELD = 2048, 1 << 20


# --- signatures --------------------------------------------------------------------

@lru_cache(maxsize=4)
def _sources(bins: int, tries: int = 4096) -> np.ndarray:
    """For each bin the order in which it looks for a full one to copy."""
    return np.random.default_rng(bins).integers(0, bins, (bins, tries), dtype=np.int16)


@lru_cache(maxsize=4)
def _edges(bins: int) -> np.ndarray:
    return np.array([(i << 64) // bins for i in range(bins)], np.uint64)


def signature(members: np.ndarray, bins: int) -> np.ndarray:
    """One minimum a bin of the sorted set ``members``; an empty bin copies
    from the first full one of its own random sequence."""
    at = np.append(np.searchsorted(members, _edges(bins)), len(members))
    full = at[:-1] < at[1:]
    out = np.zeros(bins, np.uint64)
    out[full] = members[at[:-1][full]]
    empty, sources, step = np.flatnonzero(~full), _sources(bins), 0
    while len(empty) and step < sources.shape[1]:
        take = sources[empty, step:step + 16]
        hit = full[take]
        found = hit.any(1)
        out[empty[found]] = out[take[found, hit[found].argmax(1)]]
        empty, step = empty[~found], step + 16
    out[empty] = members[0] if len(members) else 0
    return out


def band_keys(members: np.ndarray, bands: int, rows: int) -> np.ndarray:
    table = signature(members, bands * rows).reshape(bands, rows)
    return combine([*table.T, np.arange(bands, dtype=np.uint64)])


def _signed_rows(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            sets = shingle_sets(texts, width)
            with np.errstate(over="ignore"):
                one = np.array([mix64(s).sum() for s in sets], np.uint64)
                two = np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum() for s in sets], np.uint64)
            keys = [signed(band_keys(s, bands, rows)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(one)), pa.array(signed(two)),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "one", "two", "bands"])
    return run


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            sets = shingle_sets(texts, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "members"])
    return run


# --- exact check -------------------------------------------------------------------

def _check(percent: int):
    """Keeps the rows whose two sets have 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                a, b = np.frombuffer(left[i].as_py(), np.uint64), np.frombuffer(right[i].as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))
    return run


def _block_links(ids: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different components of a group's members. Every pair
    of two components has a member outside the largest one, so those members
    are counted against all others, through postings."""
    sizes = np.array([len(s) for s in sets])
    _, root, members = np.unique(label, return_inverse=True, return_counts=True)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(ids[0], ids[1])] if 100 * both >= percent * (sizes.sum() - both) else []
    every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(every)))])
    posting = np.repeat(np.arange(len(sets)), sizes)[np.argsort(inverse, kind="stable")]
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i in np.flatnonzero(root != members.argmax()):
        terms = inverse[at[i]:at[i + 1]]
        both = np.bincount(np.concatenate([posting[begin[t]:begin[t + 1]] for t in terms]), minlength=len(sets))
        for j in np.flatnonzero((100 * both >= percent * (sizes[i] + sizes - both)) & (root != root[i])):
            if root[j] != root[i]:
                out.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return out


def _links_in_blocks(percent: int):
    """Compares the pairs that no link joins yet, in the task; only links that
    join two components leave it."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, group in part.groupby("hub", sort=False):
            label = group["component"].to_numpy()
            if (label != label[0]).any():
                out += _block_links(group["id"].to_numpy(), label, [np.frombuffer(m, np.uint64) for m in group["members"]], percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


# --- the operator ------------------------------------------------------------------

def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets (distinct runs of ``width`` words; the whole
    sequence if shorter) have 100 * intersection >= percent * union are
    linked; a component's id is its smallest doc_id and its document is kept.

    Equal sets are first made one. Each set's bands are its buckets, and in
    each bucket every member gets one edge, to the member that has most
    company over all its buckets: in a family of copies that is the one most
    like the others. Edges are checked on whole sets. Where the buckets of one
    hub still hold more than one component, they are searched: blocks of at
    most ``BLOCK`` members and ``HELD`` shingles against each other, and only
    links that join components written. So each pair that shares a band ends in one
    component if it is linked, and rows stay in proportion to members.

    A null or empty text has no shingles and is linked with nothing; so is a
    row without doc_id (component null, kept). Rows with one doc_id are one
    document of several texts. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    base = stored(docs.mapInArrow(_signed_rows(width, bands, rows), "doc_id long, n long, one long, two long, bands array<long>"), "minhash")
    linked = base.filter("n > 0 AND doc_id IS NOT NULL")
    equal = linked.groupBy("one", "two").agg(F.min("doc_id").alias("id"))
    same = stored(linked.select("doc_id", "one", "two").join(equal, ["one", "two"]).select("doc_id", "id"), "minhash-same")
    member = linked.join(same.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi")
    exploded = member.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")).distinct()
    # stored, so that the join is of two plain exchanges and Spark can split a bucket of many rows
    shared = stored(exploded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "minhash-shared")
    buckets = stored(exploded.join(shared, "key"), "minhash-buckets")

    company = buckets.groupBy("id").agg(F.sum("m").alias("company"))
    placed = buckets.join(company, "id")
    hub = stored(placed.groupBy("key").agg(F.max(F.struct("company", -F.col("id"))).alias("h")).select("key", (-F.col("h.col2")).alias("hub")), "minhash-hubs")
    edges = (buckets.join(hub, "key").filter("id <> hub")
             .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    wanted = buckets.select("id").distinct()
    sets = stored(docs.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(_set_rows(width), "id long, members binary"), "minhash-sets")
    # 100 * intersection <= 100 * smaller, so sizes alone rule some pairs out
    counts = base.select(F.col("doc_id").alias("id"), "n").distinct()
    pairs = (edges.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b").select("a", "b", "left", "right")
             .filter(F.least(F.length("left"), F.length("right")) * 100 >= F.greatest(F.length("left"), F.length("right")) * percent))
    links = stored(pairs.mapInArrow(_check(percent), "a long, b long"), "minhash-links")

    found = stored(components(links.unionByName(same.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))), "minhash-found")
    # buckets with one hub are searched as one: a pair in several counts once
    around = (buckets.join(hub, "key").select("hub", "id").distinct()
              .join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
              .join(counts, "id"))
    open_ = (around.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("held"))
             .filter("lo <> hi").select("hub", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("held") / HELD)).cast("int").alias("blocks"), "held"))
    rest = stored(around.drop("n").join(open_, "hub"), "minhash-open")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    # small groups share a task, by their shingles in all
    total = rest.select("hub", "held").distinct().agg(F.sum("held")).first()[0] or 0
    shard = F.pmod(F.xxhash64("hub"), F.lit(1 + total // HELD))
    tiled = rest.select(shard.alias("shard"), "hub", "id", "component", F.explode(tiles).alias("tile"))
    more = stored(tiled.join(sets, "id").groupBy("shard", "tile").applyInPandas(_links_in_blocks(percent), "a long, b long"), "minhash-more")
    final = found
    if not more.isEmpty():  # the links so far, as stars, and the new ones
        final = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.distinct()))
    return (base.join(final, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of
    the smallest doc_id, null last. Rows are told apart by a key of their own,
    so equal doc_ids and null ones keep no copies. A null or empty text is a
    copy of nothing."""
    row = free_name(docs.columns, "_row")
    # stored, so that the keys are the same whenever they are read
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "minhash-rows")
    own = keyed.select(F.col(row).alias("_row"), "doc_id", "text")
    found = near_duplicates(own.select(F.col("_row").alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias("_row"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "_row").alias("place")
    groups = stored(found.join(own.select("_row", place), "_row"), "minhash-groups")
    first = groups.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = groups.join(first, "component_id").filter(F.col("_row") != F.col("first._row")).select(F.col("_row").alias(row))
    return keyed.join(gone, row, "left_anti").select(*docs.columns)


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS t
  FROM d
), n AS (
  SELECT doc_id, len(t)::BIGINT AS n FROM s
), u AS (
  SELECT doc_id, unnest(t) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), sides AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), r(a, b) AS (
  SELECT a, b FROM sides UNION SELECT r.a, sides.b FROM r JOIN sides ON r.b = sides.a
), m AS (
  SELECT a, min(b) AS low FROM r GROUP BY a
)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM n LEFT JOIN m ON a = doc_id
"""
