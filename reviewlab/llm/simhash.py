"""Near-duplicates by SimHash fingerprints, found by chains of equal or nearly
equal segments around the ring of a fingerprint's bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import documents, stored, text_chunks
from reviewlab.llm.graph import components

SEED = 42
#: Members of a bucket up to which pairs are compared; larger ones are split further.
HOT = 32
#: Bytes of a text that are cut into words at once; hashes whose bits are counted at once.
PIECE, COUNTED = 1 << 20, 8192
#: All bits of a Spark long.
ALL = (1 << 64) - 1


# --- fingerprints ------------------------------------------------------------------

def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of all runs of ``width`` words (A-Z as a-z), joined by single
    spaces, repeats included; of the whole sequence if it is shorter."""
    folded, at, carried, any_run = text.lower(), 0, [], False
    while at < len(folded):
        end = at + PIECE  # words are never cut: white space follows, or the end
        while end < len(folded) and not folded[end:end + 1].isspace():
            end += 1
        words = carried + folded[at:end].split()
        at = end
        if len(words) >= width:
            line = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            begins = (ends - sizes)[:len(words) - width + 1].tolist()
            yield np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(begins, ends[width - 1:].tolist(), strict=True)], np.uint64)
            any_run = True
        carried = words[max(0, len(words) - width + 1):]
    if carried and not any_run:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bit b is 1 if it is set in over half of the text's hashes; 0 without words."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, width):
        total += len(hashes)
        for at in range(0, len(hashes), COUNTED):
            some = hashes[at:at + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _print_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            prints = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "print"])
    return run


# --- links -------------------------------------------------------------------------

def _long(bits: int) -> int:
    """The signed 64-bit number of these bits."""
    return bits - (1 << 64) if bits >> 63 else bits


def _mask(positions) -> int:
    return sum(1 << p for p in positions)


def _bits(masks: list[int]):
    return F.array(*[F.lit(_long(m)).cast("long") for m in masks])


def links(prints: DataFrame, distance: int = 2, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between ids of ``prints`` (id long, print long, distinct)
    that connect all pairs of at most ``distance`` (0 to 2) differing bits, and no others.

    The 64 bits are cut into distance + 1 segments on a ring. If two prints
    differ in at most ``distance`` bits, some chain of segments has at most l - 1
    differences in its first l segments, for every l. So its first segment is
    equal, and of the next, with one difference at most, one half is: these
    bits are a bucket's key, and each print stands in two buckets a segment.
    Pairs in a bucket must pass the chain's longer budgets before the whole
    prints are compared.

    A bucket of over ``hot`` members is not paired but split by all choices of
    the bits that may still differ: what agrees in all other bits is within
    the distance, so that edges to the smallest id join it.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0 to 2")
    count = distance + 1
    if not distance:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    segments = [list(range(64 * i // count, 64 * (i + 1) // count)) for i in range(count)]
    chains = [[segments[(i + j) % count] for j in range(count)] for i in range(count)]  # from segment i around the ring
    keys = [first + half for first, second, *_ in chains for half in (second[:len(second) // 2], second[len(second) // 2:])]

    way = F.explode(F.array(*[F.struct(F.lit(n).alias("way"), F.col("print").bitwiseAND(F.lit(_long(_mask(k))).cast("long")).alias("held")) for n, k in enumerate(keys)]))
    placed = prints.select("id", "print", way.alias("w")).select("id", "print", "w.way", "w.held")
    # stored, so that the join is of two plain exchanges and Spark can split a bucket of many rows
    shared = stored(placed.groupBy("way", "held").agg(F.count("*").alias("m")).filter("m > 1"), "simhash-shared")
    open_ = stored(placed.join(shared, ["way", "held"]), "simhash-open")

    few = open_.filter(F.col("m") <= hot)
    left = few.select("way", "held", F.col("id").alias("a"), F.col("print").alias("pa"))
    right = few.select("way", "held", F.col("id").alias("b"), F.col("print").alias("pb"))
    apart = F.col("pa").bitwiseXOR(F.col("pb"))
    near = F.bit_count(apart) <= distance
    for n in range(2, count):  # the first n segments of the chain
        around = _bits([_mask(sum(chains[w // 2][:n], [])) for w in range(len(keys))])
        near = (F.bit_count(apart.bitwiseAND(F.element_at(around, F.col("way") + 1))) <= n - 1) & near
    edges = left.join(right, ["way", "held"]).filter("a < b").filter(near).select("a", "b")

    many = open_.filter(F.col("m") > hot)
    for n, k in enumerate(keys):
        free = [b for b in range(64) if b not in k]
        kept = _bits([ALL ^ _mask(c) for c in combinations(free, distance)])
        split = (many.filter(F.col("way") == n).select("id", "print", F.posexplode(kept).alias("choice", "kept"))
                 .select("id", "choice", F.col("print").bitwiseAND(F.col("kept")).alias("held")))
        # only the freed bits differ, so a group has 2 ** distance members at most
        met = split.groupBy("choice", "held").agg(F.min("id").alias("a"), F.collect_set("id").alias("ids")).filter(F.size("ids") > 1)
        edges = edges.unionByName(met.select("a", F.explode("ids").alias("b")).filter("a < b"))
    return edges.distinct()


# --- the operator ------------------------------------------------------------------

def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row.

    The fingerprint is taken over the XXH64 (seed 42) of all runs of ``width``
    lower-cased words, repeats included. Documents whose fingerprints differ in
    at most ``distance`` bits are linked; a component's id is the smallest doc_id
    in it. Equal fingerprints are one before anything is compared.

    A null or empty text has fingerprint 0 and is linked like any other. Rows
    with one doc_id are one document of several texts. A row without doc_id
    has a fingerprint, links nothing and has no component. Other columns are
    not read; an empty table gives no rows.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_print_rows(width), "doc_id long, print long"), "simhash")
    named = rows.filter("doc_id IS NOT NULL")
    distinct = stored(named.groupBy("print").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    placed = stored(named.join(distinct, "print"), "simhash-placed")
    # a document of several fingerprints joins them
    several = (placed.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("doc_id", "lo"))
    bridges = placed.join(several, "doc_id").filter("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct()
    # the smallest doc_id of several fingerprints may be the same document
    found = stored(components(stored(links(distinct, distance).unionByName(bridges), "simhash-links")), "simhash-found")
    joined = placed.join(found, F.col("id") == F.col("node"), "left").select("doc_id", "print", F.coalesce("component", "id").alias("component_id"))
    none = rows.filter("doc_id IS NULL").select("doc_id", "print", F.lit(None).cast("long").alias("component_id"))
    return joined.unionByName(none).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
