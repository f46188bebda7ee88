"""Interpolated modified Kneser-Ney language model of word pairs, counted in
Spark, kept as sorted arrays in the shared folder and memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.llm.common import documents, mix64, remainder, signed, stored, text_chunks, word_hashes
from reviewlab.session import scratch_path

#: The end of a text, as a word's hash.
END = np.uint64(0x1D8AF066D1F2E3C5)
#: Words of a unigram file, ids of a continuation file, pairs that a task
#: holds before it passes them on, and training tokens for each pair file.
FILE_WORDS, FILE_IDS, HELD_PAIRS, FILE_TOKENS = 1 << 21, 1 << 21, 1 << 21, 1 << 22


# --- arrays in the shared folder -----------------------------------------------------

def _local(path: str) -> str | None:
    parsed = urlparse(path)
    return parsed.path if parsed.scheme in ("", "file") else None


def save(path: str, array: np.ndarray) -> str:
    """Writes an array as a file of its own; each attempt of a task has another name."""
    path = f"{path}-{uuid.uuid4().hex}.npy"
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as f:
            np.save(f, array)
    else:
        from pyarrow import fs
        store, at = fs.FileSystem.from_uri(path)
        with store.open_output_stream(at) as f:
            np.save(f, array)
    return path


@lru_cache(maxsize=1024)
def load(path: str) -> np.ndarray:
    """The array of a file, memory-mapped; a remote file is copied once for each worker."""
    local = _local(path)
    if local is None:
        from pyarrow import fs
        store, at = fs.FileSystem.from_uri(path)
        local = os.path.join(tempfile.mkdtemp(), "array.npy")
        with store.open_input_stream(at) as source, open(local, "wb") as f:
            while block := source.read(1 << 24):
                f.write(block)
    return np.load(local, mmap_mode="r")


def packed(keys: np.ndarray) -> bytes:
    """Rising keys as differences, byte plane by byte plane, which compress well."""
    steps = np.diff(keys, prepend=keys.dtype.type(0))
    return steps.view(np.uint8).reshape(-1, keys.dtype.itemsize).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


# --- the model -----------------------------------------------------------------------

@dataclass
class Model:
    """Where the arrays are; a few numbers for each file, so it fits a closure.

    Word ids are places in the rising order of all training words' hashes;
    the start of a text has the id after the last. A pair's file hangs on its
    first word, so all of a context is in one file."""

    words: list[tuple[int, int, str, str]] = field(default_factory=list)  # first hash, first id, hashes, counts
    tokens: int = 0
    distinct: int = 0
    pairs: list[tuple] = field(default_factory=list)  # keys, counts, contexts, context sums
    following: list[str] = field(default_factory=list)  # how many words a word follows, by id
    pair_counts: tuple = (0, 0, 0, 0)  # pairs seen 1, 2, 3, 4 times
    word_counts: tuple = (0, 0, 0, 0)  # words that follow 1, 2, 3, 4 words
    followers: int = 0  # words that follow any
    follow_sum: int = 0  # and how many, in all

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words, -1 for those not in training."""
        out = np.full(len(hashes), -1, np.int64)
        if not self.words:
            return out
        file = np.searchsorted(np.array([w[0] for w in self.words], np.uint64), hashes, side="right") - 1
        for f in np.unique(file[file >= 0]):
            at = np.flatnonzero(file == f)
            table = load(self.words[f][2])
            place = np.minimum(np.searchsorted(table, hashes[at]), len(table) - 1)
            hit = table[place] == hashes[at]
            out[at[hit]] = self.words[f][1] + place[hit]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of words by id, 0 for -1."""
        out = np.zeros(len(ids), np.int64)
        starts = np.array([w[1] for w in self.words], np.int64)
        file = np.searchsorted(starts, ids, side="right") - 1
        for f in np.unique(file[ids >= 0]):
            at = np.flatnonzero((file == f) & (ids >= 0))
            out[at] = load(self.words[f][3])[ids[at] - starts[f]]
        return out

    @staticmethod
    def discounts(n: tuple) -> np.ndarray:
        """What is taken from counts 0, 1, 2, and 3 or more."""
        n1, n2, n3, n4 = n
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        ratios = [n2 / n1 if n1 else 0.25, n3 / n2 if n2 else 0.25, n4 / n3 if n3 else 0.25]
        return np.array([0.0, *(min(max(k - (k + 1) * y * r, 0.05), k - 0.05) for k, r in zip((1, 2, 3), ratios, strict=True))])

    def _following(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for f in np.unique(ids[ids >= 0] // FILE_IDS):
            if path := self.following[f]:
                at = np.flatnonzero((ids >= 0) & (ids // FILE_IDS == f))
                table, place = load(path), ids[at] % FILE_IDS
                out[at] = table[place]
        return out

    def log10(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 probability of each word after the one before it. A word that
        follows few words gets little where the pair is new; all words not in
        training share one place in the uniform distribution below."""
        low = self._following(ids)
        d = self.discounts(self.word_counts)
        total = max(self.follow_sum, 1)
        rest = d[1] * self.word_counts[0] + d[2] * self.word_counts[1] + d[3] * (self.followers - sum(self.word_counts[:2]))
        shared = (rest / total if self.follow_sum else 1.0) / (self.distinct + 1)
        p = (low - d[np.minimum(low, 3)]) / total + shared
        d = self.discounts(self.pair_counts)
        files = len(self.pairs)
        if files:
            shard = (mix64(before.astype(np.uint64)) % np.uint64(files)).astype(np.int64)
            for f in np.unique(shard[before >= 0]):
                at = np.flatnonzero((shard == f) & (before >= 0))
                keys, counts, contexts, sums = map(load, self.pairs[f])
                if not len(contexts):
                    continue
                place = np.minimum(np.searchsorted(contexts, before[at]), len(contexts) - 1)
                seen = contexts[place] == before[at]
                at, place = at[seen], place[seen]
                size, n1, n2, n3 = sums[place].T.astype(np.float64)
                back = (d[1] * n1 + d[2] * n2 + d[3] * n3) / size
                wanted = (before[at].astype(np.uint64) << np.uint64(32)) | (ids[at] & 0xFFFFFFFF).astype(np.uint64)
                spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                c = np.where((keys[spot] == wanted) & (ids[at] >= 0), counts[spot], 0).astype(np.int64)
                p[at] = (c - d[np.minimum(c, 3)]) / size + back * p[at]
        return np.log10(p)


def with_ends(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words with an end after each text, and where the texts begin."""
    return np.insert(hashes, begins[1:], END), begins + np.arange(len(begins))


def _before(ids: np.ndarray, begins: np.ndarray, start: int) -> np.ndarray:
    out = np.concatenate([[start], ids[:-1]])
    out[begins[:-1]] = start
    return out


def train(docs: DataFrame, name: str = "lm") -> Model:
    """The model of the texts of ``docs``.

    Tasks add up their own words and pairs before any shuffle. Words are
    sorted by hash, pairs meet by first word, and each task writes its part
    of the model to the shared folder, so neither the driver nor a task ever
    holds all of it. Null and empty texts count as an end alone. An empty
    table gives a model in which all words are alike.
    """
    spark = docs.sparkSession
    base = scratch_path(spark, name)
    texts = docs.select("text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for _, chunk in text_chunks(batches):
            waiting.append(np.unique(with_ends(*word_hashes(chunk))[0], return_counts=True))
            if sum(len(w[0]) for w in waiting) > len(held) + (1 << 18):
                held, counts = merged(np.concatenate([held, *(w[0] for w in waiting)]), np.concatenate([counts, *(w[1] for w in waiting)]))
                waiting = []
            if len(held) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(signed(held)), pa.array(counts)], ["h", "c"])
                held, counts = held[:0], counts[:0]
        held, counts = merged(np.concatenate([held, *(w[0] for w in waiting)]), np.concatenate([counts, *(w[1] for w in waiting)]))
        yield pa.RecordBatch.from_arrays([pa.array(signed(held)), pa.array(counts)], ["h", "c"])

    def word_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            hashes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            yield pa.RecordBatch.from_pylist([{"first": int(hashes[:1].view(np.int64)[0]), "n": len(hashes), "tokens": int(counts.sum()),
                                               "hashes": save(f"{base}/words", hashes), "counts": save(f"{base}/counts", counts)}])

    vocabulary = stored(texts.mapInArrow(words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), f"{name}-words")
    n = vocabulary.count()
    if n >= 2**32 - 1:
        raise ValueError("a word's id must fit 32 bits")
    manifest = (vocabulary.repartitionByRange(max(1, -(-n // FILE_WORDS)), F.col("h") < 0, "h")  # as unsigned numbers
                .mapInArrow(word_files, "first long, n long, tokens long, hashes string, counts string").collect())
    model, at = Model(distinct=n, tokens=sum(r["tokens"] for r in manifest)), 0
    for r in sorted(manifest, key=lambda r: r["first"] % 2**64):
        model.words.append((r["first"] % 2**64, at, r["hashes"], r["counts"]))
        at += r["n"]
    files = max(1, -(-model.tokens // FILE_TOKENS))
    known = Model(words=list(model.words), distinct=n)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held, counts):
            shard = (mix64(held >> np.uint64(32)) % np.uint64(files)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(files + 1))
            rows = [(f, packed(held[order[a:b]]), np.ascontiguousarray(counts[order[a:b]].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
                    for f, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                              ["shard", "keys", "counts"])

        held, counts, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for _, chunk in text_chunks(batches):
            hashes, begins = with_ends(*word_hashes(chunk))
            ids = known.ids(hashes)
            keys = (_before(ids, begins, n).astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
            waiting.append(np.unique(keys, return_counts=True))
            if sum(len(w[0]) for w in waiting) > max(len(held), 1 << 19):
                held, counts = merged(np.concatenate([held, *(w[0] for w in waiting)]), np.concatenate([counts, *(w[1] for w in waiting)]))
                waiting = []
            if len(held) > HELD_PAIRS:
                yield out(held, counts)
                held, counts = held[:0], counts[:0]
        held, counts = merged(np.concatenate([held, *(w[0] for w in waiting)]), np.concatenate([counts, *(w[1] for w in waiting)]))
        if len(held):
            yield out(held, counts)

    def pair_files(part: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged(np.concatenate([unpacked(k, np.uint64) for k in part["keys"]]),
                              np.concatenate([np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for c in part["counts"]]))
        context = (keys >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        sums = np.stack([np.add.reduceat(x, first) for x in (counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts >= 3).astype(np.int64))], 1)
        paths = [save(f"{base}/{k}", a) for k, a in (("keys", keys), ("pair-counts", counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.uint64)), ("contexts", context[first]), ("sums", sums))]
        rows = [(0, int(part["shard"].iloc[0]), b"", b"", paths, np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist())]
        second, follows = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        block = second // FILE_IDS
        for b in np.unique(block):
            at = block == b
            rows.append((1, int(b), packed(second[at]), follows[at].astype("<u4").tobytes(), [], []))
        return pd.DataFrame(rows, columns=["kind", "part", "ids", "follows", "paths", "numbers"])

    def follow_files(part: pd.DataFrame) -> pd.DataFrame:
        b = int(part["part"].iloc[0])
        table = np.zeros(min(FILE_IDS, n - b * FILE_IDS), np.uint32)
        for ids, follows in zip(part["ids"], part["follows"], strict=True):
            table[unpacked(ids, np.int64) - b * FILE_IDS] += np.frombuffer(follows, "<u4")
        seen = np.bincount(np.minimum(table, 5), minlength=6)[1:5].tolist()
        return pd.DataFrame([(b, save(f"{base}/follow", table), [*seen, int((table > 0).sum()), int(table.sum(dtype=np.int64))])], columns=["part", "path", "numbers"])

    written = stored(texts.mapInArrow(pairs, "shard int, keys binary, counts binary").groupBy("shard").applyInPandas(
        pair_files, "kind int, part int, ids binary, follows binary, paths array<string>, numbers array<long>"), f"{name}-pairs")
    found = {r["part"]: r for r in written.filter("kind = 0").select("part", "paths", "numbers").collect()}  # one row a file
    nothing = None
    for f in range(files):
        if f not in found:
            nothing = nothing or tuple(save(f"{base}/none", x) for x in (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros((0, 4), np.int64)))
        model.pairs.append(tuple(found[f]["paths"]) if f in found else nothing)
    model.pair_counts = tuple(sum(r["numbers"][i] for r in found.values()) for i in range(4))
    follow = {r["part"]: r for r in written.filter("kind = 1").select("part", "ids", "follows").groupBy("part")
              .applyInPandas(follow_files, "part int, path string, numbers array<long>").collect()}
    model.following = [follow[b]["path"] if b in follow else "" for b in range(-(-(n + 1) // FILE_IDS))]
    numbers = [sum(r["numbers"][i] for r in follow.values()) for i in range(6)]
    model.word_counts, model.followers, model.follow_sum = tuple(numbers[:4]), numbers[4], numbers[5]
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score: log10
    probabilities of the whole text, by smoothed word frequencies and by the
    model. A null or empty text is an end alone. Other columns stay; those
    named like a result are replaced."""
    made = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    docs = docs.drop(*(m for m, _ in made))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = model.tokens + 0.5 * (model.distinct + 1)
        for batch, texts in text_chunks(batches):
            hashes, begins = with_ends(*word_hashes(texts))
            ids = model.ids(hashes)
            counts = model.counts(ids)
            at = begins[:-1]
            values = (np.diff(begins), np.add.reduceat((counts > 0).astype(np.int64), at), np.add.reduceat(np.log10((counts + 0.5) / below), at),
                      np.add.reduceat(model.log10(_before(ids, begins, model.distinct), ids), at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, (_, k) in zip(values, made, strict=True))],
                                             [*batch.schema.names, *(m for m, _ in made)])

    return docs.mapInArrow(run, schema)


def op8_lm(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs.filter(remainder("doc_id", 5) != 1))
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known",
                                     F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
