"""Packing tokenised documents into windows by minimum bin slack."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reviewlab.llm.common import documents, text_chunks

WINDOW = 1024
#: Remainders that are packed together; what a task holds at once.
HELD_DOCUMENTS = 4096
#: Bytes of word encodings that a worker keeps, beyond which it starts anew, and what an entry takes besides.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 200
#: Bytes of text that are cut into words at once, and words that are encoded in a row.
TEXT_BYTES, JOINED = 2 << 20, 256

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
WITH_IDS = T.StructType([*PIECES.fields, T.StructField("ids", T.BinaryType())])


# --- token ids -------------------------------------------------------------------

#: Marks after a word that the tokenizer cuts off from its letters.
_MARKS = ".,;:!?#$%&*|()[]{}<>/\\\"=+-_~@^`"


def _open(word: str) -> bool:
    """Whether white space or nothing stands beside a space around the word:
    there the tokenizer's pieces may span the space."""
    return not word or word[0].isspace() or word[-1].isspace()


def _pieces(word: str) -> list[str]:
    """Strings that the byte-level tokenizer encodes apart and that make up
    ``" " + word``: it cuts around a single line end and between letters and
    marks. What is not plainly so stays whole."""
    lines = word.split("\n")
    if len(lines) > 1 and any(map(_open, lines)):
        return [" " + word]
    out = []
    for i, line in enumerate(lines):
        body = line.rstrip(_MARKS)
        lead = "\n" if i else " "
        if i:
            out.append("\n")
            lead = ""
        out += [lead + body, line[len(body):]] if body != line and body.isalpha() else [lead + line]
    return out


def _opens(words: pa.Array) -> np.ndarray:
    """``_open`` of each word, also true for controls at an end, which some call white space."""
    ends = pc.match_substring_regex(words, "^[\\x00-\\x20\\x7f-\\x{9f}]|[\\x00-\\x20\\x7f-\\x{9f}]$|^$")
    return pc.or_(ends, pc.not_equal(pc.utf8_trim_whitespace(words), words)).to_numpy(zero_copy_only=False)


class _Ids:
    """Id sequences one after the other, each with a number."""

    def __init__(self):
        self.ids, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.count = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Several sequences, joined; their numbers."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        new = slice(self.count, self.count + len(sizes))
        self.ids[self.used:self.used + len(ids)] = ids
        self.start[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.count = self.used + len(ids), new.stop
        return range(new.start, new.stop)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of these numbers, joined, and where each ends."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class _Words:
    """Encodes texts. Words are cut, made distinct and put together again as
    whole columns; only distinct ones that the cache lacks reach the tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.kept, self.spaced, self.bare, self.whole, self.bytes = _Ids(), {}, {}, {}, 0
        self.kept.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _keep(self, known: dict[str, int], names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        known.update(zip(names, self.kept.add(ids, sizes), strict=True))
        self.bytes += 4 * len(ids) + sum(map(len, names)) + ENTRY_BYTES * len(names)

    def _learn(self, known: dict[str, int], names: list[str], pieces: list[str]) -> None:
        found = self._encoded(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._keep(known, names, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def _learn_letters(self, names: list[str]) -> None:
        """Words of letters, each behind a space: the tokenizer cuts a row of
        them at the spaces, and says which id belongs to which."""
        for at in range(0, len(names), JOINED):
            row = names[at:at + JOINED]
            e = self.tokenizer.encode("".join([" " + w for w in row]), add_special_tokens=False)
            sizes = np.bincount(np.array(e.word_ids, np.int64))
            if len(sizes) == len(row) and sizes.all():
                self._keep(self.spaced, row, np.array(e.ids, np.uint32), sizes)
            else:  # letters that the tokenizer does not know as such
                self._learn(self.spaced, row, [" " + w for w in row])

    def _known(self, known: dict[str, int], names: list[str], lead: str = "") -> np.ndarray:
        """The numbers of these strings, each once; what is new is encoded behind ``lead``."""
        lacking = [x for x in names if x not in known]
        if lead:
            self._learn_letters([x for x in lacking if x.isalpha()])
            lacking = [x for x in lacking if not x.isalpha()]
        self._learn(known, lacking, [lead + x for x in lacking])
        return np.fromiter(map(known.__getitem__, names), np.int64, len(names))

    def _distinct(self, known: dict[str, int], column: pa.Array, lead: str = "") -> np.ndarray:
        coded = column.dictionary_encode()
        return self._known(known, coded.dictionary.to_pylist(), lead)[coded.indices.to_numpy()]

    def _spaced(self, words: pa.Array) -> np.ndarray:
        """For each word that stands after a space, the numbers of its letters and of the marks behind them."""
        out = np.zeros((len(words), 2), np.int64)  # number 0 is an empty sequence
        lines = pc.match_substring(words, "\n").to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(~lines))
        letters = pc.utf8_rtrim(plain, characters=_MARKS)
        cut = pc.and_(pc.not_equal(letters, plain), pc.utf8_is_alpha(letters))
        body = pc.if_else(cut, letters, plain)
        out[~lines, 0] = self._distinct(self.spaced, body, " ")
        cut = cut.to_numpy(zero_copy_only=False)
        if cut.any():
            ends = [w[n:] for w, n in zip(plain.filter(pa.array(cut)).to_pylist(), pc.utf8_length(letters.filter(pa.array(cut))).to_pylist(), strict=True)]
            out[np.flatnonzero(~lines)[cut], 1] = self._distinct(self.bare, pa.array(ends, pa.large_string()))
        if lines.any():
            out[lines, 0] = self._with_lines(words.filter(pa.array(lines)).to_pylist())
        return out

    def _with_lines(self, words: list[str]) -> np.ndarray:
        new = {w: _pieces(w) for w in words if w not in self.whole}
        pieces = list(chain.from_iterable(new.values()))
        if pieces:
            behind = np.array([x[0] == " " for x in pieces])
            parts = np.zeros(len(pieces), np.int64)
            parts[behind] = self._known(self.spaced, [x[1:] for x in pieces if x[0] == " "], " ") if behind.any() else 0
            parts[~behind] = self._known(self.bare, [x for x in pieces if x[0] != " "]) if not behind.all() else 0
            counts = np.fromiter(map(len, new.values()), np.int64, len(new))
            ids, _ = self.kept.gather(parts)
            self._keep(self.whole, list(new), ids, np.add.reduceat(self.kept.size[parts], np.cumsum(counts) - counts))
        return np.fromiter(map(self.whole.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The whole texts' ids. The tokenizer cuts before each single space
        between two other characters; a text with other spaces, or with one of
        the tokenizer's added tokens, goes to it whole."""
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not any(a in t for a in self.added)]
        if plain:
            if self.bytes > CACHE_BYTES:
                self._clear()
            words = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
            sizes = pc.list_value_length(words).to_numpy()
            coded = words.flatten().dictionary_encode()
            codes = coded.indices.to_numpy()
            begins = np.cumsum(sizes) - sizes
            closed = np.add.reduceat(_opens(coded.dictionary)[codes], begins, dtype=np.int64) == 0
            held, first = np.repeat(closed, sizes), np.zeros(len(codes), bool)
            first[begins] = True
            numbers = np.zeros((len(codes), 2), np.int64)
            for mine, find in ((held & first, lambda w: self._known(self.bare, w.to_pylist())), (held & ~first, self._spaced)):
                some, back = np.unique(codes[mine], return_inverse=True)
                if len(some):
                    found = find(coded.dictionary.take(pa.array(some)))
                    numbers[mine] = (found if found.ndim == 2 else np.stack([found, np.zeros_like(found)], axis=1))[back]
            ids, ends = self.kept.gather(numbers[held].ravel())
            stops = ends[2 * np.cumsum(sizes[closed]) - 1]
            for i, part in zip((i for i, c in zip(plain, closed, strict=True) if c), np.split(ids, stops[:-1]), strict=False):
                out[i] = part
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._encoded([texts[i] for i in rest]), strict=True):
            out[i] = np.array(ids, np.uint32)
        return out


_loaded: dict[str, _Words] = {}


def _words(path: str) -> _Words:
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        _loaded[path] = _Words(Tokenizer.from_file(path))
    return _loaded[path]


# --- minimum bin slack -------------------------------------------------------------

def fullest(counts: list[int], lengths: list[int], room: int) -> dict[int, int]:
    """Of ``counts[length]`` items of each of ``lengths``, the multiset that
    comes closest to ``room`` from below: one bit a reachable sum, and from
    the best sum back through the steps that first reached it."""
    reach, steps, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for length in lengths:
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left:  # counts by powers of two
            take = min(take, left)
            grown = (reach | (reach << (length * take))) & mask
            if grown != reach:
                steps.append((reach, length, take))
                reach = grown
            if reach & full:
                break
            left -= take
            take *= 2
        if reach & full:
            break
    best, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + take
            best -= length * take
    return used


def windows(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start in item, length), for items shorter than ``window``.

    The longest item left opens a window and the fullest multiset of the rest
    joins it; the same pattern is used as often as the counts allow. Where no
    multiset fills a window, the longest item left is cut to fill it, so that
    only the last window stays short."""
    counts, items = [0] * (window + 1), [[] for _ in range(window + 1)]
    for i, n in enumerate(lengths.tolist()):
        if n:
            counts[n] += 1
            items[n].append((i, 0))
    present = sorted((n for n in range(1, window + 1) if counts[n]), reverse=True)
    out = []
    while present:
        longest = present[0]
        counts[longest] -= 1
        used = fullest(counts, present, window - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        for _ in range(min(counts[n] // k for n, k in used.items())):
            taken = [(n, items[n].pop()) for n, k in used.items() for _ in range(k)]
            for n, k in used.items():
                counts[n] -= k
            out.append([(i, at, n) for n, (i, at) in taken])
        gap = window - sum(n * k for n, k in used.items())
        present = [n for n in present if counts[n]]
        if gap and present:  # a pattern with slack is used once at a time
            n = present[0]
            if n > gap:
                i, at = items[n].pop()
                counts[n] -= 1
                out[-1].append((i, at, gap))
                counts[n - gap] += 1
                items[n - gap].append((i, at + gap))
                present = sorted({n - gap, *present} - ({n} if not counts[n] else set()), reverse=True)
    return out


# --- the operator ------------------------------------------------------------------

def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids, binary little-endian, ``with_ids``).

    A document is its text's ids and then id 0. Whole windows of it are
    sequences of their own; the remainders of each ``HELD_DOCUMENTS``
    documents of a task are packed together by minimum bin slack. There is no
    shuffle; a task that runs again makes the same pieces. A sequence's id
    starts with its partition's number, so ids are distinct.

    A null or empty text is id 0 alone. Equal rows are packed each for itself;
    a null doc_id stays null. Other columns are not read. An empty table has
    no pieces.
    """
    names = WITH_IDS if with_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        words, schema = _words(tokenizer), _schema(with_ids)
        held: list[tuple] = []

        def piece(doc, ids, start, total, at, offset):
            row = (doc, start, len(ids) // 4, zlib.crc32(ids), total, at, offset)
            return (*row, ids) if with_ids else row

        def flush():
            nonlocal sequence
            rows = []
            for parts in windows(np.array([len(h[1]) // 4 for h in held], np.int64), window):
                offset = 0
                for i, at, n in parts:
                    doc, ids, start, total = held[i]
                    rows.append(piece(doc, ids[4 * at:4 * (at + n)], start + at, total, sequence, offset))
                    offset += n
                sequence += 1
            held.clear()
            return rows

        for batch, texts in text_chunks(batches, limit=TEXT_BYTES):
            rows = []
            for doc, own in zip(batch.column(0).to_pylist(), words([t.decode() for t in texts]), strict=True):
                ids = own.astype("<u4").tobytes() + b"\0\0\0\0"
                total = len(ids) // 4
                whole = total // window * window
                for start in range(0, whole, window):
                    rows.append(piece(doc, ids[4 * start:4 * (start + window)], start, total, sequence, 0))
                    sequence += 1
                if whole < total:
                    held.append((doc, ids[4 * whole:], whole, total))
                if len(held) >= HELD_DOCUMENTS:
                    rows += flush()
            if rows:
                yield _batch(rows, schema)
        if held:
            yield _batch(flush(), schema)

    return docs.select("doc_id", "text").mapInArrow(run, names)


def _schema(with_ids: bool) -> pa.Schema:
    return pa.schema([(f.name, pa.int64()) for f in PIECES] + ([("ids", pa.binary())] if with_ids else []))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary())
