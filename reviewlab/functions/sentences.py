"""Sentence split, signal test and sentence-aware shortening.

All three are column expressions over arrays: ``split`` with a look-behind,
higher-order ``filter``/``transform`` and an ``aggregate`` whose state is a
``(text, done)`` struct, so a long review is shortened in one narrow stage
without a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.functions.arrays import let
from reviewlab.functions.text import first_letters


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strip(s: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace, not only spaces)."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


# T20 -----------------------------------------------------------------------
def split_sentences(c) -> Column:
    """Only a text's ends can leave blanks at the ends of its parts. Blanks are
    looked for before what stands in front of them, as fewer places have one."""
    c = _c(c)
    blank_ends = F.substring(c, 1, 1).rlike(r"(?U)\s") | F.substring(c, -1, 1).rlike(r"(?U)\s")
    text = F.when(blank_ends, _strip(c)).otherwise(c)
    return F.filter(F.split(text, rf"(?U)\s(?<={K.SENTENCE_END_RE}\s)\s*"), lambda s: s != "")


# T21 -----------------------------------------------------------------------
def _signal_regex() -> str:
    tokens = "|".join(t.replace("[", r"\[").replace("]", r"\]") for t in K.KEY_TOKENS)
    words = "|".join(K.KEY_WORD_PATTERNS)
    # tokens are case-sensitive substrings; key words ignore case
    return f"(?U){first_letters(K.KEY_WORD_PATTERNS, chr(92) + '[')}(?:{tokens}|(?iu:{words}))"


SIGNAL_RE = _signal_regex()


def has_signal(s) -> Column:
    return _c(s).rlike(SIGNAL_RE)


# T22 -----------------------------------------------------------------------
def _fit_prefix(sents: Column, max_len: int, first_n: int = K.MAX_FIRST_SENTENCES) -> Column:
    """The first ``first_n`` sentences, then later signal sentences that are
    not already selected (first occurrence wins), in text order, joined by
    one space while the result stays within ``max_len``; stops at the first
    of them that would overflow. No sentence is searched after that."""
    init = F.struct(F.lit("").alias("acc"), F.lit(False).alias("done"), F.lit(0).alias("i"), F.array().cast("array<string>").alias("taken"))

    def step(st, s):
        acc, i, taken = st["acc"], st["i"], st["taken"]
        passed = st["done"] | ((i >= first_n) & (~has_signal(s) | F.array_contains(taken, s)))
        grown = F.when(acc == "", s).otherwise(F.concat(acc, F.lit(" "), s))
        fits = F.length(grown) <= max_len
        return (F.when(passed, F.struct(acc.alias("acc"), st["done"].alias("done"), (i + 1).alias("i"), taken.alias("taken")))
                .when(fits, F.struct(grown.alias("acc"), F.lit(False).alias("done"), (i + 1).alias("i"), F.concat(taken, F.array(s)).alias("taken")))
                .otherwise(F.struct(acc.alias("acc"), F.lit(True).alias("done"), (i + 1).alias("i"), taken.alias("taken"))))

    return F.aggregate(sents, init, step)["acc"]


def shorten(c, max_len: int = K.MAX_TEXT_LEN_TRAIN,
            first_n: int = K.MAX_FIRST_SENTENCES) -> Column:
    """T22. Texts within ``max_len`` are returned as they are; if no sentence
    fits, the text is cut to ``max_len`` code points."""
    c = _c(c)
    fitted = let(split_sentences(c), lambda sents: _fit_prefix(sents, max_len, first_n))
    cut = let(fitted, lambda f: F.when(f == "", F.substring(c, 1, max_len)).otherwise(f))
    return F.when(F.length(c) <= max_len, c).otherwise(cut)
