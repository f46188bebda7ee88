"""Text normalisation as Spark column expressions.

Every function takes and returns a ``Column`` and is built only from
built-in functions (``regexp_replace``, ``split``, higher-order ``filter``),
with no Python worker. Rules of several passes ask first, in one pass or by a
search for a plain string, whether a text has anything for them.

Regex dialect: Java's ``\\b \\w \\d \\s`` are ASCII unless ``(?U)`` is set,
while the original rules ran on Python ``str`` patterns, which are Unicode.
Every pattern that uses them is therefore prefixed with ``(?U)``, and the
case-insensitive ones with ``(?iU)``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.functions.arrays import let

# Private-use sentinels around a rating number. ``strip_nonprintable`` deletes
# private-use characters first, so they never collide with input text.
OPEN = "\ue000"
CLOSE = "\ue001"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _where(c: Column, found: Column, then: Callable[[Column], Column]) -> Column:
    return F.when(found, then(c)).otherwise(c)


def _contains_any(c: Column, *parts: str) -> Column:
    return reduce(or_, [F.contains(c, F.lit(p)) for p in parts])


# T1 ------------------------------------------------------------------------
def strip_nonprintable(c) -> Column:
    """Delete characters Python's ``str.isprintable`` rejects: categories
    C* and Z* except the ASCII space. Newlines vanish without a space. Emoji
    that a JVM's older tables do not know yet are kept."""
    return F.regexp_replace(_c(c), rf"[\p{{C}}\p{{Z}}&&[^ {K.NEW_EMOJI}]]", "")


# T2 ------------------------------------------------------------------------
def strip_html(c) -> Column:
    c = _c(c)
    return _where(c, F.contains(c, F.lit("<")), lambda x: F.regexp_replace(x, K.HTML_TAG_RE, " "))


# T3-T5 ---------------------------------------------------------------------
def mask_url(c) -> Column:
    c = _c(c)
    return _where(c, F.contains(c, F.lit("http")) | F.contains(c, F.lit("www.")), lambda x: F.regexp_replace(x, "(?U)" + K.URL_RE, K.URL_TOKEN))


def mask_email(c) -> Column:
    c = _c(c)
    return _where(c, F.contains(c, F.lit("@")), lambda x: F.regexp_replace(x, "(?U)" + K.EMAIL_RE, K.EMAIL_TOKEN))


def mask_phone(c) -> Column:
    return F.regexp_replace(_c(c), "(?U)" + K.PHONE_RE, K.PHONE_TOKEN)


# T6 ------------------------------------------------------------------------
def mark_emoji(c) -> Column:
    def marked(out: Column) -> Column:
        for pattern, token in K.EMOJI_CLASSES:
            out = F.regexp_replace(out, pattern, token)
        return out
    c = _c(c)
    return _where(c, c.rlike(_ranges("".join(p[1:-1] for p, _ in K.EMOJI_CLASSES))), marked)


def _ranges(members: str, gap: int = 0x400) -> str:
    """A class of few ranges that holds all members, and others between them:
    a search for it asks little of each character."""
    points = sorted({ord(m) for m in members})
    edges = [i for i in range(1, len(points)) if points[i] - points[i - 1] > gap]
    return "[" + "".join(f"\\x{{{points[a]:X}}}-\\x{{{points[b - 1]:X}}}" for a, b in zip([0, *edges], [*edges, len(points)], strict=True)) + "]"


# T7-T10 --------------------------------------------------------------------
@lru_cache(maxsize=1)
def _zeros() -> list[int]:
    """The digit 0 of every script; 1 to 9 follow it."""
    return [p for p in range(sys.maxunicode + 1) if unicodedata.decimal(chr(p), -1) == 0 and unicodedata.decimal(chr(p + 9), -1) == 9]


def _digits(low: int, high: int) -> str:
    """A class of the digits from ``low`` to ``high`` in all scripts."""
    return "[" + "".join(f"\\x{{{z + low:X}}}-\\x{{{z + high:X}}}" for z in _zeros()) + "]"


def _band_patterns(scale: int):
    """Digit patterns for each band of a rating on ``scale``. Five-point
    values are doubled before banding, so 0-2 is low, 3 mid, 4-9 high."""
    if scale == 10:
        zero = _digits(0, 0) + "?"
        return [(zero + _digits(0, K.RATING_LOW_MAX), K.LOW_SCORE), (zero + _digits(K.RATING_LOW_MAX + 1, K.RATING_HIGH_MIN - 1), K.MID_SCORE),
                (zero + _digits(K.RATING_HIGH_MIN, 9) + "|" + _digits(1, 9) + _digits(0, 9), K.HIGH_SCORE)]
    return [(_digits(0, 2), K.LOW_SCORE), (_digits(3, 3), K.MID_SCORE), (_digits(4, 9), K.HIGH_SCORE)]


def _mark_rating(c: Column, pattern: str, scale: int) -> Column:
    # one pass wraps every match as OPEN n CLOSE match, then each band
    # rewrites its own sentinels to "TOKEN "; this keeps single-pass semantics
    out = F.regexp_replace(c, "(?U)" + pattern, OPEN + "$1" + CLOSE + "$0")
    for digits, token in _band_patterns(scale):
        out = F.regexp_replace(out, OPEN + "(?:" + digits + ")" + CLOSE, token + " ")
    # a digit that only the JVM knows has no band: drop its sentinels, keep the text
    return F.regexp_replace(out, OPEN + "[^" + CLOSE + "]*" + CLOSE, "")


def _mark_ratings(c: Column, patterns: list[tuple[str, int]], scale: int) -> Column:
    def marked(out: Column) -> Column:
        for pattern, by in patterns:
            out = _mark_rating(out, pattern, by)
        return out
    some = F.contains(c, F.lit("/")) | F.contains(c, F.lit("из"))
    return _where(c, some & c.rlike(rf"(?U)\d\s*(?:из|/)\s*{scale}"), marked)


def mark_rating10(c) -> Column:
    return _mark_ratings(_c(c), K.RATING_10_RES, 10)


def mark_rating5(c) -> Column:
    return _mark_ratings(_c(c), K.RATING_5_RES, 5)


def mark_stars(c) -> Column:
    """Runs of 2-5 stars; value = 2 x run length (2 low, 3 mid, 4-5 high)."""
    def marked(out: Column) -> Column:
        out = F.regexp_replace(out, K.STARS_RE, OPEN + "$0" + CLOSE)
        for run, token in (("{2}", K.LOW_SCORE), ("{3}", K.MID_SCORE), ("{4,5}", K.HIGH_SCORE)):
            out = F.regexp_replace(out, OPEN + "([★⭐]" + run + ")" + CLOSE, token + " $1")
        return out
    c = _c(c)
    return _where(c, _contains_any(c, "★★", "⭐⭐", "★⭐", "⭐★"), marked)


def rating_band(v) -> Column:
    v = _c(v)
    return (F.when(v <= K.RATING_LOW_MAX, F.lit(K.LOW_SCORE))
            .when(v >= K.RATING_HIGH_MIN, F.lit(K.HIGH_SCORE))
            .when(v.isNotNull(), F.lit(K.MID_SCORE)))


# T11-T14 -------------------------------------------------------------------
def mark_exclaim(c) -> Column:
    c = _c(c)
    return _where(c, F.contains(c, F.lit("!!!")), lambda x: F.regexp_replace(x, K.STRONG_EXCL_RE, K.STRONG_EXCL_TOKEN))


def mark_question(c) -> Column:
    c = _c(c)
    return _where(c, F.contains(c, F.lit("???")), lambda x: F.regexp_replace(x, K.STRONG_QUEST_RE, K.STRONG_QUEST_TOKEN))


def squeeze_punct(c) -> Column:
    c = _c(c)
    return _where(c, _contains_any(c, "!!!", "???", "...", ",,,"), lambda x: F.regexp_replace(x, K.MULTI_PUNCT_RE, "$1$1$1"))


def squeeze_letters(c) -> Column:
    return F.regexp_replace(_c(c), K.STRETCH_RE, "$1$1")


# T15 -----------------------------------------------------------------------
def mark_slang(c) -> Column:
    def marked(out: Column) -> Column:
        for pattern, token in K.SLANG_CLASSES:
            out = F.regexp_replace(out, "(?iU)" + pattern, token)
        return out
    c = _c(c)
    return _where(c, c.rlike(f"(?U){first_letters(p for p, _ in K.SLANG_CLASSES)}(?i:" + "|".join(p for p, _ in K.SLANG_CLASSES) + ")"), marked)


def first_letters(patterns: Iterable[str], other: str = "") -> str:
    """Looks ahead for what a match of the patterns, each ``\\b`` and a Cyrillic
    letter in any case, or of ``other`` can begin with: first by ranges, so that
    most characters are passed by quickly. Java folds U+1C80 to U+1C88 to Cyrillic letters."""
    letters = {p.removeprefix(r"\b")[0] for p in patterns}
    folded = other + r"\x{1C80}-\x{1C88}"
    return f"(?=[\u0400-\u04ff{folded}])(?=[{''.join(sorted(x.lower() + x.upper() for x in letters))}{folded}])"


# T16 / T17 -----------------------------------------------------------------
def words(c) -> Column:
    """Python ``str.split()``: whitespace runs, no empty items."""
    return F.filter(F.split(_c(c), r"(?U)\s+"), lambda w: w != "")


#: Words that may be in capitals: no letter that an upper case would change for sure.
_MAYBE_CAPS = rf"(?U)(?=[^a-zа-яё\s])(?<!\S)[^a-zа-яё\s]{{{K.CAPS_MIN_WORD_LEN},}}+(?!\S)"


def caps_word_count(c) -> Column:
    """Only words without common small letters are taken out and compared."""
    return F.size(F.filter(F.regexp_extract_all(_c(c), F.lit(_MAYBE_CAPS), 0), lambda w: (F.upper(w) == w) & (F.lower(w) != w)))


def is_mostly_caps(c) -> Column:
    c = _c(c)
    return let(caps_word_count(c), lambda n: (n > 0) & (n * K.CAPS_RATIO_DEN >= F.regexp_count(c, F.lit(r"(?U)\S+")) * K.CAPS_RATIO_NUM))


def mark_caps(c) -> Column:
    c = _c(c)
    return F.when(is_mostly_caps(c), F.concat(F.lit(K.ALL_CAPS_PREFIX), c)).otherwise(c)


def latin_count(c) -> Column:
    c = _c(c)
    return F.length(c) - F.length(F.regexp_replace(c, K.LATIN_RE, ""))


def mark_english(c) -> Column:
    c = _c(c)
    enough = c.rlike(f"^(?:[^A-Za-z]*+{K.LATIN_RE}){{{K.ENGLISH_MIN_LATIN}}}")
    return F.when(enough, F.concat(F.lit(K.ENGLISH_PREFIX), c)).otherwise(c)


# T18 / T23 -----------------------------------------------------------------
def squeeze_space(c) -> Column:
    # a run that is one space stays as it is
    return F.trim(F.regexp_replace(_c(c), r"(?U) \s+|[^\S ]\s*", " "))


def char_len(c) -> Column:
    """Length in code points (Python ``len``)."""
    return F.length(_c(c))


# T19 -----------------------------------------------------------------------
PROFILES = ("train", "serve")


def _steps(profile: str) -> list[Callable[[Column], Column]]:
    """T1-T17 as steps; each is a projection of its own, as most read their input more than once."""
    ratings = [mark_rating10, mark_rating5, mark_stars] if profile == "train" else [mark_rating10]
    return [strip_html, mask_url, mask_email, mask_phone, mark_emoji, *ratings,
            mark_exclaim, mark_question, squeeze_punct, squeeze_letters, mark_slang, mark_caps, mark_english]


def clean_text(df: DataFrame, col: str = "text", out: str | None = None,
               profile: str = "train") -> DataFrame:
    """The full cleaning chain in the original order.

    ``train`` applies T1-T18; ``serve`` leaves out the five-point ratings and
    stars (T8, T9). Each step is a projection: Catalyst's CollapseProject
    will not inline a non-trivial expression that is referenced more than
    once, so that every step is evaluated once per row. The one-row ``explode`` at
    the end keeps later filters on the cleaned text from being pushed below
    the chain, which would repeat it in the filter.
    """
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    out = out or col
    tmp = "__clean_tmp"
    df = df.withColumn(tmp, strip_nonprintable(F.coalesce(F.col(col).cast("string"), F.lit(""))))
    for step in _steps(profile):
        df = df.withColumn(tmp, step(F.col(tmp)))
    df = df.withColumn(out, F.explode(F.array(squeeze_space(tmp))))
    return df.drop(tmp) if out != tmp else df
