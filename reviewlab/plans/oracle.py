"""DuckDB SQL for the correctness oracle.

The driver runs each registered Spark query next to an independent SQL
statement on DuckDB. This module builds those statements. DuckDB uses RE2,
which differs from Java/Python regexes in ways that matter here:

* ``\\b \\w \\d \\s`` are ASCII, so word edges are written with explicit
  Unicode classes and captured neighbours (``(^|NW) ... ($|NW)``) that are
  put back in the replacement; where two matches could share one
  neighbour the replacement is applied twice.
* no back-references, so the letter and punctuation squeezes are generated
  one replacement per character from the character ranges.
* no look-behind, so the sentence split marks split points first.

Only SQL text lives here; nothing in this module runs a query.
"""

from __future__ import annotations

import itertools

from reviewlab import constants as K
from reviewlab.sources.testviews import DECORATIONS

OPEN = "\ue000"
CLOSE = "\ue001"
SPLIT = "\ue002"

# character classes approximating Java's (?U) \w and \s
W = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}]"
NW = r"[^\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}]"
_WS_BODY = r"\x{09}-\x{0D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = "[" + _WS_BODY + "]"
NWS = "[^" + _WS_BODY + "]"
D = r"\p{Nd}"
NONPRINT = r"[\p{C}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"

_ids = itertools.count()


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pattern: str, repl: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, {q(flags)})"


# ---------------------------------------------------------------- test views
def reviews_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN {q(p)}" for i, p in enumerate(DECORATIONS))
    return f"""SELECT d.doc_id AS ID,
  (CASE d.doc_id % 16 {cases} END) || '. ' || d.text AS text,
  CASE WHEN d.doc_id % 29 = 0 THEN NULL WHEN d.doc_id % 31 = 0 THEN '  ' ELSE d.source END AS src,
  CAST(CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 WHEN l.quality = 0 THEN 1 END AS INTEGER) AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def preds_sql() -> str:
    yt = "(CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END)"
    h = "substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 1)"
    return f"""SELECT doc_id AS ID, CAST({yt} AS INTEGER) AS y_true,
  CAST(({yt} + CASE WHEN {h} < '2' THEN 1 WHEN {h} < '4' THEN 2 ELSE 0 END) % 3 AS INTEGER) AS y_pred
FROM labels"""


def scores_sql(mult: int = 37, mod: int = 97) -> str:
    cols = ", ".join(f"CAST(1 + (doc_id * {mult} + {101 * k}) % {mod} AS DOUBLE) AS r{k}"
                     for k in range(3))
    return f"SELECT doc_id AS ID, {cols} FROM labels"


def score_probs_sql(mult: int = 37, mod: int = 97) -> str:
    return (f"SELECT ID, [r0 / (r0 + r1 + r2), r1 / (r0 + r1 + r2), r2 / (r0 + r1 + r2)] AS p "
            f"FROM ({scores_sql(mult, mod)})")


# ---------------------------------------------------------- text, T1 - T18
def strip_nonprintable(x): return rr(x, NONPRINT, "")
def strip_html(x): return rr(x, K.HTML_TAG_RE, " ")
def mask_url(x): return rr(x, f"(https?://{NWS}+|www\\.{NWS}+)", K.URL_TOKEN)


def mask_email(x):
    p = rf"(^|[^\p{{L}}\p{{Nl}}\p{{M}}\p{{Nd}}\p{{Pc}}.-])([.-]*)({W}[\p{{L}}\p{{Nl}}\p{{M}}\p{{Nd}}\p{{Pc}}.-]*@[\p{{L}}\p{{Nl}}\p{{M}}\p{{Nd}}\p{{Pc}}.-]+\.{W}+)"
    once = rr(x, p, r"\1\2" + K.EMAIL_TOKEN)
    return rr(once, p, r"\1\2" + K.EMAIL_TOKEN)


def mask_phone(x):
    body = f"{D}[{D}\\-{_WS_BODY}]{{6,}}{D}"
    plus = rr(x, f"({W})(\\+{body})($|{NW})", r"\1" + K.PHONE_TOKEN + r"\3")
    p = f"(^|{NW})({body})($|{NW})"
    return rr(rr(plus, p, r"\1" + K.PHONE_TOKEN + r"\3"), p, r"\1" + K.PHONE_TOKEN + r"\3")


def mark_emoji(x):
    for pattern, token in K.EMOJI_CLASSES:
        x = rr(x, pattern, token)
    return x


_BANDS = {10: [("0?[0-4]", K.LOW_SCORE), ("0?[56]", K.MID_SCORE), ("0?[7-9]|[1-9][0-9]", K.HIGH_SCORE)],
          5: [("[0-2]", K.LOW_SCORE), ("3", K.MID_SCORE), ("[4-9]", K.HIGH_SCORE)]}
# ratings with explicit word edges: (number, rest), scale
_RATINGS_10 = [(f"({D}{{1,2}})({WS}*из{WS}*10)", 10), (f"({D}{{1,2}})({WS}*/{WS}*10)", 10)]
_RATINGS_5 = [(f"({D})({WS}*из{WS}*5)", 5), (f"({D})({WS}*/{WS}*5)", 5)]


def _rating(x, core, scale):
    x = rr(x, f"(^|{NW}){core}($|{NW})", r"\1" + OPEN + r"\2" + CLOSE + r"\2\3\4")
    for digits, token in _BANDS[scale]:
        x = rr(x, OPEN + "(?:" + digits + ")" + CLOSE, token + " ")
    return rr(x, OPEN + "[^" + CLOSE + "]*" + CLOSE, "")


def mark_rating10(x):
    for core, scale in _RATINGS_10:
        x = _rating(x, core, scale)
    return x


def mark_rating5(x):
    for core, scale in _RATINGS_5:
        x = _rating(x, core, scale)
    return x


def mark_stars(x):
    x = rr(x, K.STARS_RE, OPEN + r"\0" + CLOSE)
    for run, token in (("{2}", K.LOW_SCORE), ("{3}", K.MID_SCORE), ("{4,5}", K.HIGH_SCORE)):
        x = rr(x, OPEN + "([★⭐]" + run + ")" + CLOSE, token + r" \1")
    return x


def mark_exclaim(x): return rr(x, K.STRONG_EXCL_RE, K.STRONG_EXCL_TOKEN)
def mark_question(x): return rr(x, K.STRONG_QUEST_RE, K.STRONG_QUEST_TOKEN)


def squeeze_punct(x):
    for ch, esc in (("!", "!"), ("?", r"\?"), (".", r"\."), (",", ",")):
        x = rr(x, esc + "{3,}", ch * 3)
    return x


def _letters():
    rng = lambda a, b: [chr(i) for i in range(ord(a), ord(b) + 1)]
    return rng("A", "Z") + rng("a", "z") + rng("А", "Я") + rng("а", "я") + ["Ё", "ё"]


def squeeze_letters(x):
    for ch in _letters():
        x = rr(x, ch + "{3,}", ch * 2)
    return x


# slang with explicit word edges: (prefix edge, body, suffix edge)
_SLANG = [
    (f"фуф+ел{W}*", f"($|{NW})"),
    (f"говн{W}*", f"($|{NW})"),
    ("отстой", f"($|{NW})"),
    ("жесть", f"($|{NW})"),
    (r"ах+\*+", f"({W})"),
    ("ёкарныйбабай", f"($|{NW})"),
]


def mark_slang(x):
    for (body, edge), (_, token) in zip(_SLANG, K.SLANG_CLASSES):
        p = f"(^|{NW})({body}){edge}"
        x = rr(rr(x, p, r"\1" + token + r"\3", "gi"), p, r"\1" + token + r"\3", "gi")
    return x


def words(x):
    return f"list_filter(string_split_regex({x}, {q(WS + '+')}), lambda w: w <> '')"


def caps_count(x):
    return (f"len(list_filter({words(x)}, lambda w: length(w) >= {K.CAPS_MIN_WORD_LEN} "
            f"AND upper(w) = w AND lower(w) <> w))")


def mark_caps(x):
    n = caps_count(x)
    return (f"CASE WHEN {n} > 0 AND {n} * {K.CAPS_RATIO_DEN} >= len({words(x)}) * {K.CAPS_RATIO_NUM} "
            f"THEN {q(K.ALL_CAPS_PREFIX)} || {x} ELSE {x} END")


def latin_count(x):
    return f"(length({x}) - length(regexp_replace({x}, '[A-Za-z]', '', 'g')))"


def mark_english(x):
    return f"CASE WHEN {latin_count(x)} >= {K.ENGLISH_MIN_LATIN} THEN {q(K.ENGLISH_PREFIX)} || {x} ELSE {x} END"


def squeeze_space(x):
    return f"trim({rr(x, WS + '+', ' ')})"


def stage_a(x, profile="train"):
    x = f"coalesce(CAST({x} AS VARCHAR), '')"
    for f in (strip_nonprintable, strip_html, mask_url, mask_email, mask_phone, mark_emoji,
              mark_rating10):
        x = f(x)
    if profile == "train":
        x = mark_stars(mark_rating5(x))
    for f in (mark_exclaim, mark_question, squeeze_punct, squeeze_letters, mark_slang):
        x = f(x)
    return x


def clean_text_sql(base_sql: str, col: str = "text", profile: str = "train") -> str:
    """``base_sql`` with ``col`` replaced by its cleaned form."""
    n = next(_ids)
    return f"""(WITH c{n}a AS (SELECT * REPLACE ({stage_a(col, profile)} AS {col}) FROM ({base_sql})),
c{n}b AS (SELECT * REPLACE ({mark_caps(col)} AS {col}) FROM c{n}a),
c{n}c AS (SELECT * REPLACE ({mark_english(col)} AS {col}) FROM c{n}b)
SELECT * REPLACE ({squeeze_space(col)} AS {col}) FROM c{n}c)"""


# ------------------------------------------------------- sentences, T20-T22
def split_sentences(x):
    marked = rr(x, f"([.!?…]){WS}+", r"\1" + SPLIT)
    strip = f"regexp_replace(s, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"
    return (f"list_filter(list_transform(string_split({marked}, {q(SPLIT)}), lambda s: {strip}), "
            f"lambda s: s <> '')")


_SIGNAL_WORDS = [
    f"ужас{W}*($|{NW})", f"отстой{W}*($|{NW})", f"шикарн{W}*($|{NW})", f"прекрасн{W}*($|{NW})",
    f"рекомендую($|{NW})", f"не рекомендую($|{NW})", f"не советую($|{NW})",
    f"фуф+ел{W}*($|{NW})", f"говн{W}*($|{NW})",
]


def has_signal(x):
    toks = " OR ".join(f"contains({x}, {q(t)})" for t in K.KEY_TOKENS)
    words = "|".join(f"(?:{w})" for w in _SIGNAL_WORDS)
    return f"({toks} OR regexp_matches({x}, {q(f'(?i)(^|{NW})(?:{words})')}))"


def select_sentences(s, first_n=K.MAX_FIRST_SENTENCES):
    head = f"list_filter({s}, lambda x, i: i <= {first_n})"
    sig = f"list_filter({s}, lambda x, i: i > {first_n} AND {has_signal('x')})"
    tail = (f"list_filter({sig}, lambda x, i: NOT list_contains({head}, x) "
            f"AND NOT list_contains({sig}[1:i - 1], x))")
    return f"list_concat({head}, {tail})"


def shorten_sql(base_sql: str, col: str = "text", max_len: int = K.MAX_TEXT_LEN_TRAIN,
                first_n: int = K.MAX_FIRST_SENTENCES) -> str:
    n = next(_ids)
    cum = f"list_transform(sel, lambda x, i: list_sum(list_transform(sel[1:i], lambda y: length(y) + 1)) - 1)"
    return f"""(WITH s{n}a AS (SELECT *, CASE WHEN length({col}) > {max_len}
      THEN {select_sentences(split_sentences(col), first_n)} END AS sel FROM ({base_sql})),
s{n}b AS (SELECT *, len(list_filter({cum}, lambda v: v <= {max_len})) AS k FROM s{n}a)
SELECT * EXCLUDE (sel, k) REPLACE (
  CASE WHEN sel IS NULL THEN {col} WHEN k = 0 THEN substring({col}, 1, {max_len})
       ELSE array_to_string(sel[1:k], ' ') END AS {col}) FROM s{n}b)"""
