"""Text rules in fewer passes give the rows of the plain ones."""

import re

import pytest
from pyspark.sql import functions as F

from reviewlab import constants as K
from reviewlab.functions import sentences as S
from reviewlab.functions import text as T
from reviewlab.operators import features as FT

ODD = ["", " ", "ОЧЕНЬ ПЛОХО СЕРВИС ok", "ЁЛКА ель сосна", "1234 5678", "ABC-1 тест", "ĸĸĸĸ мир", "ⅧⅧⅧⅧ", "a  b  c", "x \t y", "  конец.  \n",
       "Да. Нет!\tМожет…\n\nУжас. ужас. Ужас. Прекрасно! [BAD] так", "УЖАС! Один. Два. Три. Четыре. ᲂтстой пять.", "!!! ??? .... ,,,,", "аааа ббб ОТСТОЙ жесть ГОВНО",
       "★⭐ и ★", "⭐⭐⭐⭐⭐⭐", "8 из 10, 3/5", "😊✌️❤ 🤩🥂🍻", "abcdefghij", "abc defghi", "😊ab😂".encode("utf-16", "surrogatepass").decode("utf-16"), "ab"]


def test_expensive_rules_ask_first(spark):
    """What a rule of several passes is asked before must not cost those passes."""
    plan = lambda c: spark.range(1).select(c(F.lit("x").alias("t"))).columns[0]
    assert "split" not in plan(T.mark_caps) and "(?iU)" not in plan(T.mark_slang).split("regexp_replace")[0]
    assert "substring" not in plan(FT.char_ngrams)
    assert "array_except" not in plan(S.shorten)


@pytest.mark.parametrize("n", [2, 3])
def test_char_ngrams_are_all_slices(spark, n):
    rows = spark.createDataFrame([(t,) for t in ODD], "text string").select("text", FT.char_ngrams("text", n, n + 1).alias("g")).collect()
    for r in rows:
        s = re.sub(r"\s\s+", " ", r.text.lower())
        assert r.g == [s[i:i + k] for k in (n, n + 1) for i in range(len(s) - k + 1)], r.text


def test_rules_on_odd_texts(spark):
    cols = {"caps": T.caps_word_count("text"), "english": T.mark_english("text").startswith(K.ENGLISH_PREFIX), "space": T.squeeze_space("text"),
            "slang": T.mark_slang("text"), "stars": T.mark_stars("text"), "emoji": T.mark_emoji("text"), "parts": S.split_sentences("text"), "signal": S.has_signal("text")}
    for r in spark.createDataFrame([(t,) for t in ODD], "text string").select("text", *[c.alias(n) for n, c in cols.items()]).collect():
        t = r.text
        assert r.caps == sum(len(w) >= K.CAPS_MIN_WORD_LEN and w.upper() == w and w.lower() != w for w in t.split()), t
        assert r.english == (len(re.findall(K.LATIN_RE, t)) >= K.ENGLISH_MIN_LATIN), t
        assert r.space == re.sub(r"\s+", " ", t).strip(" "), t
        slang, emoji = t.replace("ᲂ", "о"), t
        for p, token in K.SLANG_CLASSES:
            slang = re.sub(p, token, slang, flags=re.I)
        for p, token in K.EMOJI_CLASSES:
            emoji = re.sub(p, token, emoji)
        assert r.slang.replace("ᲂ", "о") == slang and r.emoji == emoji, t
        assert r.stars.count("SCORE]") == len(re.findall(K.STARS_RE, t)), t
        assert r.parts == [p.strip() for p in re.split(rf"(?<={K.SENTENCE_END_RE})\s+", t) if p.strip()], t
        words = "|".join(K.KEY_WORD_PATTERNS)
        assert r.signal == (any(x in t for x in K.KEY_TOKENS) or bool(re.search(words, t.replace("ᲂ", "о"), re.I))), t


@pytest.mark.parametrize("limit", [10, 25, 40, 60])
def test_shorten_on_odd_texts(spark, limit):
    for r in spark.createDataFrame([(t,) for t in ODD], "text string").select("text", S.shorten("text", limit).alias("out")).collect():
        parts = [p.strip() for p in re.split(rf"(?<={K.SENTENCE_END_RE})\s+", r.text) if p.strip()]
        words = "|".join(K.KEY_WORD_PATTERNS)
        chosen = parts[:3]
        for p in parts[3:]:
            if p not in chosen and (any(x in p for x in K.KEY_TOKENS) or re.search(words, p.replace("ᲂ", "о"), re.I)):
                chosen.append(p)
        out = ""
        for p in chosen:
            grown = f"{out} {p}" if out else p
            if len(grown) > limit:
                break
            out = grown
        assert r.out == (r.text if len(r.text) <= limit else out or r.text[:limit]), r.text


def test_tasks_of_term_counts_follow_the_terms(spark, monkeypatch):
    """A task counts a bounded number of terms, however many there are."""
    monkeypatch.setattr(FT, "TASK_TERMS", 50)
    df = spark.range(64).select(F.col("id").alias("ID"), F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: (i % 50).cast("string")).alias("terms"))
    counts = FT.term_counts(df.unionByName(spark.createDataFrame([(None, ["a", "a"]), (7, None), (8, [])], "ID long, terms array<string>")))
    assert counts.rdd.getNumPartitions() >= 64 * 100 // 50
    assert counts.filter("ID IS NOT NULL").count() == 64 * 50 and counts.filter("tf = 2").count() == 64 * 50 + 1


def test_map_text_passes_bounded_runs(spark, monkeypatch):
    """a batch does not become pandas strings at once."""
    from reviewlab.functions import udf
    monkeypatch.setattr(udf, "CHUNK_BYTES", 100)
    import pyarrow as pa
    texts = pa.array(["x" * 60, None, "y" * 60, "z" * 500, "", "w"])
    assert udf._chunks(texts) == [(0, 2), (2, 1), (3, 1), (4, 2)] and udf._chunks(texts.slice(0, 0)) == [(0, 0)]
    monkeypatch.undo()
    df = spark.createDataFrame([(1, "A  b"), (2, None), (3, "")], "ID long, text string").repartition(5)
    out = udf.map_text(df, lambda s: s.str.lower().str.replace(r"\s+", " ", regex=True)).collect()
    assert {r.ID: r.text for r in out} == {1: "a b", 2: "", 3: ""}
    lens = udf.map_text(spark.range(3000).select(F.repeat(F.lit("ж"), 1500).alias("text")), lambda s: s.map(lambda _: str(len(s))))
    assert lens.agg(F.max(F.col("text").cast("int"))).first()[0] <= udf.CHUNK_BYTES // 3000
