"""Personal data and secrets replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.llm.common import documents, stored, text_chunks

#: Titles before a name, by gender, and what marks a secret.
MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа")
EITHER = ("Dr", "Prof")
MARKERS = r"token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key"
#: Lengths of account numbers by country, as in the IBAN registry.
IBAN_LENGTH = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
#: Syllables of surrogate names, and their ends by gender.
SYLLABLES = {"latin": ("ba", "den", "fo", "gil", "ka", "lor", "mi", "nel", "os", "pra", "ren", "sa", "tul", "ve", "wil", "zan"),
             "cyrillic": ("ба", "ден", "фо", "гил", "ка", "лор", "ми", "нел", "ос", "пра", "рен", "са", "тул", "ве", "вил", "зан")}
ENDS = {"latin": {"m": "on", "f": "ia", "x": "is", "surname": "ley"}, "cyrillic": {"m": "ан", "f": "ия", "x": "ис", "surname": "ко"}}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = "|".join(sorted((*MALE, *FEMALE, *EITHER), key=len, reverse=True))


def _upper() -> str:
    """A regex class of all upper-case and title-case letters."""
    at = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("Lu", "Lt")]
    first = [i for i, before in zip(at, [-2, *at], strict=False) if i != before + 1]
    last = [i for i, after in zip(at, [*at[1:], -1], strict=True) if i + 1 != after]
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(first, last, strict=True)) + "]"


_UPPER = _upper()
_MARK = "\u0300-\u036f"
#: Small words inside a name, which stay as they are.
_PARTICLE = "van|von|vom|zu|zum|zur|der|den|dem|ter|ten|de|del|della|di|da|do|dos|das|du|des|la|las|le|los|y|e|bin|ibn|al|el|af|av|фон|де|ван"
#: A capitalised word, and a name: initials, small words and any number of
#: capitalised words. A single letter without a dot ends no longer name.
_CAPITAL = rf"(?:[dl]['’])?{_UPPER}[\w{_MARK}]*(?:['’-][\w{_MARK}]+)*"
_LEAD = rf"(?:{_UPPER}[{_MARK}]*\.[ -]?|(?:{_PARTICLE}) )"
_WORDS = rf"{_LEAD}*{_CAPITAL}(?: {_LEAD}*(?!{_UPPER}(?![\w'’{_MARK}-])(?! {_UPPER})){_CAPITAL})*"
#: A name's words: initials and capitalised words, without a genitive's end.
_WORD = re.compile(rf"(?<![\w{_MARK}]){_CAPITAL}")
_GENITIVE = re.compile(r"(?<=\w)['’]s$")
CARD = re.compile(r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)")
#: First digits and lengths of card issuers.
ISSUED = re.compile(r"4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|220[0-4]\d{12,15}|3[47]\d{13}"
                    r"|3(?:0[0-59]|[689]\d)\d{11}|35(?:2[89]|[3-8]\d)\d{12,15}|6\d{15,18}|5[06-8]\d{14,17}")
PATTERN = re.compile("|".join([
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9]))",
    rf"(?P<secret>(?i:(?<![A-Za-z])(?:{MARKERS})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?(?P<value>[A-Za-z0-9+/_-]{{16,}})))",
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    rf"(?P<ip>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d))",
    r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    r"(?P<phone>(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+(?!1[ (.-])\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d))",
    rf"(?P<card>{CARD.pattern})",
    rf"(?P<name>(?<!\w)(?P<title>(?:(?:{_TITLE})(?:\. ?| ))*(?:{_TITLE}))(?:\. ?| )(?P<words>{_WORDS}))",
]))
#: Without one of these a text holds none of the above.
_HINT = re.compile(rf"[0-9@]|(?i:{MARKERS})|(?:{_TITLE})[. ]".encode())
FREE_ROUNDS = 20
KINDS = ("email", "secret", "iban", "ip", "ssn", "phone", "card", "name")


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _ends(text: str, start: int, end: int, kind: str) -> list[int]:
    """Where a card or account number that begins at ``start`` may end: at
    borders of groups up to ``end`` where its check digits hold, first those
    with a length that its issuer or country has, then the last."""
    least, usual = (13, ISSUED.fullmatch) if kind == "card" else (12, lambda v: len(v) == IBAN_LENGTH.get(v[:2]))
    values = {e: re.sub(r"[ -]", "", text[start:e]) for e in range(end, start, -1) if e == end or text[e] in " -"}
    held = [e for e, v in values.items() if len(v) >= least and (luhn(v) if kind == "card" else _iban_rest(v) == 1)]
    return sorted(held, key=lambda e: not usual(values[e]))


def _checked(text: str, start: int, end: int, kind: str) -> int | None:
    """The end of the card or account number at ``start``, if there is one. A
    card number of no issuer's kind gives way to one of an issuer's that
    begins inside it."""
    ends = _ends(text, start, end, kind)
    if kind == "card" and ends and not ISSUED.fullmatch(re.sub(r"[ -]", "", text[start:ends[0]])):
        for at in range(start + 1, ends[0]):
            if text[at - 1] in " -" and (m := CARD.match(text, at)):
                inside = _ends(text, at, m.end(), kind)
                if inside and ISSUED.fullmatch(re.sub(r"[ -]", "", text[at:inside[0]])):
                    return None
    return ends[0] if ends else None


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of all entities. Spellings of one
    thing have one value. Card and account numbers count if their check digits
    hold, also beside more groups of digits or capitals. The words of a name
    are entities of their own, so that a surname alone and with a given name
    go together; so are other capitalised mentions of them in the text, as
    what they are first there. An initial is a given name of one letter."""
    out, place, names = [], 0, {}
    while m := PATTERN.search(text, place):
        kind = next(k for k in KINDS if m[k] is not None)
        start, end = m.span("value" if kind == "secret" else kind)
        place = m.end()
        if kind in ("card", "iban"):
            end = _checked(text, start, end, kind)
            place = end or start + 1  # what else begins inside a rejected match
            if end is None:
                continue
        value = text[start:end]
        if kind == "name":
            titles = re.findall(_TITLE, m["title"])
            gender = next((g for g, own in (("m", MALE), ("f", FEMALE)) if any(t in own for t in titles)), "x")
            words = [_bare(text, *w.span()) for w in _WORD.finditer(text, m.start("words"), m.end("words"))]
            for i, (a, b) in enumerate(words):
                out.append((a, b, "surname" if i == len(words) - 1 else f"given_{gender}", _name(text[a:b])))
                if len(out[-1][3]) > 1:
                    names.setdefault(out[-1][3], out[-1][2])
            continue
        if kind == "email":
            value = value.lower()
        elif kind in ("card", "phone", "ssn"):
            value = re.sub(r"\D", "", value)
        elif kind == "iban":
            value = value.replace(" ", "")
        out.append((start, end, kind, value))
    return sorted([*out, *_mentions(text, names, out)]) if names else out


def _bare(text: str, start: int, end: int) -> tuple[int, int]:
    """The place of a name's word without the end of a genitive."""
    m = _GENITIVE.search(text[start:end])
    return start, end - len(m[0]) if m else end


def _name(word: str) -> str:
    return unicodedata.normalize("NFC", word).casefold().replace("’", "'")


def _mentions(text: str, names: dict[str, str], found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Capitalised whole-word mentions of ``names``, alone or in a compound, outside of what is found."""
    out, taken = [], iter([*found, (len(text) + 1, len(text) + 1, "", "")])
    after = next(taken)
    for m in _WORD.finditer(text):
        parts = [(p.start() + m.start(), p.end() + m.start()) for p in re.finditer(rf"[\w{_MARK}]+", m[0])]
        i = 0
        while i < len(parts):
            start = m.start() if i == 0 else parts[i][0]
            ends = [e for _, e in parts[i:][::-1]]
            end = next((e for e in ends if _name(text[start:e]) in names), None)
            i += 1
            if end is None or text[start:end].islower():
                continue
            while after[1] <= start:
                after = next(taken)
            if after[0] >= end:
                value = _name(text[start:end])
                out.append((start, end, names[value], value))
            while i < len(parts) and parts[i][0] < end:
                i += 1
    return out


class _Stream:
    """Numbers that a key, a kind, a value and an attempt fix."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.state = hashlib.blake2b(f"{kind}\0{value}\0{attempt}".encode(), key=key, digest_size=64).digest()
        self.number = int.from_bytes(self.state)

    def below(self, n: int) -> int:
        if self.number < 1 << 64:
            self.state = hashlib.blake2b(self.state).digest()
            self.number = int.from_bytes(self.state)
        self.number, out = divmod(self.number, n)
        return out

    def like(self, text: str, hexadecimal: bool = False) -> str:
        """Each digit by a digit and each letter by one of its case."""
        out = []
        for c in text:
            if hexadecimal and c in "0123456789abcdefABCDEF":
                x = "0123456789abcdef"[self.below(16)]
                out.append(x.upper() if text.isupper() else x)
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                x = chr(97 + self.below(26))
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


#: Letters that an initial is replaced within.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω",
             "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿāăąćčďđēęěğīįķłļńņňőœŕřśşšţťūůűųźżž")


@lru_cache(maxsize=64)
def initials(key: bytes, kind: str) -> dict[str, str]:
    """Another letter of its alphabet for each letter, no two the same: each
    letter's follower on a ring whose order the key fixes."""
    out = {}
    for letters in ALPHABETS:
        ring = sorted(letters, key=lambda c: hashlib.blake2b(f"{kind}\0{c}".encode(), key=key).digest())
        out |= dict(zip(ring, [*ring[1:], ring[0]], strict=True))
    return out


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value, never the value itself."""
    if (kind == "surname" or kind.startswith("given_")) and value in (ring := initials(key, kind)):
        return ring[value]
    while True:
        s = _Stream(key, kind, value, attempt)
        if kind == "email":
            local, _, domain = value.partition("@")
            d = _Stream(key, "domain", domain, 0)
            out = f"{s.like(local)}{s.below(10) if len(local) < 4 else ''}@{d.like('aaaaaa')}.example.{'com' if d.below(2) else 'org'}"
        elif kind == "ip":
            out = ".".join(str(1 + s.below(254)) for _ in range(4))
        elif kind == "card":
            body = value[0] + s.like(value[1:-1])
            out = next(body + c for c in "0123456789" if luhn(body + c))
        elif kind == "iban":
            body = value[:2] + "00" + s.like(value[4:])
            out = f"{value[:2]}{98 - _iban_rest(body):02d}{body[4:]}"
        elif kind == "phone":
            lead = 1 if value[0] == "1" and len(value) == 11 else 2 if len(value) > 10 else 0
            out = value[:lead] + s.like(value[lead:])
        elif kind == "ssn":
            out = s.like(value)
        elif kind == "secret":
            out = s.like(value, hexadecimal=bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)))
        else:
            script = "cyrillic" if re.search("[а-яё]", value) else "latin"
            parts = SYLLABLES[script]
            out = "".join(parts[s.below(len(parts))] for _ in range(4 + attempt // 4)) + ENDS[script]["surname" if kind == "surname" else kind[-1]]
        if out != value and not (len(value) == 1 and out[0] == value):  # an initial shows the first letter
            return out
        attempt += 1


def rendered(shown: str, kind: str, out: str) -> str:
    """A canonical surrogate in the format of the entity as it stands."""
    if kind in ("card", "phone", "ssn", "iban"):
        letters = iter(out)
        return "".join(c if not c.isalnum() else next(letters) for c in shown)
    if kind == "email":
        return out.upper() if shown.isupper() else out
    if kind == "surname" or kind.startswith("given_"):
        if kind != "surname" and len(_name(shown)) == 1:
            return out[0].upper()
        return out.upper() if shown.isupper() and len(shown) > 1 else out.capitalize()
    return out


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, dict[str, int]]:
    """The text with surrogates, and how many entities of each kind."""
    out, at, counts = [], 0, {}
    for start, end, kind, value in entities(text):
        out += [text[at:start], rendered(text[start:end], kind, surrogate(key, kind, value, attempts.get((kind, value), 0)))]
        at = end
        counts[kind.split("_")[0]] = counts.get(kind.split("_")[0], 0) + 1
    return "".join([*out, text[at:]]) if out else text, counts


# --- the operator ------------------------------------------------------------------

def settled(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, surrogate) of distinct (kind, value), such that no
    two values of a kind share a surrogate and none is another's value. Of
    those that clash the smallest value keeps its surrogate; the others, and
    those equal to a value, try again until no clash is left. Where a kind's
    values fill most of their range, being another's value is let pass after
    ``FREE_ROUNDS``; surrogates stay distinct."""
    fields = "kind string, value string, attempt int, surrogate string"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pydict()
            out = [surrogate(key, k, v, a) for k, v, a in zip(rows["kind"], rows["value"], rows["attempt"], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], ["kind", "value", "attempt", "surrogate"])

    table = stored(found.withColumn("attempt", F.lit(0)).mapInArrow(made, fields), "pii-surrogates")
    values = table.select("kind", F.col("value").alias("surrogate"))
    for turn in count():
        first = table.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"), F.count("*").alias("n"))
        whole = first.filter("length(surrogate) > 1")  # letters change places among themselves
        clash = first.filter("n > 1").select("kind", "surrogate", "owner").unionByName(
            whole.filter(F.lit(turn < FREE_ROUNDS)).join(values, ["kind", "surrogate"], "left_semi").select("kind", "surrogate", F.lit(None).cast("string").alias("owner")))
        clash = stored(clash.groupBy("kind", "surrogate").agg(F.when(F.count("owner") == F.count("*"), F.min("owner")).alias("owner")), "pii-clash")
        if clash.isEmpty():
            return table
        marked = table.join(clash.withColumn("hit", F.lit(True)), ["kind", "surrogate"], "left")
        lost = F.coalesce(F.col("hit"), F.lit(False)) & ~F.col("value").eqNullSafe(F.col("owner"))
        again = marked.select("kind", "value", (F.col("attempt") + F.when(lost, 1).otherwise(0)).cast("int").alias("attempt"))
        table = stored(again.mapInArrow(made, fields), "pii-surrogates")


#: For the registered query and the example pipeline only, whose reruns must agree. Who knows a key can find what it replaced.
EXAMPLE_KEY = b"example key"


def replace(docs: DataFrame, key: bytes, counts: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text`` (and a map of counts by kind in column ``counts``).

    Emails, secrets after a marker, IBANs, IPv4 addresses, social security,
    phone and card numbers, and names after a title with their other mentions
    in the same text. A surrogate hangs on the
    key, kind and value alone, so mentions of one thing agree in all
    documents; ``settled`` keeps different things apart. Only values that had
    to try again are joined to their documents, by doc_id; the rest is one
    pass.

    A null text stays null, an empty or clean one is unchanged. Rows with one
    doc_id share what is joined, which holds for each of them; a null doc_id
    is an id like others. Other columns stay. An empty table stays empty.
    """
    def detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            rows = {(d, k, v) for d, t in zip(batch.column(0).to_pylist(), texts, strict=True) if _HINT.search(t)
                    for _, _, k, v in entities(t.decode())}
            ids, kinds, values = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())],
                                             ["doc_id", "kind", "value"])

    found = stored(docs.select("doc_id", "text").mapInArrow(detected, "doc_id long, kind string, value string"), "pii-found")
    table = settled(found.select("kind", "value").distinct(), key)
    again = table.filter("attempt > 0").select("kind", "value", "attempt")
    many = not again.isEmpty()
    if many:
        per_document = (found.join(again, ["kind", "value"]).groupBy(F.col("doc_id").alias("_doc"))
                        .agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("_again")))
        source = docs.join(per_document, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select(*docs.columns, "_again")
    else:
        source = docs
    fields = [*docs.schema.fields] + ([T.StructField(counts, T.MapType(T.StringType(), T.LongType()))] if counts else [])
    position, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            column, kinds = batch.column(position), []
            attempts = [{(x["kind"], x["value"]): x["attempt"] for x in r or ()} for r in batch.column(batch.num_columns - 1).to_pylist()] if many else [{}] * len(texts)
            hit = [bool(_HINT.search(t)) for t in texts]
            if any(hit):
                shown, new = column.to_pylist(), []
                for old, text, h, a in zip(shown, texts, hit, attempts, strict=True):
                    out, n = replaced(text.decode(), key, a) if h else (old, {})
                    new.append(None if old is None else out)
                    kinds.append(list(n.items()))
                column = pa.array(new, column.type)
            columns = [column if i == position else c for i, c in enumerate(batch.columns[:width])]
            if counts:
                columns.append(pa.array(kinds or [[]] * len(texts), pa.map_(pa.string(), pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    out = replace(documents(spark, sf_dir).select("doc_id", "text"), EXAMPLE_KEY, counts="found")
    kinds = [F.coalesce(F.element_at("found", k), F.lit(0)).cast("long").alias(f"n_{k}")
             for k in ("email", "secret", "iban", "ip", "ssn", "phone", "card", "given", "surname")]
    return out.select("doc_id", "text", *kinds)
