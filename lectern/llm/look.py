"""Problem 1: one consistent form for text that looks the same.

For each token the script sets of its letters are intersected (Script and
Script_Extensions, Japanese, Korean and Chinese joined as UTS 39 does).  An
empty intersection marks a mixed-script token; a token whose every letter has a
look-alike in another script is a whole-script confusable.  Both are respelled
in one script: the script of the token's letters that have no look-alike, else
the script that prevails among such letters of the whole text if it can spell
the token, else Latin.  As letters that have look-alikes never vote, two texts
that look the same get the same spelling.
Which letters look alike is read from Unicode's confusables data, which ICU, part of
Spark, holds as skeletons (``looks_of``): of the scripts below, the letters whose
skeleton is one ASCII letter of the same case.  Letters of the token's own script
stay, but for phonetic ones (IPA).  A session that can't reach that data is an
error, never a smaller table; a fixed table of the commonest letters serves only
calls of ``consistent_form`` that name no ``looks``.
Accents are taken off for that (NFD) and put on again (NFC), so a letter with
accents is judged by its base letter.
All other forms (width, composition, ligatures, invisible characters, kinds of
blanks, kinds of line ends) are brought together by NFKC and two classes.

Defined results: NULL stays NULL; an empty text stays empty; a text of only
invisible characters becomes empty; letters case, figures, accents, punctuation,
the number of blanks and the number of line breaks are kept.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.arrowio import cut, map_texts, str_col

#: The commonest letters of other scripts by the Latin letter they
#: look like.
LATIN_LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ",
    "I": "ІΙӀ", "J": "ЈͿᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ",
    "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ",
    "Y": "УҮΥ", "Z": "ΖᏃ", "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "іι",
    "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "ѵν",
    "w": "ԝ", "x": "хχ", "y": "уγ",
}

INVISIBLE = re.compile(
    r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f"
    r"\u3164\ufe00-\ufe0f\ufeff\uffa0\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]+"
)
BLANK = re.compile(r"[\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
BREAK = re.compile(r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
#: A letter of the other scripts (with accents as well) or of IPA: without one, no
#: token can be mixed or be spelled in another script.
FOREIGN = re.compile("[\u0250-\u02af\u0370-\u058f\u13a0-\u13ff\u1c80-\u1c8f\u1d00-\u1dbf\u1f00-\u1fff\u2c80-\u2cff\u2de0-\u2dff\ua4d0-\ua4ff\ua640-\ua69f\ua720-\ua7ff\uab30-\uabbf]")
TOKEN = regex.compile(r"[\p{L}\p{M}]+")

_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu")
#: Scripts written together count as one (UTS 39, augmented script sets).
_AUGMENTED = {
    "Jpan": ("Han", "Hiragana", "Katakana"),
    "Kore": ("Han", "Hangul"),
    "Hanb": ("Han", "Bopomofo"),
}
_ALL = frozenset({"*"})


_SCX = [
    (s, regex.compile(rf"\p{{Script_Extensions={s}}}"))
    for s in (*_SCRIPTS, "Han", "Hiragana", "Katakana", "Hangul", "Bopomofo", "Devanagari", "Arabic", "Hebrew", "Thai", "Bengali", "Tamil", "Telugu", "Georgian")
]
_COMMON = regex.compile(r"[\p{Script=Common}\p{Script=Inherited}]")


@lru_cache(maxsize=1 << 16)
def script_set(ch: str) -> frozenset[str]:
    """Augmented script set of a character; ``*`` is every script."""
    own = {s for s, rx in _SCX if rx.match(ch)}
    if not own:
        return _ALL
    if _COMMON.match(ch) and len(own) > 4:
        return _ALL
    return frozenset(own | {a for a, parts in _AUGMENTED.items() if own & set(parts)})


def resolved_set(token: str) -> frozenset[str]:
    """Intersection of the script sets of a token (``*`` if it has none)."""
    got = _ALL
    for ch in set(token):
        s = script_set(ch)
        if s is not _ALL:
            got = s if got is _ALL else got & s
    return got


def _phonetic(ch: str) -> bool:
    return "\u0250" <= ch <= "\u02af" or "\u1d00" <= ch <= "\u1dbf"


class Looks:
    """Letters that look alike: ``class_of`` gives a letter's Latin counterpart
    (and that itself), ``spell`` a class's letter in each script."""

    def __init__(self, alike: dict[str, str]) -> None:
        """``alike``: letter -> ASCII letter that it looks like."""
        self.alike = alike
        self.class_of = alike | {v: v for v in alike.values()}
        self.spell: dict[str, dict[str, str]] = {s: {} for s in _SCRIPTS}
        # The letters of the fixed table come first.
        for ch, latin in sorted(self.class_of.items(), key=lambda kv: (kv[0] not in _COMMONEST and kv[0] != kv[1], kv[0])):
            for s, rx in _SCX[: len(_SCRIPTS)]:
                if rx.match(ch):
                    self.spell[s].setdefault(latin, ch)
        self._votes = lru_cache(maxsize=1 << 16)(self._vote)
        self._spelled = lru_cache(maxsize=1 << 16)(self._respelled)

    def __reduce__(self):  # noqa: ANN204 - tasks make their own caches
        return Looks, (self.alike,)

    def _vote(self, token: str) -> tuple[str, ...]:
        """Scripts of the token's letters that have no look-alike, most first."""
        n: dict[str, int] = {}
        for ch in token:
            if ch not in self.class_of and not unicodedata.combining(ch):
                for s in script_set(ch) & frozenset(_SCRIPTS):
                    n[s] = n.get(s, 0) + 1
        return tuple(sorted(n, key=lambda s: (-n[s], _SCRIPTS.index(s))))

    def _respelled(self, token: str, prevailing: str) -> str:
        votes = self._votes(token)
        target = votes[0] if votes else prevailing
        if not votes and not all(k in self.spell[target] for c in token if (k := self.class_of.get(c))):
            target = "Latin"  # the prevailing script cannot spell the whole token
        spell = self.spell[target]
        # A letter of the script itself stays; one that the script cannot spell goes
        # to its Latin counterpart, whichever look-alike stood there.
        own = lambda ch: target in script_set(ch) and not _phonetic(ch)
        return "".join(spell.get(k, k) if (k := self.class_of.get(ch)) and not own(ch) else ch for ch in token)

    def consistent(self, text: str) -> str:
        """A decomposed text with each token spelled in one script."""
        found = TOKEN.findall(text)
        n = dict.fromkeys(_SCRIPTS, 0)
        for tok in found:
            for s in self._votes(tok)[:1]:
                n[s] += 1
        prevailing = max(_SCRIPTS, key=lambda s: (n[s], -_SCRIPTS.index(s)))
        change = {k: v for k in set(found) if (v := self._spelled(k, prevailing)) != k}
        return TOKEN.sub(lambda m: change.get(m[0], m[0]), text) if change else text


_COMMONEST = {ch: latin for latin, others in LATIN_LOOKALIKES.items() for ch in others}
COMMON = Looks(_COMMONEST)
CLASS_OF = COMMON.class_of


@lru_cache(maxsize=1)
def _of_icu(spark: SparkSession) -> Looks:
    try:
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    except (AttributeError, TypeError, Py4JError) as e:
        raise RuntimeError("Unicode's confusables data can't be read: this session doesn't reach ICU (com.ibm.icu.text.SpoofChecker)") from e
    plain = lambda ch: unicodedata.normalize("NFKC", ch) == ch == unicodedata.normalize("NFD", ch)
    every = (chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x20000)))
    letters = [ch for ch in every if unicodedata.category(ch)[0] == "L" and plain(ch) and any(rx.match(ch) for _, rx in _SCX[: len(_SCRIPTS)])]
    alike = dict(_COMMONEST)
    for ch, skeleton in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True):
        latin = "I" if skeleton == "l" and not ch.islower() else skeleton  # one skeleton for both
        if len(latin) == 1 and latin.isascii() and latin.isalpha() and (ch.isupper() == latin.isupper() or not (ch.isupper() or ch.islower())):
            if "Latin" not in script_set(ch) or _phonetic(ch):
                alike.setdefault(ch, latin)
    return Looks(alike)


def looks_of(spark: SparkSession) -> Looks:
    """The letters that look alike by the session's ICU data; an error without it."""
    return _of_icu(spark)


def consistent_form(text: str | None, looks: Looks = COMMON) -> str | None:
    """The consistent form of one text; equal for texts that look the same."""
    if text is None:
        return None
    if text.isascii():
        return BREAK.sub("\n", text).replace("\t", " ")
    t = INVISIBLE.sub("", text)
    if not unicodedata.is_normalized("NFKC", t):
        # NFKC may bring forth invisible characters, blanks and uncomposed
        # sequences across removed ones, hence the second pass.
        t = unicodedata.normalize("NFKC", t)
        t = INVISIBLE.sub("", t)
    t = BLANK.sub(" ", BREAK.sub("\n", t))
    if FOREIGN.search(t):
        t = unicodedata.normalize("NFC", looks.consistent(unicodedata.normalize("NFD", t)))
    return t


def consistent_texts(df: DataFrame, text: str, out: str = "consistent_text") -> DataFrame:
    """``df`` with the consistent form of column ``text`` in column ``out``
    (an existing column of that name is replaced)."""
    from pyspark.sql.functions import pandas_udf

    looks = looks_of(df.sparkSession)

    @pandas_udf("string")
    def form(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: consistent_form(t, looks), na_action="ignore")

    return df.withColumn(out, form(F.col(text)))


def look_prints(df: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, look, raw): 128-bit prints of the consistent form and of the
    text as stored.  Rows without id or text give none."""
    looks = looks_of(df.sparkSession)

    def prints(b: pa.RecordBatch) -> dict[str, list]:
        ids, look, raw = [], [], []
        for i, t in zip(str_col(b, "item_id"), str_col(b, "text")):
            if i is None or t is None:
                continue
            ids.append(i)
            look.append(xxhash.xxh3_128_digest(consistent_form(t, looks).encode("utf-8", "surrogatepass")))
            raw.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
        return {"item_id": ids, "look": look, "raw": raw}

    rows = df.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))
    return map_texts(rows, prints, "item_id bigint, look binary, raw binary", ["text"])


#: Items of one look whose pairs are listed by one task.
SPLIT = 2000


def _varied(prints: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Slim rows, cut from lineage so that texts are read and folded once, and the
    looks that stand for more than one stored text, with their size and first item."""
    rows = cut(prints.select(kind, "item_id", "look", "raw")).distinct()
    groups = rows.groupBy(kind, "look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count("*").alias("members"), F.min("item_id").alias("class_id"))
    return rows, groups.where("lo <> hi").drop("lo", "hi")


def look_classes(prints: DataFrame, kind: str = "item_kind") -> DataFrame:
    """(kind, item_id, class_id, members): the items that look the same as another
    stored differently, each with the first item of its class.  Linear in the rows."""
    rows, groups = _varied(prints, kind)
    return rows.join(groups, [kind, "look"]).select(kind, "item_id", "class_id", "members").distinct()


def same_looking_pairs(prints: DataFrame, kind: str = "item_kind", split: int = SPLIT) -> DataFrame:
    """(kind, left_id, right_id) of items of equal ``look`` and unequal ``raw``.

    Groups of exact copies alone drop out before the join by a partial
    aggregate, so the join sees only groups that have something to report.  A look
    of more than ``split`` items is divided among tasks: its left side is salted,
    its right side stands in each part.  Rows given twice count once.
    """
    rows, groups = _varied(prints, kind)
    parts = F.ceil(F.col("members") / split).cast("int")
    rows = rows.join(groups.select(kind, "look", parts.alias("parts")), [kind, "look"])
    salt = F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")
    left = rows.select(kind, "look", salt.alias("salt"), F.col("item_id").alias("left_id"), F.col("raw").alias("left_raw"))
    right = rows.select(kind, "look", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("item_id").alias("right_id"), F.col("raw").alias("right_raw"))
    return (
        left.join(right, [kind, "look", "salt"])
        .where((F.col("left_id") < F.col("right_id")) & (F.col("left_raw") != F.col("right_raw")))
        .select(kind, "left_id", "right_id")
    )
