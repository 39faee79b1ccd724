"""Problem 10: visually identical text with different characters, brought to one form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.staging import staged

# Letters of one script that look like letters of another (Unicode Technical Standard 39), each as Latin, Cyrillic, Greek,
# Armenian; - where a script has none. Signs that are alike only in some typefaces (r and \u0433, k and \u03ba, u and \u03c5, y and \u04af) are left apart.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")
LOOK_ALIKE = """
aаα- cсϲ- eе-- g--ց hһ-հ iіι- jјϳյ lӏ-- n--ո oоοօ pрρ- qԛ-զ sѕ-- u--ս vѵν- wԝ-ա xх-- yу-- dԁ--
AАΑ- BВΒ- CСϹ- EЕΕ- GԌ-- HНΗ- IІΙ- JЈͿ- KКΚ- L--Լ MМΜ- N-Ν- OОΟՕ PРΡ- QԚ-- SЅ-Տ TТΤ- U--Ս VѴ-- WԜ-- XХΧ- YУΥ- Z-Ζ-
"""
DASHES = "‐‑‒–−﹘﹣－˗⁃"
APOSTROPHES = "‘’‛′ʼʹ＇΄᾽"
QUOTES = "“”‟″＂"


def _families() -> dict[str, tuple[str, ...]]:
    """letter -> its spelling in each of SCRIPTS; '' where a script has none."""
    rows = [tuple("" if c == "-" else c for c in row) for row in LOOK_ALIKE.split()]
    return {c: row for row in rows for c in row if c}


FAMILY = _families()
#: Letters with the accents that stand apart behind them.
WORD = re.compile("(?:[^\\W\\d_][\u0300-\u036f]*)+")
#: Compatibility forms that look like what they stand for. Raised, lowered, circled and fraction signs read differently.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>")


@lru_cache(maxsize=70_000)
def sign(c: str) -> str:
    """One character without its width, ligature or invisible kind; composition and script come later."""
    if c == "\n":
        return c
    category = unicodedata.category(c)
    if category == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or c in "͏ᅟᅠ឴឵ㅤﾠ" or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    if c in "\r\x85  \x0b\x0c":
        return "\n"
    if c.isspace() or category == "Zs" or c == "⠀":
        return " "
    if c in DASHES:
        return "-"
    if c in APOSTROPHES:
        return "'"
    if c in QUOTES:
        return '"'
    kind = unicodedata.decomposition(c).split(" ", 1)[0]
    if kind in SAME_LOOK and c not in FAMILY:
        plain = unicodedata.normalize("NFKC", c)
        return plain if plain == c else "".join(map(sign, plain))
    return c


#: Scripts of letters, as Unicode's Script_Extensions name them; letters of any other are told by the first word of their name.
KNOWN = {
    s: regex.compile(rf"\p{{Script_Extensions={s}}}")
    for s in "Latin Cyrillic Greek Armenian Hebrew Arabic Han Hiragana Katakana Hangul Thai Devanagari Bengali Tamil Telugu Georgian Cherokee Coptic Ethiopic Khmer Lao Myanmar Tibetan Mongolian".split()
}


@lru_cache(maxsize=70_000)
def scripts_of(c: str) -> frozenset[str]:
    """The scripts that use a letter; none for marks and letters common to all."""
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return frozenset(["Latin"])
    if regex.match(r"\p{Script=Common}|\p{Script=Inherited}", c):
        return frozenset()
    found = frozenset(s for s, p in KNOWN.items() if p.match(c))
    return found or frozenset([unicodedata.name(c, "?").split(" ", 1)[0]])


@lru_cache(maxsize=70_000)
def script_set(c: str) -> frozenset[str] | None:
    """The scripts in which a letter has a look-alike (its own included); None for one that binds to no script."""
    if c in FAMILY:
        return frozenset(s for s, x in zip(SCRIPTS, FAMILY[c], strict=True) if x)
    return (scripts_of(c) or None) if unicodedata.category(c)[0] == "L" else None


def resolved(word: str) -> frozenset[str] | None:
    """The scripts in which the whole word can be spelled: the intersection over its letters. None: any; empty: a word of
    two scripts that no single one can spell."""
    out = None
    for c in word:
        if (s := script_set(c)) is not None:
            out = s if out is None else out & s
    return out


def spelled(word: str, script: str) -> str:
    """The word with every letter that has a look-alike in `script` in that script."""
    k = SCRIPTS.index(script)
    return "".join(FAMILY[c][k] or c if c in FAMILY else c for c in word)


def one_form(text: str) -> str:
    """The text in one form, the same for all texts that read the same sign by sign.

    Invisible signs go; each blank becomes a blank, each line end \\n; runs of blanks one; widths, ligatures and fonts fall away; letters and
    accents are composed. A word that one script can spell whole, but whose letters come from several, or from look-alikes
    of another, is spelled in that script. What decides depends only on signs that have no look-alike, so that
    every disguise of a word gives the same answer: the word's own letters first; where all of them have a twin (a whole-script
    confusable), the script most of the text's decided words are in, ties as in SCRIPTS. A word of letters that no
    single script can spell keeps its undisguised letters, its others are spelled in Latin.
    """
    if text.isascii():
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        text = "".join(map(sign, text)) if not text.isprintable() else text
        plain = True
    else:
        text = unicodedata.normalize("NFC", "".join(map(sign, unicodedata.normalize("NFD", text.replace("\r\n", "\n")))))
        plain = text.isascii()
    text = re.sub(r" +", " ", text)
    if not plain:
        text = unicodedata.normalize("NFD", text)  # look-alikes are told by their letters; accents go along
        words = WORD.findall(text)
        if any(scripts_of(c) - {"Latin"} for w in set(words) for c in w):
            votes = dict.fromkeys(SCRIPTS, 0)
            sets = {w: resolved(w) for w in set(words)}
            for w in words:
                s = sets[w]
                if s and len(s) == 1 and (one := next(iter(s))) in votes:
                    votes[one] += 1
            text = WORD.sub(lambda m: _word(m[0], sets.get(m[0]), votes), text)
        text = unicodedata.normalize("NFC", text)
    return text


def _word(word: str, scripts: frozenset[str] | None, votes: dict[str, int]) -> str:
    if scripts is None:
        return word
    able = [s for s in SCRIPTS if s in scripts]
    if len(able) == 1:
        return spelled(word, able[0])
    if able:
        return spelled(word, max(able, key=lambda s: votes[s]))
    return spelled(word, "Latin") if not scripts and any(c in FAMILY for c in word) else word


def normalized(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with `form`: the text in one form. Null stays null, a blank text becomes ''. One pass, without a shuffle.

    A column `form` that is there already is replaced; all others are kept.
    """
    rest = [c for c in documents.columns if c != "form"]
    form = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else one_form(x).strip() or ""), "string")
    return documents.select(*rest, form(F.col(text)).alias("form"))


#: Spellings of one form that one task pairs; a form with more is cut into parts.
SPELLINGS = 2000


def same_reading(documents: DataFrame, spellings: int = SPELLINGS) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b) of different strings with one form, by the digests of the strings; members (doc_id, form_key, text_key)
    of the forms that have several strings.

    Blank texts have no sign to read and are in no pair. Equal strings are one class, whatever their number, and only
    classes whose form has another string are paired; so a text with a third of all rows costs one row a task. A form of very many
    spellings is cut into parts on one side, each of which meets the whole other side once.
    """

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        key = lambda x: hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for p in parts:
            forms = [one_form(x).strip() for x in p.text]
            keep = [i for i, f in enumerate(forms) if f]
            yield pd.DataFrame({"doc_id": p.doc_id.to_numpy()[keep], "text_key": [key(p.text.iloc[i]) for i in keep], "form_key": [key(forms[i]) for i in keep]})

    keyed = staged(documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(digest, "doc_id long, text_key binary, form_key binary"))
    strings = keyed.select("form_key", "text_key").distinct()
    several = staged(strings.groupBy("form_key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / spellings).cast("int")))
    variants = staged(strings.join(several.select("form_key", "parts"), "form_key"))
    left = variants.select("form_key", F.col("text_key").alias("a"), F.pmod(F.xxhash64("text_key"), F.col("parts")).cast("int").alias("part"))
    right = variants.select("form_key", F.col("text_key").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["form_key", "part"]).where("a < b").select("a", "b")
    members = staged(keyed.join(several.select("form_key"), "form_key", "left_semi").select("doc_id", "form_key", "text_key").distinct())
    return pairs, members


def reading_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, reading, spelling): of each document whose text reads like a different string, the smallest doc_id of all that read the
    same, and of those that are the same string. A document id with several texts is in several classes."""
    _, members = same_reading(documents)
    readings = members.groupBy("form_key").agg(F.min("doc_id").alias("reading"))
    strings = members.groupBy("text_key").agg(F.min("doc_id").alias("spelling"))
    return members.join(readings, "form_key").join(strings, "text_key").select("doc_id", "reading", "spelling")


def found_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller first: documents whose texts are different strings but read the same."""
    pairs, members = same_reading(documents)
    return (
        pairs.join(members.select(F.col("text_key").alias("a"), F.col("doc_id").alias("x")), "a")
        .join(members.select(F.col("text_key").alias("b"), F.col("doc_id").alias("y")), "b")
        .where("x <> y")
        .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
        .distinct()
    )
