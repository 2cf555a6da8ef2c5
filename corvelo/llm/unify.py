"""Problem 1: text that looks the same but differs in its characters.

`unify` gives the one consistent form (compatibility normalisation in composed form, full case folding,
white space mapped to plain spaces, default-ignorable characters removed, look-alike letters of other
scripts folded inside words), `disguised` names the values that needed it. Both are Arrow UDFs that work
once per distinct value of a batch, and only on values with a character beyond ASCII where that decides.
Neither shuffles, so a value that fills a third of the rows costs nothing extra.

Nulls stay null (`disguised`: false), empty text stays empty, a text of any length is taken whole,
repeated values give repeated results.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

# Letters of other alphabets, and rare Latin ones, with the Latin letter they look like.
DOUBLES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "у": "y", "ԝ": "w", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ϲ": "c", "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q",
    "ց": "g", "Օ": "O", "Ս": "U", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
# Greek small letters that stand alone as mathematical symbols.
SYMBOLS = set("αεικνρτυχωγ")
# Hyphens drawn like the plain one.
HYPHENS = {"‐": "-", "‑": "-"}

_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
_SPACE = regex.compile(r"[\p{Zs}\t\n\v\f\r\u0085\u2028\u2029]+")
_ODD_SPACE = regex.compile(r"[^\P{Zs} ]")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LATIN = regex.compile(r"\p{Latin}")
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}]")
#: Joiners and variation selectors have a visible use in these.
_JOINING = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Sinhala}\p{Malayalam}\p{Kannada}\p{Telugu}\p{Tamil}\p{Mongolian}\p{Khmer}\p{Extended_Pictographic}--[0-9#*]]", regex.V1)
_JOINERS = regex.compile(r"[\u200c\u200d\ufe0e\ufe0f]")
_TO_LATIN = str.maketrans(DOUBLES | HYPHENS)


def _is_double(word: str, latin_around: bool) -> bool:
    """Whether a word holds look-alikes: other alphabets mixed into Latin letters, or a word made of
    nothing else inside Latin text. A lone Greek letter used as a symbol is none."""
    if any(ch in "ɑɡɩ" for ch in word):
        return True
    foreign = _FOREIGN.findall(word)
    if not foreign:
        return False
    if _LATIN.search(word):
        return any(ch in DOUBLES for ch in foreign)
    if not latin_around or not all(ch in DOUBLES for ch in foreign):
        return False
    return len(foreign) > 1 or foreign[0] not in SYMBOLS


def fold_doubles(text: str) -> str:
    """Look-alike letters turned into the Latin ones, word by word; words of another script stay."""
    if not _FOREIGN.search(text) and not any(ch in "ɑɡɩ" for ch in text):
        return text
    others = [w for w in _WORD.findall(text) if len(w) > 1 and not _LATIN.search(w)]
    latin = bool(_LATIN.search(text)) and all(ch in DOUBLES for w in others for ch in _FOREIGN.findall(w))
    return _WORD.sub(lambda m: m[0].translate(_TO_LATIN) if _is_double(m[0], latin) else m[0], text)


def unify_text(text: str) -> str:
    """The consistent form of one text. Case folding may bring up letters that are folded in their turn (a
    subscript iota becomes a letter), so the form is taken until it stays."""
    form = _form(text)
    while not form.isascii() and (again := _form(form)) != form:
        form = again
    return form


def _form(text: str) -> str:
    if text.isascii():
        return _SPACE.sub(" ", text).strip(" ").casefold()
    text = unicodedata.normalize("NFKC", _IGNORABLE.sub("", text).translate(str.maketrans(HYPHENS)))
    text = fold_doubles(_SPACE.sub(" ", text).strip(" "))
    return unicodedata.normalize("NFKC", _IGNORABLE.sub("", text.casefold()))


def is_disguised(text: str) -> bool:
    """Whether a character stands in place of, or between, the ordinary ones without being seen.

    Counted: default-ignorable characters, spaces other than the plain one, letters composed of several
    characters where one exists, full-width and ligature forms, hyphens like the plain one, look-alike
    letters. Not counted: composed accents, ordinals and other raised forms, mathematical letters,
    words wholly in another script, plain double spaces, case, control characters of layout.
    """
    if text.isascii():
        return False
    if _ODD_SPACE.search(text) or any(ch in HYPHENS for ch in text):
        return True
    if _IGNORABLE.search(_JOINERS.sub("", text) if _JOINING.search(text) else text):
        return True
    if unicodedata.normalize("NFC", text) != text:
        return True
    for ch in text:
        if ord(ch) > 126 and (kind := unicodedata.decomposition(ch)).startswith("<"):
            tag = kind[1 : kind.index(">")]
            if tag in ("wide", "narrow") or tag == "compat" and unicodedata.category(ch)[0] in "LN" and not _FOREIGN.match(ch):
                return True
    return fold_doubles(text) != text


@pandas_udf(StringType())
def unify(values: pd.Series) -> pd.Series:
    """The consistent form of a string column."""
    known = {v: unify_text(v) for v in values.dropna().unique()}
    return values.map(known, na_action="ignore").astype(object).where(values.notna(), None)


@pandas_udf(BooleanType())
def _disguised(values: pd.Series) -> pd.Series:
    known = {v: is_disguised(v) for v in values.dropna().unique()}
    return values.map(lambda v: known.get(v, False) if v is not None else False).astype(bool)


def disguised(value: Column) -> Column:
    """True where a string column holds a disguised value; null and plain ASCII give false."""
    return F.coalesce(_disguised(value), F.lit(False))


BEYOND_ASCII = r"[^\x00-\x7F]"


def find_disguised(values: DataFrame, value: str = "value") -> DataFrame:
    """The rows of `values` whose column `value` is disguised; all columns stay. Plain ASCII rows are
    dropped in the JVM before the rest goes to Python."""
    return values.where(F.col(value).rlike(BEYOND_ASCII)).where(disguised(F.col(value)))


def unified(values: DataFrame, value: str = "value", into: str = "unified") -> DataFrame:
    """Adds the consistent form of `value` as column `into`, replacing a column of that name."""
    return values.withColumn(into, unify(F.col(value)))
