"""The Porter stemmer (Porter 1980), for words of a-z; any other word is its own stem."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The suffixes of the published algorithm's steps 2 to 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
_LETTERS = re.compile("[a-z]{3,}")


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str]) -> str:
    for n in range(7, 1, -1):
        end = word[-n:]
        if len(word) >= n and end in table:
            return word[:-n] + table[end] if _measure(word[:-n]) > 0 else word
    return word


def stem(word: str) -> str:
    if not _LETTERS.fullmatch(word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = ""
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and _vowel(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _vowel(word[:-3]):
        cut = word[:-3]
    if cut:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif _double(cut) and cut[-1] not in "lsz":
            cut = cut[:-1]
        elif _measure(cut) == 1 and _cvc(cut):
            cut += "e"
        word = cut
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2), STEP3)
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _cvc(rest)):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    distinct = words.dropna().unique()
    return words.map(dict(zip(distinct, map(stem, distinct), strict=True)))


def stemmed(word: Column) -> Column:
    """Stems by Arrow batches, each distinct word of a batch once."""
    return _stems(word)
