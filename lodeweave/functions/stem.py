"""Porter's suffix stripping (Program 14(3), 1980, with the author's two later rules) over a vocabulary's distinct terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The published rules, suffix to replacement.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

# a word as a string of c (consonant) and v (vowel) lets every condition be a pattern
_MEASURE, _CVC = re.compile("v+c+"), re.compile("cvc$")


def shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    return len(_MEASURE.findall(shape(word)))


def _short(word: str) -> bool:
    return bool(_CVC.search(shape(word))) and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word of ASCII letters; every other word is its own."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    word = re.sub("(ss|i)es$", r"\1", word) if word.endswith("es") and word[-4:-2] == "ss" or word.endswith("ies") else re.sub("(?<!s)s$", "", word)
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    elif (cut := _longest(word, ("ed", "ing"))) and "v" in shape(word[: -len(cut)]):
        word = word[: -len(cut)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word):
            word = word if word[-1] in "lsz" else word[:-1]
        elif measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        if (cut := _longest(word, rules)) and measure(word[: -len(cut)]):
            word = word[: -len(cut)] + rules[cut]
    if cut := _longest(word, STEP4):
        rest = word[: -len(cut)]
        if measure(rest) > 1 and (cut != "ion" or rest[-1] in "st"):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not _short(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stemmed(rows: DataFrame, term: str = "term") -> DataFrame:
    """rows with term replaced by its stem; each distinct term is stemmed once, not each occurrence."""
    known = rows.select(F.col(term)).distinct().withColumn("_stem", _stems(F.col(term)))
    return rows.join(known, term).withColumn(term, F.col("_stem")).drop("_stem")


def stems(words: Column) -> Column:
    """The stem of each word of a short text's column, such as a query's."""
    return _stems(words)
