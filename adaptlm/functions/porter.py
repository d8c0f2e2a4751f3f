"""The published Porter stemming algorithm, applied to distinct terms by a pandas UDF.

Departures, as its author marks them: bli gives ble, logi gives log.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffixes and what replaces them, by step of the algorithm.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_RUNS = re.compile(r"v+c+")


def _form(stem: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(_RUNS.findall(_form(stem)))


def _short_end(stem: str) -> bool:
    """consonant, vowel, consonant other than w, x, y at the end."""
    return _form(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of a word, in lower case; words of one or two letters are not shortened."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "v" in _form(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "c":
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            keep = 1 if suffix in ("sion", "tion") else 0  # ion goes, the letter before it stays
            base = w[: len(w) - len(suffix) + keep]
            if _measure(base) > 1:
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem_column(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else stem(t))


def stemmed(df: DataFrame, column: str = "term") -> DataFrame:
    """df with its terms replaced by their stems; each distinct term is stemmed once."""
    table = df.select(F.col(column).alias("_raw")).distinct().withColumn("_stem", stem_column("_raw"))
    return df.join(table, F.col(column) == F.col("_raw")).withColumn(column, F.col("_stem")).drop("_raw", "_stem")
