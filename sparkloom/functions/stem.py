"""Porter's stemmer (M. F. Porter, 1980) and its vectorised form."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_C, _V = "[^aeiou](?:[^aeiouy]*)", "[aeiouy](?:[aeiou]*)"
_M0 = re.compile(f"^(?:{_C})?{_V}{_C}")
_M1 = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_M2 = re.compile(f"^(?:{_C})?(?:{_V}{_C}){{2}}")
_VOWEL = re.compile(f"^(?:{_C})?[aeiouy]")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log", "bli": "ble"}
_STEP2.pop("abli")  # covered by bli
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 18)
def porter(w: str) -> str:
    """The stem of a lower-case ASCII word; anything else is returned as it is."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w[0] == "y":
        w = "Y" + w[1:]
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _M0.match(w[:-3]):
            w = w[:-1]
    elif (s := _longest(w, ("ed", "ing"))) and _VOWEL.match(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz" and w[-1] != "y":
            w = w[:-1]
        elif _CVC.match(w):
            w += "e"
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (s := _longest(w, table)) and _M0.match(w[: -len(s)]):
            w = w[: -len(s)] + table[s]
    if s := _longest(w, (*_STEP4, "ion")):
        stem = w[: -len(s)]
        if _M2.match(stem) and (s != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        stem = w[:-1]
        if _M2.match(stem) or (_M1.match(stem) and not _CVC.match(stem)):
            w = stem
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return "y" + w[1:] if w[0] == "Y" else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(terms: pd.Series) -> pd.Series:
    """Stems of an array of terms, batch by batch."""
    return terms.map(lambda ts: None if ts is None else [porter(t) for t in ts])
