"""English stems by the published Snowball rules, made once for each distinct term, and the words that are not indexed."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that the English configuration leaves out.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now"
).split()

# Fixed values of the rules: words with a stem of their own, words that stay after the first step, endings and what they become.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
DONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL = re.compile("[aeiouy]")


def _after(word: str, begin: int) -> int:
    m = _REGION.search(word, begin)
    return m.end() if m else len(word)


def _ending(word: str, endings) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), None)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words that are not of a-z and apostrophes alone stay as they are."""
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.lstrip("'")
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    lead = re.match("gener|commun|arsen", w)
    r1 = lead.end() if lead else _after(w, 0)
    r2 = _after(w, r1)
    # possessives and plurals
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in DONE:
        return w
    # past and present participles
    e = _ending(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and _VOWEL.search(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # suffixes, from compound to single ones
    e = _ending(w, SECOND)
    if e and len(w) - len(e) >= r1 and not (e == "ogi" and not w.endswith("logi")) and not (e == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
        w = w[: -len(e)] + SECOND[e]
    e = _ending(w, THIRD)
    if e and len(w) - len(e) >= r1 and (e != "ative" or len(w) - len(e) >= r2):
        w = w[: -len(e)] + THIRD[e]
    e = _ending(w, FOURTH)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stems(terms: DataFrame) -> DataFrame:
    """term, stem for the distinct terms given (term)."""

    @F.pandas_udf("string")
    def made(s: pd.Series) -> pd.Series:
        return s.map(stem, na_action="ignore")

    return terms.select("term").distinct().withColumn("stem", made("term"))
