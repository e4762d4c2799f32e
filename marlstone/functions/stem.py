"""Snowball stemmers for Russian and English, applied to distinct tokens only.

Written from the published descriptions of the two algorithms; the suffix lists are theirs.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffixes of the Russian algorithm. Those marked A/Y count only after а or я.
RU_VOWELS = "аеиоуыэюя"
RU_GERUND_AY = ("в", "вши", "вшись")
RU_GERUND = ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
RU_REFLEXIVE = ("ся", "сь")
RU_ADJECTIVE = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
RU_PARTICIPLE_AY = ("ем", "нн", "вш", "ющ", "щ")
RU_PARTICIPLE = ("ивш", "ывш", "ующ")
RU_VERB_AY = ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно")
RU_VERB = (
    "ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит",
    "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю",
)
RU_NOUN = (
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у",
    "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я",
)
RU_SUPERLATIVE = ("ейш", "ейше")
RU_DERIVATIONAL = ("ост", "ость")


def _longest(word: str, start: int, suffixes, after_ay=()) -> int | None:
    """Where the longest of the suffixes begins, inside the region from ``start``; None if there is none."""
    best = None
    for group, need in ((suffixes, False), (after_ay, True)):
        for s in group:
            at = len(word) - len(s)
            if at >= start and word.endswith(s) and (not need or (at > start and word[at - 1] in "ая")) and (best is None or at < best):
                best = at
    return best


def stem_russian(word: str) -> str:
    word = word.replace("ё", "е")
    m = re.search(f"[{RU_VOWELS}]", word)
    if not m:
        return word
    rv = m.end()
    r1 = re.search(f"[{RU_VOWELS}][^{RU_VOWELS}]", word)
    r2 = re.search(f"[{RU_VOWELS}][^{RU_VOWELS}]", word[r1.end() :]) if r1 else None
    r2_at = r1.end() + r2.end() if r2 else len(word)
    # Step 1: a gerund ending, or else a reflexive one and then an adjectival, verb or noun ending.
    at = _longest(word, rv, RU_GERUND, RU_GERUND_AY)
    if at is not None:
        word = word[:at]
    else:
        at = _longest(word, rv, RU_REFLEXIVE)
        word = word if at is None else word[:at]
        at = _longest(word, rv, RU_ADJECTIVE)
        if at is not None:
            word = word[:at]
            at = _longest(word, rv, RU_PARTICIPLE, RU_PARTICIPLE_AY)
            word = word if at is None else word[:at]
        else:
            at = _longest(word, rv, RU_VERB, RU_VERB_AY)
            at = _longest(word, rv, RU_NOUN) if at is None else at
            word = word if at is None else word[:at]
    # Steps 2 to 4.
    if len(word) > rv and word.endswith("и"):
        word = word[:-1]
    at = _longest(word, max(rv, r2_at), RU_DERIVATIONAL)
    word = word if at is None else word[:at]
    if word.endswith("нн") and len(word) - 1 >= rv + 1:
        return word[:-1]
    at = _longest(word, rv, RU_SUPERLATIVE)
    if at is not None:
        word = word[:at]
        return word[:-1] if word.endswith("нн") and len(word) - 1 >= rv + 1 else word
    return word[:-1] if len(word) > rv and word.endswith("ь") else word


# The exceptions and suffixes of the English (Porter2) algorithm.
EN_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
EN_UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
EN_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
EN_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
EN_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
EN_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
V = "aeiouy"


def _ends_short(w: str) -> bool:
    return bool(re.search(f"[^{V}][{V}][^{V}wxY]$", w)) or bool(re.fullmatch(f"[{V}][^{V}]", w))


#: Suffixes in the order in which they are tried.
EN_ORDER2 = tuple(sorted([*EN_STEP2, "ogi", "li"], key=len, reverse=True))
EN_ORDER3 = tuple(sorted([*EN_STEP3, "ative"], key=len, reverse=True))
EN_ORDER4 = tuple(sorted([*EN_STEP4, "ion"], key=len, reverse=True))


def stem_english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EN_EXCEPTIONS:
        return EN_EXCEPTIONS[word]
    if word in EN_UNCHANGED:
        return word
    w = word.removeprefix("'")
    w = re.sub(f"(^|(?<=[{V}]))y", "Y", w)
    region = lambda s, i: (m.end() + i if (m := re.search(f"[{V}][^{V}]", s[i:])) else len(s))
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else region(w, 0)
    r2 = region(w, r1)
    w = re.sub("'s'$|'s$|'$", "", w)
    # Step 1a.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{V}]", w[:-2]):
        w = w[:-1]
    if w in EN_AFTER_1A:
        return w
    # Step 1b and 1c.
    if m := re.search("(eedly|eed)$", w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(f"[{V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _ends_short(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"

    def swap(w, table, extra, longest_first):
        if not w.endswith(longest_first):
            return w
        for s in longest_first:
            if w.endswith(s):
                at = len(w) - len(s)
                if at < r1:
                    return w
                return w[:at] + table[s] if s in table else extra[s](w, at)
        return w

    w = swap(w, EN_STEP2, {"ogi": lambda w, at: w[:-1] if w[at - 1 : at] == "l" else w, "li": lambda w, at: w[:at] if w[at - 1 : at] and w[at - 1] in "cdeghkmnrt" else w}, EN_ORDER2)
    w = swap(w, EN_STEP3, {"ative": lambda w, at: w[:at] if at >= r2 else w}, EN_ORDER3)
    for s in EN_ORDER4 if w.endswith(EN_ORDER4) else ():
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # Step 5.
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_token(token: str) -> str:
    """Russian if the token holds a Russian letter, else English."""
    return stem_russian(token) if re.search("[а-я]", token) else stem_english(token)


#: Stems that a worker remembers, and rows whose words it stems together: these hold fewer words than it remembers.
REMEMBERED = 1 << 18
TOGETHER = 512


@lru_cache(REMEMBERED)
def remembered_stem(token: str) -> str:
    return stem_token(token)


def _stemmed(rows: pa.ListArray) -> pa.ListArray:
    coded = rows.flatten().dictionary_encode()
    terms = pa.array([remembered_stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), terms.take(coded.indices))


def stems(words: Column) -> Column:
    """The stems of an array of words, in its order; words of some rows are stemmed together, and nothing is shuffled."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stem(col: pa.Array) -> pa.Array:
        return pa.concat_arrays([_stemmed(col.slice(i, TOGETHER)) for i in range(0, max(len(col), 1), TOGETHER)])

    return stem(words)


def snowball(tok: DataFrame) -> DataFrame:
    """(.., token) -> (.., term). Each distinct token is stemmed once and joined back."""

    @F.pandas_udf(T.StringType())
    def stem(col):
        return col.map(stem_token)

    stems = tok.select("token").distinct().withColumn("term", stem("token"))
    return tok.join(stems, "token").drop("token")
