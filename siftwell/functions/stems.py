"""English stems (the Porter2 rules) of arrays of words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Words that full text leaves out.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now
""".split()
# Fixed values of the Porter2 rules: words with stems of their own, endings and what they become.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
KEPT_SINGULAR = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
LONG_STARTS = ("gener", "commun", "arsen")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

POSTINGS = ArrayType(StructType([StructField("stem", StringType()), StructField("positions", ArrayType(IntegerType()))]))
STOP = set(STOPWORDS)

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _region(word: str, start: int) -> int:
    """What comes after the first non-vowel that follows a vowel, from a place on."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has, or nothing."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a lower-case word without apostrophes."""
    if len(word) < 3 or word in KEPT:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    r1 = next((len(s) for s in LONG_STARTS if word.startswith(s)), None) or _region(word, 0)
    r2 = _region(word, r1)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word, 0, len(word) - 2):
        word = word[:-1]
    if word in KEPT_SINGULAR:
        return word
    # past forms and participles
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        word = word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    elif end and _VOWEL.search(word, 0, len(word) - len(end)):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # suffixes of suffixes
    end = _ending(word, STEP2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if not (end == "ogi" and not before.endswith("l")) and not (end == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            word = before + STEP2[end]
    end = _ending(word, STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP3[end]
    end = _ending(word, STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    # a last e or l
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT_END.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and at >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _mapped(words: pa.Array, of) -> pa.Array:
    """The arrays with each word replaced; each distinct one is looked at once."""
    flat = words.flatten().dictionary_encode()
    own = pa.array([None if w is None else of(w) for w in flat.dictionary.to_pylist()], pa.string())
    values = own.take(flat.indices) if len(own) else pa.nulls(len(flat), pa.string())
    sizes = np.asarray(pc.fill_null(pc.list_value_length(words), 0))
    edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(edges, values, mask=words.is_null() if words.null_count else None)


@F.arrow_udf(ArrayType(StringType()))
def _stems(words: pa.Array) -> pa.Array:
    return _mapped(words, stem)


def _content(word: str) -> str | None:
    return None if word in STOP else stem(word)


@F.arrow_udf(ArrayType(StringType()))
def _content_stems(words: pa.Array) -> pa.Array:
    return _mapped(words, _content)


@F.arrow_udf(POSTINGS)
def positions(words: pa.Array) -> pa.Array:
    """stem and positions (from 1, ascending) of each distinct stem of an array of words, without stop words; nulls have none."""
    found = _mapped(words.fill_null([]), _content)
    coded = found.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(found)), np.diff(found.offsets))
    place = np.arange(len(coded)) - np.asarray(found.offsets)[row] + 1
    known = np.asarray(coded.is_valid())
    row, place, code = row[known], place[known], np.asarray(coded.indices.drop_null())
    order = np.lexsort((place, code, row))
    row, place, code = row[order], place[order], code[order]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(place.astype(np.int32)))
    each = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code[first])), lists], ["stem", "positions"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(len(found) + 1)).astype(np.int32)), each)


def stems(words: Column, stopwords: bool = True) -> Column:
    """The stem of each word of an array; without `stopwords`, these are null."""
    return _stems(words) if stopwords else _content_stems(words)
