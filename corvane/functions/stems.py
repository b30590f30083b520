"""German and English stems of lower-case tokens as native column expressions.

German: the CISTEM rules (Weissweiler and Fraser, 2017) in their case-blind form.  English: the first
step of Porter's algorithm (1980): plurals, -ed, -ing and final y.  Each rule is one regular
expression without look-around, so the twins can say the same in SQL.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that stand for letter groups, endings that fall and what they leave.
GERMAN_GROUPS = (("sch", "$"), ("ei", "%"), ("ie", "&"))
GERMAN_ENDINGS = r"^(?:(.{3})[tesn](?:e[mr]|nd|[tesn])*|(.{4,}?)(?:e[mr]|nd|[tesn])+)$"
GERMAN_STOP = "der die das den dem des ein eine einer eines und oder von zu im auf für mit ist sind".split()
ENGLISH_STOP = "the a an and or of to in on for with is are was were be by at as it".split()
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
HAS_VOWEL, SOME_MEASURE = f"^(?:{CONSONANTS})?[aeiouy]", f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"
SHORT_STEM = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def german_stem(c) -> Column:
    """``verträge``, ``vertrag`` and ``vertrags`` become ``vertrag``; umlauts lose their dots."""
    t = F.regexp_replace(F.translate(_col(c), "äöü", "aou"), "ß", "ss")
    t = F.regexp_replace(t, "^ge(.{4,})$", "$1")
    for group, mark in GERMAN_GROUPS:
        t = F.replace(t, F.lit(group), F.lit(mark))
    t = F.regexp_replace(t, r"(.)\1", "$1*")
    t = F.regexp_replace(t, GERMAN_ENDINGS, "$1$2")
    t = F.regexp_replace(t, r"(.)\*", "$1$1")
    for group, mark in GERMAN_GROUPS:
        t = F.replace(t, F.lit(mark), F.lit(group))
    return t


def with_stems(df: DataFrame, word: str = "word") -> DataFrame:
    """Adds ``german`` and ``english``, the stems of a column of lower-case words.

    ``houses`` becomes ``house`` in English, ``running`` and ``runs`` ``run``, ``cities`` and ``city`` ``citi``.
    Each step is a column, so it is computed once however often the next one asks for it.
    """
    w = F.col(word)
    single = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "sses$", "ss"), "ies$", "i"), "([^s])s$", "$1")
    df = df.withColumn("german", german_stem(word)).withColumn("_one", F.when(F.length(w) <= 2, w).otherwise(single))
    df = df.withColumn("_cut", F.regexp_replace("_one", "(?:ed|ing)$", ""))
    one, cut = F.col("_one"), F.col("_cut")
    doubled = (F.substring(cut, -1, 1) == F.substring(cut, -2, 1)) & cut.rlike("..[^aeiouylsz]$")
    mended = F.when(cut.rlike("(?:at|bl|iz)$"), F.concat(cut, F.lit("e"))).when(doubled, F.regexp_replace(cut, ".$", "")).when(cut.rlike(SHORT_STEM), F.concat(cut, F.lit("e"))).otherwise(cut)
    agreed = F.regexp_replace(one, f"({SOME_MEASURE}.*)eed$".replace("(^", "^("), "$1ee")
    df = df.withColumn("_two", F.when(one.rlike("eed$"), agreed).when((cut != one) & cut.rlike(HAS_VOWEL), mended).otherwise(one))
    df = df.withColumn("english", F.regexp_replace("_two", f"({HAS_VOWEL}.*)y$".replace("(^", "^("), "$1i"))
    return df.drop("_one", "_cut", "_two")


_ENDINGS, _EED = re.compile(GERMAN_ENDINGS), re.compile(f"({SOME_MEASURE}.*)eed$".replace("(^", "^("))
_VOWEL, _SHORT, _Y = re.compile(HAS_VOWEL), re.compile(SHORT_STEM), re.compile(f"({HAS_VOWEL}.*)y$".replace("(^", "^("))
_UMLAUTS = str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss"})


@lru_cache(maxsize=1 << 17)
def stems(word: str) -> tuple[str, str]:
    """The German and the English stem of one lower-case word as with_stems() gives them, for tasks that hold whole texts."""
    t = re.sub("^ge(.{4,})$", r"\1", word.translate(_UMLAUTS))
    for group, mark in GERMAN_GROUPS:
        t = t.replace(group, mark)
    t = re.sub(r"(.)\*", r"\1\1", _ENDINGS.sub(r"\1\2", re.sub(r"(.)\1", r"\1*", t)))
    for group, mark in GERMAN_GROUPS:
        t = t.replace(mark, group)
    one = word if len(word) <= 2 else re.sub("([^s])s$", r"\1", re.sub("ies$", "i", re.sub("sses$", "ss", word)))
    cut, two = re.sub("(?:ed|ing)$", "", one), one
    if one.endswith("eed"):
        two = _EED.sub(r"\1ee", one)
    elif cut != one and _VOWEL.search(cut):
        if re.search("(?:at|bl|iz)$", cut):
            two = cut + "e"
        elif cut[-1] == cut[-2:-1] and re.search("..[^aeiouylsz]$", cut):
            two = cut[:-1]
        else:
            two = cut + "e" if _SHORT.search(cut) else cut
    return t, _Y.sub(r"\1i", two)
