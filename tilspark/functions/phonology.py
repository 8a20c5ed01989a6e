"""Vowel harmony and final-sound classes as Column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
FRONT = "әеіөүэ"
BACK = "аоұыя"
NEUTRAL = "иуё"
ROUNDED = "оөұүёю"
VOICELESS = "пфктсшщхһцч"
SONORANT = "рлмнңй"

VOWELS = FRONT + BACK + NEUTRAL


def _last_of(word: Column, letters: str) -> Column:
    return F.regexp_extract(word, f"([{letters}])[^{letters}]*$", 1)


def last_vowel(word: Column) -> Column:
    return F.nullif(_last_of(word, VOWELS), F.lit(""))


def harmony_class(word: Column) -> Column:
    """front or back: the last vowel that isn't neutral decides, else the last neutral one."""
    firm, neutral = _last_of(word, FRONT + BACK), _last_of(word, NEUTRAL)
    return F.when(firm != "", F.when(firm.isin(*FRONT), "front").otherwise("back")).when(neutral.isin("и", "ё"), "front").otherwise("back")


def is_rounded(word: Column) -> Column:
    return F.coalesce(_last_of(word, VOWELS).isin(*ROUNDED), F.lit(False))


def final_class(word: Column) -> Column:
    """vowel, voiceless, sonorant or voiced; an empty word counts as ending in a vowel."""
    last = F.right(word, F.lit(1))
    return (
        F.when((last == "") | last.isin(*VOWELS), "vowel").when(last.isin(*VOICELESS), "voiceless").when(last.isin(*SONORANT), "sonorant").otherwise("voiced")
    )
