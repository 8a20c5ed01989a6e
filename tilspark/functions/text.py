"""Normalisation and tokenisation of transcripts as Column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
ALPHABET = "аәбвгғдеёжзийкқлмнңоөпрстуұүфһхцчшщъыіьэюя"
HOMOGLYPHS_FROM = "aeocpxykmthb"
HOMOGLYPHS_TO = "аеосрхукмтһв"
DIGITS = ["нөл", "бір", "екі", "үш", "төрт", "бес", "алты", "жеті", "сегіз", "тоғыз"]
ABBREVIATIONS = [
    ("т.б.", "тағы басқа"),
    ("т.с.с.", "тағы сол сияқты"),
    ("және т.б.", "және тағы басқа"),
    ("ғ.", "ғасыр"),
    ("жыл.", "жыл"),
]
#: letters of the alphabet that have a decomposed form
COMPOSED = [("й", "й"), ("Й", "Й"), ("ё", "ё"), ("Ё", "Ё")]


def compose(text: Column) -> Column:
    """NFC for the letters of the alphabet, without leaving the JVM."""
    for parts, letter in COMPOSED:
        text = F.replace(text, F.lit(parts), F.lit(letter))
    return text


def compose_exact(text: Column) -> Column:
    """NFC of everything, by an Arrow function."""
    import unicodedata

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return nfc(text)


def by_runs(text: Column, pattern: str, change) -> Column:
    """Applies ``change`` to the runs that ``pattern`` (a character class) matches, in place.  Texts
    without any such character are not taken apart."""
    inside = f"[{pattern}]+"
    runs = F.regexp_extract_all(text, F.lit(f"{inside}|[^{pattern}]+"), F.lit(0))
    whole = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{pattern}]"), change(r)).otherwise(r)), "")
    return F.when(text.rlike(f"[{pattern}]"), whole).otherwise(text)


def expand_abbreviations(text: Column) -> Column:
    for short, full in ABBREVIATIONS:
        text = F.replace(text, F.lit(short), F.lit(f" {full} "))
    return text


def repair_homoglyphs(text: Column) -> Column:
    """Latin runs that consist of look-alike letters only become Cyrillic."""
    return by_runs(text, "a-z", lambda r: F.when(r.rlike(f"^[{HOMOGLYPHS_FROM}]+$"), F.translate(r, HOMOGLYPHS_FROM, HOMOGLYPHS_TO)).otherwise(r))


def expand_digits(text: Column) -> Column:
    """Each run of digits as digit words; the words are not set apart from what stands next to them."""
    text = F.regexp_replace(text, "([0-9])(?=[0-9])", "$1 ")
    for digit, word in enumerate(DIGITS):
        text = F.replace(text, F.lit(str(digit)), F.lit(word))
    return text


#: a run of Latin letters that aren't all look-alikes, from its beginning (so that each letter is looked at once)
_FOREIGN = f"(?<![a-z])[{HOMOGLYPHS_FROM}]*+[a-z&&[^{HOMOGLYPHS_FROM}]][a-z]*+"
#: the range of code points that the alphabet lies in, and what else it holds: a class of one range is
#: looked up many times faster than one of ten
_LOW, _HIGH = min(ALPHABET), max(ALPHABET)
_OTHERS = "".join(c for c in map(chr, range(ord(_LOW), ord(_HIGH) + 1)) if c not in ALPHABET)


def _where(text: Column, pattern: str, change) -> Column:
    """``change`` of the texts in which the pattern is found.  A lambda's parameter is bound once; an
    expression that ``when`` names twice would be computed twice."""
    return F.element_at(F.transform(F.array(text), lambda x: F.when(x.rlike(pattern), change(x)).otherwise(x)), 1)


def normalize(text: Column, *, expand_numbers: bool = True, keep_unknown: bool = False, exact_nfc: bool = False) -> Column:
    """A transcript in the alphabet and single blanks; null gives the empty string."""
    text = F.coalesce(text, F.lit(""))
    text = F.lower(compose_exact(text) if exact_nfc else _where(text, "[\u0306\u0308]", compose))
    text = _where(text, "[тғл][.]", expand_abbreviations)
    if keep_unknown:
        text = repair_homoglyphs(text)
    else:  # other runs of Latin letters become blanks in the end, and those left are look-alikes only
        text = _where(text, "[a-z]", lambda x: F.regexp_replace(x, _FOREIGN, " "))
        text = F.translate(text, HOMOGLYPHS_FROM + _OTHERS, HOMOGLYPHS_TO + " " * len(_OTHERS))
    if expand_numbers:
        text = _where(text, "[0-9]", expand_digits)
    if keep_unknown:
        return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    # only blanks are left of all white space, and a run of other characters is one match
    return F.trim(F.regexp_replace(text, f"[^{_LOW}-{_HIGH}]+", " "))


def normalized_words(text: Column) -> Column:
    """``words(normalize(text))``: single blanks are all that is left between words."""
    return F.array_remove(F.split(normalize(text), " "), "")


def words(text: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def characters(text: Column) -> Column:
    """Code points without blanks."""
    return F.filter(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(" ")), ""), lambda c: c != "")


def spoken(prefix: Column, delimiter: str = "|") -> Column:
    """A decoder's prefix as text."""
    return F.trim(F.replace(prefix, F.lit(delimiter), F.lit(" ")))
