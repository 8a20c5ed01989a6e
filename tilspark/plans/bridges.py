"""Inputs that both engines can make from the test tables: Cyrillic from Latin text, inflected words
and frame matrices from ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch

LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абсдефгһіжклмнопқрстұвухйз"
ROOTS = ["мектеп", "бала", "үй", "кітап", "дос", "қала", "кел", "бар", "оқы", "кет", "жаз", "көз"]
ENDINGS = ["", "лер", "лар", "тер", "тар", "ым", "ім", "сы", "сі", "да", "де", "та", "те", "ның", "нің", "лары", "лерім", "ларына", "терімде", "ды", "ді", "ты", "ті", "дым", "дім", "медім", "мады", "амын", "емін"]


def translit(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, CYRILLIC)


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))


def inflected(n: Column) -> Column:
    """A root with an ending, both chosen by a number."""
    return F.concat(_pick(ROOTS, n), _pick(ENDINGS, F.floor(n / len(ROOTS)).cast("bigint")))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; a text function takes longer than a shuffle, so one row group goes to all cores."""
    return scratch.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def sql_translit(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{CYRILLIC}')"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_inflected(n: str) -> str:
    return f"({sql_list(ROOTS)}[(({n}) % {len(ROOTS)} + 1)::INT] || {sql_list(ENDINGS)}[((({n}) // {len(ROOTS)}) % {len(ENDINGS)} + 1)::INT])"
