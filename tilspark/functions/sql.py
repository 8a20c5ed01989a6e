"""SQL names for the column functions (``register(spark)``), as temporary SQL functions where their
body is an expression and as Arrow functions where it isn't."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import phonology, text


def register(spark: SparkSession) -> None:
    from ..operators.morphology import local_tokens

    @F.pandas_udf("array<string>")
    def morphemes(words: pd.Series) -> pd.Series:
        return words.map(lambda w: local_tokens(w or ""))

    @F.pandas_udf("string")
    def gloss(words: pd.Series) -> pd.Series:
        return words.map(lambda w: "+".join(local_tokens(w or "")))

    @F.pandas_udf("root string, tags array<string>")
    def analyze(words: pd.Series) -> pd.DataFrame:
        parses = [local_tokens(w or "") for w in words]
        return pd.DataFrame({"root": [p[0] for p in parses], "tags": [p[1:] for p in parses]})

    spark.udf.register("kaz_analyze", analyze)
    spark.udf.register("kaz_morphemes", morphemes)
    spark.udf.register("kaz_gloss", gloss)
    one = spark.range(1).select(F.lit("").alias("x"))
    for name, make in (("kaz_harmony", phonology.harmony_class), ("kaz_final_class", phonology.final_class)):
        body = one.select(make(F.col("x")))._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kaz_words(x STRING) RETURNS ARRAY<STRING> RETURN filter(split(coalesce(x, ''), r'(?U)\\s+'), w -> w <> '')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kaz_normalize(x STRING) RETURNS STRING RETURN {_normalize_sql()}")


def _normalize_sql() -> str:
    """``text.normalize`` with its defaults, spelled in SQL (lambdas have no SQL form in a plan)."""
    out = "coalesce(x, '')"
    for parts, letter in text.COMPOSED:
        out = f"replace({out}, '{parts}', '{letter}')"
    out = f"lower({out})"
    for short, full in text.ABBREVIATIONS:
        out = f"replace({out}, '{short}', ' {full} ')"
    latin = f"if(rlike(r, '^[{text.HOMOGLYPHS_FROM}]+$'), translate(r, '{text.HOMOGLYPHS_FROM}', '{text.HOMOGLYPHS_TO}'), r)"
    out = f"array_join(transform(regexp_extract_all({out}, '[a-z]+|[^a-z]+', 0), r -> {latin}), '')"
    words = ", ".join(f"'{w}'" for w in text.DIGITS)
    digits = f"if(rlike(r, '^[0-9]+$'), array_join(transform(filter(split(r, ''), d -> d <> ''), d -> element_at(array({words}), cast(d as int) + 1)), ' '), r)"
    out = f"array_join(transform(regexp_extract_all({out}, '[0-9]+|[^0-9]+', 0), r -> {digits}), '')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^{text.ALPHABET} ]', ' '), r'(?U)\\s+', ' '))"
