"""Word error rate that charges a wrong suffix on the right root less than a wrong word."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import alignment as L
from . import morphology as M


@dataclass(frozen=True)
class MorphWER:
    w_root: float = 1.0
    w_suffix: float = 0.35
    insertion_cost: float = 1.0
    deletion_cost: float = 1.0
    collect_examples: int = 12


def aligned(pairs: DataFrame, *, id_col: str = "utt_id", ref_col: str = "ref", hyp_col: str = "hyp") -> DataFrame:
    """``utt_id, pos, op, ref, hyp``: one row for each operation."""
    ops = L.align(T.words(F.col(ref_col)), T.words(F.col(hyp_col)))
    return pairs.select(F.col(id_col).alias("utt_id"), F.explode(ops).alias("o")).select("utt_id", "o.*")


def substitution_costs(ops: DataFrame, params: MorphWER = MorphWER(), seg: M.Segmenter = M.Segmenter()) -> DataFrame:
    """``ref, hyp, cost, kind`` of each distinct substituted pair.  Words are analysed in the pair's
    row: no join brings analyses back, and a frequent pair is analysed once."""
    pairs = ops.where(F.col("op") == "sub").select("ref", "hyp").distinct()
    pairs = pairs.withColumn("r", M.best(F.col("ref"), seg)).withColumn("h", M.best(F.col("hyp"), seg))
    r, h = M.suffix_chain(F.col("r")), M.suffix_chain(F.col("h"))
    share = L.edit_distance(r, h).cast("double") / F.greatest(F.size(r), F.size(h), F.lit(1))
    same = F.col("r.root") == F.col("h.root")
    cost = F.when(same, F.lit(params.w_suffix) * share).otherwise(F.lit(params.w_root) + F.lit(params.w_suffix) * share)
    return pairs.select("ref", "hyp", cost.alias("cost"), F.when(same, "suffix").otherwise("root").alias("kind"))


def costed(ops: DataFrame, params: MorphWER = MorphWER(), seg: M.Segmenter = M.Segmenter()) -> DataFrame:
    """The operations with ``cost`` and ``kind`` (exact, suffix, root, ins, del)."""
    out = ops.join(substitution_costs(ops, params, seg).withColumn("op", F.lit("sub")), ["op", "ref", "hyp"], "left")
    cost = F.when(F.col("op") == "sub", F.col("cost")).when(F.col("op") == "ins", params.insertion_cost).when(F.col("op") == "del", params.deletion_cost).otherwise(0.0)
    kind = F.when(F.col("op") == "sub", F.col("kind")).when(F.col("op") == "match", "exact").otherwise(F.col("op"))
    return out.withColumn("cost", cost).withColumn("kind", kind)


def morph_wer(pairs: DataFrame, params: MorphWER = MorphWER(), seg: M.Segmenter = M.Segmenter(), **columns) -> DataFrame:
    """One row: ``m_wer, wer_equivalent, n_ref_words, exact, suffix_only, root_errors, insertions, deletions, total_cost``."""
    ops = costed(aligned(pairs, **columns), params, seg)
    count = lambda k: F.count_if(F.col("kind") == k)
    sums = ops.agg(
        F.count_if(F.col("ref").isNotNull()).alias("n_ref_words"), count("exact").alias("exact"), count("suffix").alias("suffix_only"), count("root").alias("root_errors"),
        count("ins").alias("insertions"), count("del").alias("deletions"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
    )
    n = F.greatest(F.col("n_ref_words"), F.lit(1))
    errors = F.col("suffix_only") + F.col("root_errors") + F.col("insertions") + F.col("deletions")
    return sums.select((F.col("total_cost") / n).alias("m_wer"), (errors.cast("double") / n).alias("wer_equivalent"), "*")


def examples(pairs: DataFrame, params: MorphWER = MorphWER(), seg: M.Segmenter = M.Segmenter(), **columns) -> DataFrame:
    """The first substitutions with the right root, in corpus order, as text."""
    ops = costed(aligned(pairs, **columns), params, seg).where(F.col("kind") == "suffix")
    # a dozen rows; the JVM would round ties of decimal digits, which binary fractions aren't
    @F.pandas_udf("string")
    def two(costs: pd.Series) -> pd.Series:
        return costs.map(lambda x: f"{x:.2f}")

    line = F.format_string("'%s' -> '%s'  (root ok, suffix Δ, cost=%s)", "ref", "hyp", two("cost"))
    return ops.orderBy("utt_id", "pos").limit(params.collect_examples).select("utt_id", "pos", line.alias("example"))


def summary(result: DataFrame) -> str:
    r = result.first()
    # fixed value: the line's layout
    return f"M-WER={r.m_wer:.4f}  (WER={r.wer_equivalent:.4f})  exact={r.exact} suffix-only={r.suffix_only} root-err={r.root_errors} ins={r.insertions} del={r.deletions}"
