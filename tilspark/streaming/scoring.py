"""Streams of transcripts: running error rates and word counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import alignment as L


def windowed_wer(pairs: DataFrame, *, ts_col: str = "ts", ref_col: str = "ref", hyp_col: str = "hyp", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``start, edits, n_ref`` of each window of event time; works on streams and tables alike."""
    rows = pairs.withWatermark(ts_col, late) if pairs.isStreaming else pairs
    rows = rows.select(F.col(ts_col).alias("ts"), T.words(F.col(ref_col)).alias("r"), T.words(F.col(hyp_col)).alias("h"))
    rows = rows.select("ts", L.edit_distance(F.col("r"), F.col("h")).alias("e"), F.size("r").alias("n"))
    return rows.groupBy(F.window("ts", window).alias("w")).agg(F.sum("e").alias("edits"), F.sum("n").alias("n_ref")).select(F.col("w.start").alias("start"), "edits", "n_ref")


def normalize_stream(lines: DataFrame, *, text_col: str = "value") -> DataFrame:
    """A stateless stage: normalised texts that have words."""
    return lines.withColumn("text", T.normalize(F.col(text_col))).where("text <> ''")
