"""Character vocabularies and the label operators that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# fixed values
WORD_DELIMITER, UNKNOWN, PADDING = "|", "[UNK]", "[PAD]"
IGNORED_LABEL = -100


def char_counts(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``token, c``: how often each character of the normalised texts occurs, blanks left out."""
    return df.select(F.explode(F.array_remove(F.split(F.replace(T.normalize(F.col(text_col)), F.lit(" ")), ""), "")).alias("token")).groupBy("token").agg(F.count("*").alias("c"))


def build_vocab(df: DataFrame, *, text_col: str = "text", min_count: int = 1) -> DataFrame:
    """``token, id``: characters in code-point order from 0, then the three special tokens."""
    kept = char_counts(df, text_col=text_col).where(F.col("c") >= min_count).select("token")
    # an alphabet: the window sees as many rows as there are distinct characters
    specials = df.sparkSession.createDataFrame([(1, 0, WORD_DELIMITER), (1, 1, UNKNOWN), (1, 2, PADDING)], "g int, o int, token string")
    every = kept.select(F.lit(0).alias("g"), F.lit(0).alias("o"), "token").unionByName(specials)
    return every.select("token", (F.row_number().over(Window.orderBy("g", "o", "token")) - 1).alias("id"))


def vocab_map(vocab: DataFrame) -> dict[str, int]:
    return {r["token"]: r["id"] for r in vocab.collect()}


def _literal(vocab: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in vocab.items() for x in kv])


def encode_labels(text: Column, vocab: dict[str, int]) -> Column:
    """Ids of a transcript's characters: blanks are the delimiter, characters outside are unknown."""
    chars = F.filter(F.split(F.replace(text, F.lit(" "), F.lit(WORD_DELIMITER)), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(_literal(vocab), c), F.lit(vocab[UNKNOWN])))


def decode_labels(ids: Column, vocab: dict[str, int], *, group: bool = False) -> Column:
    """Text of label ids; ignored ones count as padding and vanish.  ``group`` merges repeats first."""
    by_id = F.create_map(*[F.lit(x) for k, v in vocab.items() for x in (v, k)])
    ids = F.transform(ids, lambda i: F.when(i == IGNORED_LABEL, vocab[PADDING]).otherwise(i))
    if group:  # a lambda's parameter is bound once; the expression would be computed for every id
        ids = F.element_at(F.transform(F.array(ids), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))), 1)
    shown = F.filter(ids, lambda i: i != vocab[PADDING])
    return T.spoken(F.array_join(F.transform(shown, lambda i: F.coalesce(F.try_element_at(by_id, i), F.lit(""))), ""), WORD_DELIMITER)


def pad_labels(df: DataFrame, batch_col: str, labels_col: str = "labels", out: str = "padded") -> DataFrame:
    """Labels of each batch padded to its longest with the value that the loss ignores."""
    most = F.max(F.size(labels_col)).over(Window.partitionBy(batch_col))
    fill = F.array_repeat(F.lit(IGNORED_LABEL), (most - F.size(labels_col)).cast("int"))
    return df.withColumn(out, F.concat(F.col(labels_col), fill))


def prepare_examples(df: DataFrame, vocab: dict[str, int], *, audio_col: str = "audio", text_col: str = "text") -> DataFrame:
    """``input_values, labels`` and nothing else: samples of zero mean and unit variance, and label ids."""
    x = F.transform(F.col(audio_col), lambda v: v.cast("double"))
    n = F.greatest(F.size("x"), F.lit(1))
    total = lambda f: F.aggregate(F.col("x"), F.lit(0.0), lambda a, v: a + f(v))
    rows = df.select(x.alias("x"), encode_labels(F.col(text_col), vocab).alias("labels"))
    rows = rows.withColumn("mean", total(lambda v: v) / n)
    rows = rows.withColumn("scale", F.sqrt(total(lambda v: (v - F.col("mean")) * (v - F.col("mean"))) / n + F.lit(1e-7)))
    return rows.select(F.transform("x", lambda v: ((v - F.col("mean")) / F.col("scale")).cast("float")).alias("input_values"), "labels")


def batch_wer(predictions: DataFrame, vocab: dict[str, int], *, ids_col: str = "ids", labels_col: str = "labels") -> DataFrame:
    """``edits, n_ref, wer`` of predicted frame ids against padded labels: ignored labels count as
    padding, predictions lose repeats and padding, labels padding only."""
    from .alignment import word_error_rate

    texts = predictions.select(decode_labels(F.col(labels_col), vocab).alias("ref"), decode_labels(F.col(ids_col), vocab, group=True).alias("hyp"))
    return word_error_rate(texts)


def special_tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(WORD_DELIMITER,), (UNKNOWN,), (PADDING,)], "token string")
