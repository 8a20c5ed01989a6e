"""Line dedup by range-partitioned line hashes, in DataFrame functions only.

Each line's key (ends stripped, A-Z in lower case) is hashed to 128 bits.  The rows (hash, document,
position) are dealt out by consecutive ranges of the hash, which need no sampling as hashes are even,
and sorted by hash, document and position; a window streams over each range and knows every line's
first document.  That is the only shuffle of all lines.  A key that a sample of the documents finds
to be frequent is dealt over all ranges by document; each range has a first document of its own, and
the smallest of them, a row for each frequent key and range, is broadcast back.  The lines that go
come back as keep bitmaps: for each document the 64-line words in which any line goes, all others
are left out.  The text itself is shuffled only where it is wanted.

Null or empty text is one empty line, which is kept.  A document is known by id and text together,
so repeated rows, or an id with two texts, each get their own answer; rows of one id never take
lines from each other.  Rows without an id keep all their lines.  Ties (one key twice in its
smallest document) all stay.  A very long text is split like any other and its rows dealt out by
hash.  An empty table gives an empty result.  Further columns pass through or are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import free_name, table

#: stripped at both ends of a line, and nothing else
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``_h1, _h2, _id, _text_hash, _pos`` of the lines whose key is long enough."""
    text = F.col(text_col).cast("string")
    return (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text_hash"), F.posexplode(_lines(text)).alias("_pos", "_line"))
        .select("_id", "_text_hash", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select(F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"), "_id", "_text_hash", "_pos")
    )


def frequent_keys(docs: DataFrame, *, id_col: str = "doc_id", sample_docs: int = 4000, least: int = 12, most: int = 4096, **columns) -> DataFrame:
    """``_h1, _h2, _hot`` of at most ``most`` keys that ``least`` lines or more hold in a sample of about
    ``sample_docs`` documents, drawn by hash.  They are only dealt out otherwise: no answer depends on
    which keys are among them."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = line_rows(some, id_col=id_col, **columns).groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return found.orderBy(F.desc("_n"), "_h1", "_h2").limit(most).select("_h1", "_h2", F.lit(True).alias("_hot"))


def repeated_lines(docs: DataFrame, **columns) -> DataFrame:
    """``_id, _text_hash, _pos`` of every line whose key a document of smaller id holds."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = line_rows(docs, **columns).join(F.broadcast(frequent_keys(docs, **columns)), ["_h1", "_h2"], "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    place = F.least(F.lit(n - 1), F.floor((F.col("_h1").cast("double") / F.lit(2.0**64) + 0.5) * n).cast("int"))
    spread = F.pmod(place + F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int"), F.lit(n))
    rows = rows.withColumn("_range", F.when(F.col("_hot"), spread).otherwise(place).cast("int")).repartitionById(n, "_range")
    rows = rows.sortWithinPartitions("_range", "_h1", "_h2", "_id", "_pos")
    sofar = Window.partitionBy("_range", "_h1", "_h2").orderBy("_id", "_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(rows.withColumn("_first", F.first("_id").over(sofar)).where("_hot OR _first < _id").drop("_range"), "lines")
    borders = rows.where("_hot").groupBy("_h1", "_h2").agg(F.min("_first").alias("_border"))  # of the frequent keys
    out = rows.join(F.broadcast(borders), ["_h1", "_h2"], "left").where(F.coalesce("_border", "_first") < F.col("_id"))
    return out.select("_id", "_text_hash", "_pos")


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``_id, _text_hash, keep``: a bitmap over the lines of each document that loses any, as pairs
    (word, bits).  Line ``p`` stays if bit ``p % 64`` of word ``p div 64`` is set, or if there is no such
    word."""
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    words = gone.groupBy("_id", "_text_hash", F.floor(F.col("_pos") / 64).cast("int").alias("word")).agg(
        F.bitwise_not(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_pos") % 64))).alias("bits")
    )
    return words.groupBy("_id", "_text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def with_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` and a column of keep bitmaps (null: the document loses no line);
    and that column's name."""
    key, digest, keep = (free_name(docs, f"_line_dedup_{x}") for x in ("id", "hash", "keep"))
    bitmaps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars).toDF(key, digest, keep)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    on = (F.col(id_col) == F.col(key)) & (F.xxhash64(text) == F.col(digest))
    return docs.join(bitmaps, on, "left").drop(key, digest), keep


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines that the bitmap leaves out."""
    every = F.lit(-1).cast("bigint")
    # lambdas' parameters are bound once for a text
    parts = F.array(F.struct(_lines(text).alias("lines"), F.map_from_entries(keep).alias("m")))
    parts = F.transform(parts, lambda x: F.struct(x["lines"].alias("lines"), F.transform(F.sequence(F.lit(0), F.floor((F.size(x["lines"]) - 1) / 64).cast("int")), lambda w: F.coalesce(F.try_element_at(x["m"], w), every)).alias("bits")))
    stays = lambda x, i: F.call_function("shiftright", F.element_at(x["bits"], (F.floor(i / 64) + 1).cast("int")), i % 64).bitwiseAND(F.lit(1).cast("bigint")) == 1
    kept = F.transform(parts, lambda x: F.array_join(F.filter(x["lines"], lambda line, i: stays(x, i)), "\n"))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.element_at(kept, 1))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """The documents, all columns unchanged but the text, which has lost its repeated lines."""
    out, keep = with_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    text = F.col(text_col).cast("string")
    changed = F.when(F.col(keep).isNull(), text).otherwise(kept_text(text, F.col(keep)))
    return out.withColumn(text_col, changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, keep = with_bitmaps(docs)
    text, bits = F.col("text"), F.col(keep)
    n_dropped = F.coalesce(F.aggregate(bits, F.lit(0), lambda a, x: a + 64 - F.bit_count(x["bits"])), F.lit(0))
    return out.select(
        "doc_id",
        F.size(_lines(text)).cast("bigint").alias("n_lines"),
        n_dropped.cast("bigint").alias("n_dropped"),
        F.sha2(kept_text(text, bits).cast("binary"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH l AS (SELECT doc_id, i, s[i] line, translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
           FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) s FROM documents))),
f AS (SELECT k, min(doc_id) a, max(doc_id) b FROM l WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE doc_id > a)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE a IS NULL OR doc_id = a), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY doc_id"""
