"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is its target share of the mixture over its share of the corpus.  A
document's number of copies is a Poisson variate of that mean: the cumulative distribution of its
source, inverted at a uniform number hashed from seed and id, so a rerun, another partitioning or a
recomputed task gives the same copies.  The copies are dealt out in the order of a second hash: a
global shuffle in which neither a large source nor a much repeated document meets in one task.

Null source is a source of its own; null text weighs 0; repeated rows get the same number of copies
each; null ids hash as such; very long texts only count by their length; an empty table gives an empty result.  A source of weight 0 or size 0
has no copies.  Columns whose names begin with ``_mix`` are the operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: means above are split into equal parts, whose variates are added up
PART = 16.0
#: terms of the cumulative distribution: beyond, the tail of a mean of 16 is under 2**-53
TERMS = 72
#: source tables of more rows are joined by a salted shuffle, not by broadcast
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the hash of the joined parts."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(2.0**52)


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, *, source_col: str = "source", text_col: str = "text", power: float = 0.5, total: float = 1.0) -> DataFrame:
    """``_mix_source, _mix_parts, _mix_cdf`` of each source.

    Sizes are code points of text, over all documents.  Without targets, a source's weight is its
    size to ``power`` (1: as it is; 0: all sources alike).  ``total`` is the size of the mixture in
    corpora.
    """
    size = F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0))
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("_mix_source")).agg(F.sum(size).alias("_mix_size"))
    if targets is None:
        weight = F.pow(F.col("_mix_size").cast("double"), F.lit(float(power)))
    else:
        weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))]), F.col("_mix_source")), F.lit(0.0)) if targets else F.lit(0.0)
    sizes = sizes.withColumn("_mix_weight", F.when(F.col("_mix_size") > 0, weight).otherwise(F.lit(0.0)))
    sums = sizes.agg(F.sum("_mix_size").alias("_mix_all"), F.sum("_mix_weight").alias("_mix_weights"))
    rates = sizes.crossJoin(F.broadcast(sums))  # one row
    rate = F.col("_mix_weight") / F.col("_mix_weights") * F.lit(float(total)) * F.col("_mix_all").cast("double") / F.col("_mix_size").cast("double")
    rates = rates.withColumn("_mix_rate", F.when(F.col("_mix_weight") > 0, rate).otherwise(F.lit(0.0)))
    rates = rates.withColumn("_mix_parts", F.greatest(F.lit(1), F.ceil(F.col("_mix_rate") / PART)).cast("int"))
    mean = F.col("_mix_rate") / F.col("_mix_parts")
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda a, k: F.struct(
        (a["term"] * mean / k).alias("term"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["term"] * mean / k)).alias("cdf")
    )
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["cdf"])
    return rates.select("_mix_source", "_mix_rate", "_mix_parts", cdf.alias("_mix_cdf"))


def copies(docs: DataFrame, targets: dict[str, float] | None = None, *, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", power: float = 0.5, total: float = 1.0) -> DataFrame:
    """``docs`` with ``_mix_copies``; no row is dropped yet."""
    rates = source_rates(docs, targets, source_col=source_col, text_col=text_col, power=power, total=total)
    key = F.col(source_col).cast("string")
    few = rates.limit(BROADCAST_SOURCES + 1).collect()
    if len(few) <= BROADCAST_SOURCES:
        small = docs.sparkSession.createDataFrame(few, rates.schema)
        out = docs.join(F.broadcast(small), key.eqNullSafe(F.col("_mix_source")), "left")
    else:
        salted = rates.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = docs.withColumn("_mix_key", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        out = left.join(salted, key.eqNullSafe(F.col("_mix_source")) & (F.col("_mix_key") == F.col("_mix_salt")), "left").drop("_mix_key", "_mix_salt")
    drawn = lambda i: F.size(F.filter(F.col("_mix_cdf"), lambda c: uniform(F.lit(seed), F.col(id_col), i) >= c))
    one = F.size(F.filter("_mix_cdf", lambda c: F.col("_mix_u") >= c))
    more = F.aggregate(F.sequence(F.lit(2), F.col("_mix_parts")), F.lit(0), lambda a, i: a + drawn(i))
    n = F.when(F.col("_mix_rate") <= 0, 0).when(F.col("_mix_parts") > 1, one + more).otherwise(one)
    return out.withColumn("_mix_u", uniform(F.lit(seed), F.col(id_col), F.lit(1))).withColumn("_mix_copies", n).drop("_mix_source", "_mix_cdf", "_mix_parts", "_mix_u")


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, *, seed: int = 17, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixture: each document as often as drawn, with ``_mix_copy`` (from 1) and ``_mix_key``, the
    place in the global order; the partitions hold consecutive ranges of keys, each sorted."""
    out = copies(docs, targets, seed=seed, id_col=id_col, **options).where("_mix_copies > 0")
    out = out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    place = F.md5(F.concat_ws(":", F.lit(seed + 1), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("_mix_copy").cast("string")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the hash is uniform: consecutive ranges of it are even without a sampling pass
    begin = F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    out = out.withColumn("_mix_key", place).withColumn("_mix_range", F.floor(begin * n).cast("int"))
    return out.repartitionById(n, "_mix_range").sortWithinPartitions("_mix_key").drop("_mix_range")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix_sources(docs)
    return out.select("doc_id", "source", F.char_length("text").cast("bigint").alias("n_chars"), F.col("_mix_copies").cast("bigint").alias("n_copies"), F.col("_mix_copy").cast("bigint").alias("copy_no"), F.col("_mix_key").alias("order_key"))


def sql_copies(docs: str, seed: int = 17, power: float = 0.5) -> str:
    """DuckDB SQL for the copies of each row of ``docs`` (means up to ``PART``)."""
    u = f"(('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"
    return f"""
sz AS (SELECT source s, coalesce(sum(length(text)), 0)::DOUBLE z FROM {docs} GROUP BY source),
wt AS (SELECT s, z, CASE WHEN z > 0 THEN pow(z, {power}::DOUBLE) ELSE 0 END w FROM sz),
rt AS (SELECT s, CASE WHEN w > 0 THEN w / (SELECT sum(w) FROM wt) * (SELECT sum(z) FROM wt) / z ELSE 0 END r FROM wt),
tm AS (SELECT s, r, k, CASE WHEN k = 0 THEN exp(-r) ELSE exp(-r + k * ln(r) - lgamma(k + 1)) END p FROM rt, (SELECT unnest(range(0, {TERMS + 1})) k) WHERE r > 0),
cd AS (SELECT s, list(c ORDER BY k) c FROM (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) c FROM tm) GROUP BY s),
mix AS (SELECT d.*, coalesce(len(list_filter(c, lambda x: {u} >= x)), 0) AS n_copies FROM {docs} d LEFT JOIN cd ON d.source IS NOT DISTINCT FROM cd.s)"""


SQL = f"""WITH {sql_copies('documents')},
ex AS (SELECT doc_id, source, length(text)::BIGINT n_chars, n_copies, unnest(range(1, n_copies + 1)) copy_no FROM mix)
SELECT doc_id, source, n_chars, n_copies::BIGINT AS n_copies, copy_no::BIGINT AS copy_no, md5('18:' || doc_id::VARCHAR || ':' || copy_no::VARCHAR) AS order_key FROM ex"""
