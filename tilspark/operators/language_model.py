"""Interpolated modified Kneser-Ney models as tables: trained by aggregations, scored by joins.

``strict=False`` keeps the established behaviour, in which middle orders divide raw counts by the
number of distinct left contexts (so a probability may exceed 1); ``strict=True`` uses continuation
counts on both sides.
"""

from __future__ import annotations

import bisect
import json
import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch

# fixed values
BOS, EOS, UNK = "<s>", "</s>", "<unk>"
FLOOR = -30.0

#: joins the words of a context to one key
SEP = "\x01"


def padded(tokens: Column, order: int) -> Column:
    return F.concat(F.array_repeat(F.lit(BOS), order - 1), tokens, F.array(F.lit(EOS)))


def _join(a: Column) -> Column:
    return F.array_join(a, SEP)


def ngram_counts(sentences: DataFrame, order: int, *, tokens_col: str = "toks") -> DataFrame:
    """``n, ctx, word, c`` of all n-grams up to ``order``, padding included.  The tasks of a large table
    are as many as its size asks for: what one of them counts is bounded, before the shuffle and after."""
    n_tasks = scratch.pieces(sentences)
    if n_tasks > sentences.rdd.getNumPartitions():
        sentences = sentences.repartition(n_tasks)
    p = F.col("p")

    def windows(n: int) -> Column:
        context = lambda i: _join(F.slice(p, i, n - 1)) if n > 1 else F.lit("")
        starts = F.when(F.size(p) >= n, F.sequence(F.lit(1), F.size(p) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), context(i).alias("ctx"), F.element_at(p, i + n - 1).alias("word")))

    grams = [windows(n) for n in range(1, order + 1)]
    rows = sentences.select(padded(F.col(tokens_col), order).alias("p")).select(F.explode(F.concat(*grams)).alias("g")).select("g.*")
    return scratch.grouped(rows, n_tasks, "n", "ctx", "word").groupBy("n", "ctx", "word").agg(F.count("*").alias("c"))


def continuation_counts(counts: DataFrame) -> DataFrame:
    """``n, ctx, word, k``: in how many left contexts each n-gram below the top order occurs."""
    parts = F.split("ctx", SEP)
    rest = F.when(F.col("n") > 2, _join(F.slice(parts, 2, F.size(parts)))).otherwise(F.lit(""))
    shorter = counts.where("n > 1").select((F.col("n") - 1).alias("n"), rest.alias("ctx"), "word")
    return scratch.grouped(shorter, scratch.pieces(counts), "n", "ctx", "word").groupBy("n", "ctx", "word").agg(F.count("*").alias("k"))


def discounts(counts: DataFrame) -> DataFrame:
    """``n, d1, d2, d3`` from the counts of counts of each order."""
    cc = counts.groupBy("n").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    clamp = lambda x, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), x))
    out = cc.where("n1 > 0").withColumn("y", y)
    out = out.withColumn("d1", 1 - 2 * F.col("y") * F.col("n2") / F.col("n1"))
    out = out.withColumn("d2", F.when(F.col("n2") > 0, 2 - 3 * F.col("y") * F.try_divide(F.col("n3"), F.col("n2"))).otherwise(F.col("d1")))
    out = out.withColumn("d3", F.when(F.col("n3") > 0, 3 - 4 * F.col("y") * F.try_divide(F.col("n4"), F.col("n3"))).otherwise(F.col("d2")))
    out = out.select("n", clamp(F.col("d1"), 1).alias("d1"), clamp(F.col("d2"), 2).alias("d2"), clamp(F.col("d3"), 3).alias("d3"))
    return out.unionByName(cc.where("n1 = 0").select("n", *[F.lit(0.5).alias(d) for d in ("d1", "d2", "d3")]))


def context_stats(counts: DataFrame, cont: DataFrame, order: int, strict: bool = False) -> DataFrame:
    """``n, ctx, total, n1, n2, n3``: the denominator of each context and how many words follow it once, twice, more often."""
    # of strict models' middle orders, continuation counts are what is discounted
    grams = counts.where((F.col("n") > 1) & ((F.col("n") == order) | F.lit(not strict)))
    if strict:
        grams = grams.unionByName(cont.where((F.col("n") > 1) & (F.col("n") < order)).withColumnRenamed("k", "c"))
    follow = grams.groupBy("n", "ctx").agg(*[F.count_if(p).alias(x) for x, p in (("n1", F.col("c") == 1), ("n2", F.col("c") == 2), ("n3", F.col("c") >= 3))])
    # raw count of a context: that of the shorter n-gram it is
    whole = F.when(F.col("ctx") == "", F.col("word")).otherwise(F.concat_ws(SEP, "ctx", "word"))
    raw = counts.where(F.col("n") < order).select((F.col("n") + 1).alias("n"), whole.alias("ctx"), F.col("c").alias("raw"))
    types = cont.where((F.col("n") > 1) & (F.col("n") < order)).groupBy("n", "ctx").agg(F.sum("k").alias("types"))
    out = raw.join(follow, ["n", "ctx"], "left").join(types, ["n", "ctx"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = F.when((F.col("n") < order) & (zero("types") > 0), F.col("types")).otherwise(F.col("raw"))
    return out.select("n", "ctx", total.alias("total"), zero("n1").alias("n1"), zero("n2").alias("n2"), zero("n3").alias("n3"))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").partitionBy("n").parquet(path)
    return _read(df.sparkSession, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "n"))


def _read(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A table by order; the schema is given, as a small model has no rows of some kinds."""
    df = spark.read.schema(f"{columns}, n int").parquet(path)
    return df.select("n", *[c for c in df.columns if c != "n"])


@dataclass
class KneserNey:
    """The tables of a model."""

    order: int
    counts: DataFrame
    cont: DataFrame
    disc: DataFrame
    contexts: DataFrame
    strict: bool = False

    @classmethod
    def train(cls, sentences: DataFrame, order: int = 3, *, tokens_col: str = "toks", strict: bool = False, path: str | None = None) -> KneserNey:
        """Counts the n-grams and writes the model's tables once, to ``path`` or a folder for
        intermediate tables; all that follows reads them."""
        spark = sentences.sparkSession
        path = path or scratch.path(spark, "kneser-ney")
        counts = _written(ngram_counts(sentences, order, tokens_col=tokens_col), f"{path}/counts")
        cont = _written(continuation_counts(counts), f"{path}/cont")
        _written(context_stats(counts, cont, order, strict), f"{path}/contexts")
        discounts(counts).coalesce(1).write.mode("overwrite").parquet(f"{path}/discounts")
        spark.createDataFrame([(json.dumps({"order": order, "strict": strict}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return cls.load(spark, path)

    def vocab(self) -> DataFrame:
        """``token``: observed tokens, and the three specials."""
        specials = self.counts.sparkSession.createDataFrame([(BOS,), (EOS,), (UNK,)], "token string")
        return self.counts.where("n = 1").select(F.col("word").alias("token")).unionByName(specials).distinct()

    def save(self, path: str) -> None:
        """The model's tables, those of n-grams partitioned by order, and its settings."""
        for name in ("counts", "cont", "contexts"):
            _written(getattr(self, name), f"{path}/{name}")
        spark = self.counts.sparkSession
        self.disc.coalesce(1).write.mode("overwrite").parquet(f"{path}/discounts")
        spark.createDataFrame([(json.dumps({"order": self.order, "strict": self.strict}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KneserNey:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        tables = (_read(spark, f"{path}/{name}", columns) for name, columns in (("counts", "ctx string, word string, c bigint"), ("cont", "ctx string, word string, k bigint"), ("contexts", "ctx string, total bigint, n1 bigint, n2 bigint, n3 bigint")))
        counts, cont, contexts = tables
        return cls(meta["order"], counts, cont, spark.read.parquet(f"{path}/discounts"), contexts, meta["strict"])

    def _unigrams(self) -> DataFrame:
        """``token, k`` of the vocabulary: the number of left contexts, null where there is none."""
        uni = self.cont.where("n = 1").select(F.col("word").alias("token"), "k")
        return self.vocab().join(uni, "token", "left")

    def _totals(self) -> DataFrame:
        """One row: bigram types, vocabulary size, left contexts of the unknown word."""
        return self._unigrams().agg(F.coalesce(F.sum("k"), F.lit(0)).alias("types"), F.count("*").alias("v"), F.max(F.when(F.col("token") == UNK, F.col("k"))).alias("unk"))

    def score(self, queries: DataFrame) -> DataFrame:
        """``queries`` (``word``, ``ctx`` as array of words) with ``p`` and ``logp``.

        One pair of joins for each order: the n-gram's count and its context's statistics.
        """
        order = self.order
        context = F.slice("ctx", F.greatest(F.size("ctx") - (order - 2), F.lit(1)), F.lit(max(order - 1, 1))) if order > 1 else F.col("ctx")
        out = queries.withColumn("_c", context)
        uni = self._unigrams().select(F.col("token").alias("_uw"), F.col("k").alias("_uk"))
        out = out.join(uni, F.col("word") == F.col("_uw"), "left").crossJoin(F.broadcast(self._totals()))  # one row
        types = F.greatest(F.col("types"), F.lit(1)).cast("double")
        k = F.coalesce(F.when(F.col("_uw").isNull(), F.col("unk")).otherwise(F.col("_uk")), F.lit(0))
        out = out.withColumn("_p", F.when(k > 0, k / types).otherwise(1.0 / (types + F.col("v") + 1))).drop("_uw", "_uk", "types", "v", "unk")
        disc = {r["n"]: (r["d1"], r["d2"], r["d3"]) for r in self.disc.collect()}  # a row for each order
        for n in range(2, order + 1):
            d1, d2, d3 = disc.get(n, (0.5, 0.5, 0.5))
            key = _join(F.slice("_c", F.greatest(F.size("_c") - (n - 2), F.lit(1)), F.lit(n - 1)))
            table, count = (self.cont, "k") if self.strict and n < order else (self.counts, "c")
            grams = table.where(F.col("n") == n).select(F.col("ctx").alias("_gx"), F.col("word").alias("_gw"), F.col(count).alias("_g"))
            stats = self.contexts.where(F.col("n") == n).select(F.col("ctx").alias("_sx"), "total", "n1", "n2", "n3")
            out = out.withColumn("_k", F.when(F.size("_c") >= n - 1, key))
            out = out.join(grams, (F.col("_k") == F.col("_gx")) & (F.col("word") == F.col("_gw")), "left").join(stats, F.col("_k") == F.col("_sx"), "left")
            g = F.coalesce("_g", F.lit(0)).cast("double")
            d = F.when(g == 0, 0.0).when(g == 1, d1).when(g == 2, d2).otherwise(d3)
            higher = F.greatest(g - d, F.lit(0.0)) / F.col("total")
            gamma = (F.lit(d1) * F.col("n1") + F.lit(d2) * F.col("n2") + F.lit(d3) * F.col("n3")) / F.col("total")
            out = out.withColumn("_p", F.when(F.coalesce("total", F.lit(0)) > 0, higher + gamma * F.col("_p")).otherwise(F.col("_p")))
            out = out.drop("_k", "_gx", "_gw", "_g", "_sx", "total", "n1", "n2", "n3")
        return out.drop("_c").withColumnRenamed("_p", "p").withColumn("logp", F.when(F.col("p") > 0, F.log("p")).otherwise(F.lit(FLOOR)))

    def score_sentences(self, sentences: DataFrame, *, id_col: str = "sent_id", tokens_col: str = "toks") -> DataFrame:
        """``sent_id, n_tokens, logp`` (the end of the sentence is a token)."""
        order = self.order
        p = sentences.select(F.col(id_col).alias("sent_id"), padded(F.col(tokens_col), order).alias("p"))
        rows = p.select("sent_id", "p", F.explode(F.sequence(F.lit(order), F.size("p"))).alias("i"))
        ctx = F.slice("p", F.col("i") - (order - 1), F.lit(order - 1)) if order > 1 else F.array().cast("array<string>")
        rows = rows.select("sent_id", F.element_at("p", F.col("i")).alias("word"), ctx.alias("ctx"))
        return self.score(rows).groupBy("sent_id").agg(F.count("*").alias("n_tokens"), F.sum("logp").alias("logp"))

    def perplexity(self, sentences: DataFrame, **columns) -> DataFrame:
        """One row: ``perplexity`` (infinite for no sentences)."""
        s = self.score_sentences(sentences, **columns).agg(F.sum("logp").alias("lp"), F.sum("n_tokens").alias("n"))
        return s.select(F.when(F.coalesce("n", F.lit(0)) > 0, F.exp(-F.col("lp") / F.col("n"))).otherwise(F.lit(float("inf"))).alias("perplexity"))

    def local(self) -> "LocalKneserNey":
        """The tables in memory, for decoders: of the model's size, so of a checked one."""
        return LocalKneserNey.of(self)

    def filed(self) -> "FiledKneserNey":
        """The tables as sorted files that executors look up, for decoders: of any size."""
        return FiledKneserNey.of(self)


class LocalKneserNey:
    """Lookups of a collected model, by dictionaries."""

    MOST_ROWS = 5_000_000

    def __init__(self, order, counts, contexts, uni, disc, types, vocab):
        self.order, self.counts, self.contexts, self.uni, self.disc, self.types, self.vocab = order, counts, contexts, uni, disc, types, vocab

    @classmethod
    def of(cls, m: KneserNey) -> LocalKneserNey:
        grams = m.counts.limit(cls.MOST_ROWS + 1).collect()
        if len(grams) > cls.MOST_ROWS:
            raise ValueError(f"a decoder holds at most {cls.MOST_ROWS} n-grams: prune the model first")
        totals = m._totals().first()
        cont = m.cont.collect() if m.strict else m.cont.where("n = 1").collect()
        counts = {(r["n"], r["ctx"], r["word"]): r["c"] for r in grams}
        if m.strict:
            counts |= {(r["n"], r["ctx"], r["word"]): r["k"] for r in cont if r["n"] > 1}
        return cls(
            m.order, counts, {(r["n"], r["ctx"]): (r["total"], r["n1"], r["n2"], r["n3"]) for r in m.contexts.collect()},
            {r["word"]: r["k"] for r in cont if r["n"] == 1}, {r["n"]: (r["d1"], r["d2"], r["d3"]) for r in m.disc.collect()},
            max(totals["types"], 1), {r["token"] for r in m.vocab().collect()},
        )

    def prob(self, word: str, context) -> float:
        k = self.uni.get(word if word in self.vocab else UNK, 0)
        p = k / self.types if k else 1.0 / (self.types + len(self.vocab) + 1)
        context = list(context)
        for n in range(2, min(self.order, len(context) + 1) + 1):
            ctx = SEP.join(context[len(context) - n + 1 :])
            stats = self.contexts.get((n, ctx))
            if stats and stats[0]:
                total, *ns = stats
                d = self.disc[n]
                g = self.counts.get((n, ctx, word), 0)
                p = max(g - (d[min(g, 3) - 1] if g else 0.0), 0.0) / total + sum(a * b for a, b in zip(d, ns)) / total * p
        return p

    def logprob(self, word: str, context) -> float:
        p = self.prob(word, context)
        return math.log(p) if p > 0 else FLOOR


class SortedFiles:
    """Lookups in files of ``key<TAB>value`` lines that are sorted by the bytes of their keys.  Of each
    ``BLOCK`` bytes the first key is held, and of the blocks read those used last."""

    BLOCK, HELD, ANSWERS = 1 << 14, 512, 100_000
    _open: dict = {}  # by a worker's paths: the files and their keys are read once

    def __init__(self, paths):
        self.keys, self.at, self.blocks, self.answers = [], [], {}, {}
        for path in sorted(paths):
            f, size, i = open(path, "rb", buffering=0), os.path.getsize(path), 0
            while i < size:
                end = self._line_after(f, i + self.BLOCK, size)
                self.keys.append(self._read(f, i, self._line_after(f, i + 1, size)).split(b"\t", 1)[0])
                self.at.append((f, i, end))
                i = end

    @staticmethod
    def _read(f, start: int, end: int) -> bytes:
        out = b""
        while start + len(out) < end:
            part = os.pread(f.fileno(), end - start - len(out), start + len(out))
            if not part:
                break
            out += part
        return out

    def _line_after(self, f, i: int, size: int) -> int:
        """Where the first line begins that begins at ``i`` or later."""
        i -= 1
        while i < size:
            part = self._read(f, i, min(size, i + 512))
            k = part.find(b"\n")
            if k >= 0:
                return i + k + 1
            i += len(part)
        return size

    @classmethod
    def of(cls, names: tuple[str, ...]) -> SortedFiles:
        if names not in cls._open:
            from pyspark import SparkFiles

            cls._open.clear()
            cls._open[names] = cls([SparkFiles.get(n) for n in names])
        return cls._open[names]

    def get(self, key: str) -> str | None:
        if key in self.answers:
            return self.answers[key]
        raw = _escaped(key).encode()
        i = bisect.bisect_right(self.keys, raw) - 1
        value = None
        if i >= 0:
            block = self.blocks.pop(i, None)
            if block is None:
                block = b"\n" + self._read(*self.at[i])
                if len(self.blocks) >= self.HELD:
                    del self.blocks[next(iter(self.blocks))]
            self.blocks[i] = block
            k = block.find(b"\n" + raw + b"\t")
            if k >= 0:
                k += len(raw) + 2
                value = block[k : block.index(b"\n", k)].decode()
        if len(self.answers) >= self.ANSWERS:
            self.answers.clear()
        self.answers[key] = value
        return value


_ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"))


def _escaped(key):
    for a, b in _ESCAPES:
        key = key.replace(a, b) if isinstance(key, str) else F.replace(key, F.lit(a), F.lit(b))
    return key


@dataclass(frozen=True)
class FiledKneserNey:
    """Lookups of a model in files: neither the driver nor a worker holds it.  Spark takes the files to
    each executor once."""

    order: int
    names: tuple[str, ...]
    disc: dict
    types: int
    v: int

    @classmethod
    def of(cls, m: KneserNey) -> FiledKneserNey:
        spark = m.counts.sparkSession
        key = lambda kind, *x: F.concat_ws(SEP, F.lit(kind), *x)
        n = F.col("n").cast("string")
        counts = m.counts.where("n > 1")
        if m.strict:
            counts = counts.join(m.cont, ["n", "ctx", "word"], "left").withColumn("c", F.coalesce("k", "c"))
        rows = counts.select(key("g", n, "ctx", "word").alias("key"), F.col("c").cast("string").alias("value"))
        rows = rows.unionByName(m.contexts.select(key("x", n, "ctx").alias("key"), F.concat_ws(" ", "total", "n1", "n2", "n3").alias("value")))
        rows = rows.unionByName(m._unigrams().select(key("u", "token").alias("key"), F.coalesce("k", F.lit(0)).cast("string").alias("value")))
        path = scratch.path(spark, "sorted")
        rows = rows.withColumn("key", _escaped(F.col("key"))).repartitionByRange("key").sortWithinPartitions("key")
        rows.select(F.concat_ws("\t", "key", "value")).write.option("compression", "none").text(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = [f.getPath() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
        files = [f for f in files if f.getName().startswith("part-")]
        for f in files:
            spark.sparkContext.addFile(f.toString())
        totals = m._totals().first()
        disc = {r["n"]: (r["d1"], r["d2"], r["d3"]) for r in m.disc.collect()}  # a row for each order
        return cls(m.order, tuple(f.getName() for f in files), disc, max(totals["types"], 1), totals["v"])

    def prob(self, word: str, context) -> float:
        get = SortedFiles.of(self.names).get
        known = get(f"u{SEP}{word}")
        k = int(known if known is not None else get(f"u{SEP}{UNK}") or 0)
        p = k / self.types if k else 1.0 / (self.types + self.v + 1)
        context = list(context)
        for n in range(2, min(self.order, len(context) + 1) + 1):
            ctx = SEP.join(context[len(context) - n + 1 :])
            stats = [int(x) for x in (get(f"x{SEP}{n}{SEP}{ctx}") or "0").split(" ")]
            if stats[0]:
                total, *ns = stats
                d = self.disc[n]
                # a word that was never seen ends no n-gram
                g = int(get(f"g{SEP}{n}{SEP}{ctx}{SEP}{word}") or 0) if known is not None else 0
                p = max(g - (d[min(g, 3) - 1] if g else 0.0), 0.0) / total + sum(a * b for a, b in zip(d, ns)) / total * p
        return p

    def logprob(self, word: str, context) -> float:
        p = self.prob(word, context)
        return math.log(p) if p > 0 else FLOOR
