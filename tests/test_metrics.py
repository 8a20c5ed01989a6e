import random

import pytest
from pyspark.sql import functions as F

from tilspark.functions import text as T
from tilspark.operators import alignment as L
from tilspark.operators import morph_wer as MW
from tilspark.streaming import scoring

# fixed values: the first two pairs are published with their rates
DEMO = [("мен мектепке барамын", "мен мектепте барамын"), ("ол үйге келді", "ол үйге кетті"), ("a b c", "a b c")]


def pairs(spark, rows):
    return spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(rows)], "utt_id long, ref string, hyp string")


def ops(spark, rows):
    df = pairs(spark, rows).select("utt_id", L.align(T.words(F.col("ref")), T.words(F.col("hyp"))).alias("o"))
    return [[o["op"] for o in r["o"]] for r in df.orderBy("utt_id").collect()]


def test_align(spark):
    assert ops(spark, [("a b c", "a x c"), ("", "a"), ("a", ""), ("", ""), ("a b", "b")]) == [["match", "sub", "match"], ["ins"], ["del"], [], ["del", "match"]]


def reference_ops(r, h):
    n, m = len(r), len(h)
    d = [[i + j if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (r[i - 1] != h[j - 1]))
    return d[n][m]


def test_distances_agree_with_brute_force(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices("abcd", k=rng.randint(0, 9))), " ".join(rng.choices("abcd", k=rng.randint(0, 9)))) for _ in range(120)]
    df = pairs(spark, rows).select("utt_id", L.edit_distance(T.words(F.col("ref")), T.words(F.col("hyp"))).alias("d"))
    got = {r["utt_id"]: r["d"] for r in df.collect()}
    scripts = ops(spark, rows)
    for i, (r, h) in enumerate(rows):
        want = reference_ops(r.split(), h.split())
        assert got[i] == want == sum(o != "match" for o in scripts[i])


def test_rates(spark):
    p = pairs(spark, DEMO[:1])
    assert L.word_error_rate(p).first()["wer"] == pytest.approx(1 / 3)
    assert L.character_error_rate(p).first()["edits"] == 1
    empty = pairs(spark, [("", "a")])
    assert L.word_error_rate(empty).first()["wer"] == 0.0


def test_morph_wer(spark):
    r = MW.morph_wer(pairs(spark, DEMO)).first()
    assert (r["exact"], r["suffix_only"], r["root_errors"], r["insertions"], r["deletions"], r["n_ref_words"]) == (7, 1, 1, 0, 0, 9)
    assert round(r["wer_equivalent"], 4) == 0.2222 and round(r["m_wer"], 4) == 0.1889
    assert MW.summary(MW.morph_wer(pairs(spark, DEMO))) == "M-WER=0.1889  (WER=0.2222)  exact=7 suffix-only=1 root-err=1 ins=0 del=0"
    full = MW.morph_wer(pairs(spark, DEMO[:1]), MW.MorphWER(w_suffix=1.0)).first()
    assert full["m_wer"] == pytest.approx(1 / 3)


def test_examples(spark):
    assert [r["example"] for r in MW.examples(pairs(spark, DEMO)).collect()] == ["'мектепке' -> 'мектепте'  (root ok, suffix Δ, cost=0.35)"]


def test_streamed_windows_equal_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", "a b", "a c"), ("2024-01-01 00:06:00", "a", "a")], "ts string, ref string, hyp string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = scoring.windowed_wer(stream).writeStream.format("memory").queryName("wer_windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("wer_windows").collect())) == sorted(map(tuple, scoring.windowed_wer(rows).collect()))


def test_distance_of_very_many_distinct_tokens(spark):
    # more than fit below the surrogates
    a = F.transform(F.sequence(F.lit(1), F.lit(42_500)), lambda i: F.concat(F.lit("w"), i.cast("string")))
    df = spark.range(1).select(a.alias("a"))
    r = df.select(L.edit_distance(F.col("a"), F.slice("a", 42_400, 7)).alias("x"), L.edit_distance(F.lit(None).cast("array<string>"), F.col("a")).alias("y")).first()
    assert (r["x"], r["y"]) == (42_493, None)


def test_alignment_in_blocks_is_the_same(monkeypatch):
    rng = random.Random(3)
    for n in (0, 1, 5, 40, 90):
        r, h = rng.choices("abcd", k=n), rng.choices("abcde", k=rng.randint(0, 80))
        whole = L._script(r, h)
        with monkeypatch.context() as m:
            m.setattr(L, "_CELLS", 1)
            assert L._script(r, h) == whole


def test_alignment_of_a_long_pair():
    words = [f"w{k % 977}" for k in range(20_000)]
    changed = [w if k % 100 else "x" for k, w in enumerate(words)][:-3]
    ops = L._script(words, changed)
    assert sum(o != "match" for o, *_ in ops) == 200 + 3 and len(ops) == 20_000


def test_scripts_go_back_some_rows_at_a_time():
    """A batch of many pairs never becomes one batch of scripts, nor Python objects for each operation."""
    import pyarrow as pa

    rng = random.Random(5)
    say = lambda: None if rng.random() < 0.05 else rng.choices("abcdef", k=rng.randint(0, 60))
    r, h = ([say() for _ in range(3000)] for _ in range(2))
    kind = pa.list_(pa.string())
    batches = list(L._scripts(pa.array(r, kind), pa.array(h, kind)))
    assert max(map(len, batches)) <= 512 and sum(map(len, batches)) == 3000
    got = [[(o["op"], o["ref"], o["hyp"]) for o in row] for b in batches for row in b.to_pylist()]
    assert got == [L._script(x or [], y or []) for x, y in zip(r, h)]
    assert batches[0][1].as_py() == [{"pos": k, "op": o, "ref": x, "hyp": y} for k, (o, x, y) in enumerate(L._script(r[1] or [], h[1] or []))]
