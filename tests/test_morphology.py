import pytest
from pyspark.sql import functions as F

from tilspark.functions import suffixes as S
from tilspark.operators import morphology as M

GOLD = [
    ("мектептер", "мектеп", "PL", 0.65), ("балаларына", "бала", "PL,POSS,CASE", 1.95), ("үй", "үй", "", 0.07), ("келмедім", "кел", "NEG,TAM,PERS", 1.95), ("мектеп", "мектеп", "", 0.15),
    ("мектептерім", "мектеп", "PL,POSS", 1.30), ("мектептерімде", "мектеп", "PL,POSS,CASE", 1.95), ("үйлерде", "үй", "PL,CASE", 1.22), ("досым", "дос", "POSS", 0.65),
    ("барамын", "бар", "TAM,PERS", 1.30), ("оқыдым", "оқы", "TAM,PERS", 1.30), ("келді", "келд", "POSS", 0.65), ("кетті", "кет", "CASE", 0.65), ("қазақ", "қаз", "TAM,PERS", 1.30),
    ("мен", "мен", "", 0.15), ("ол", "ол", "", 0.07), ("кітаптарын", "кітаптарын", "", 0.15), ("үйге", "үйг", "TAM", 0.65),
]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w, *_ in GOLD], "word string")


def test_table():
    assert len(S.SUFFIXES) == 80
    for slot in {s.slot for s in S.SUFFIXES}:
        found = [s.surface for s in S.SUFFIXES if s.slot == slot]
        assert len(found) == len(set(found))


def test_best(words):
    rows = M.analyze_words(words).select("word", "analysis.root", F.array_join(M.tags(F.col("analysis")), ",").alias("t"), F.round("analysis.score", 4).alias("s")).collect()
    assert {tuple(r) for r in rows} == set(GOLD)


def test_local_tokens_agree():
    for w, root, tags, _ in GOLD:
        assert M.local_tokens(w) == [root, *filter(None, tags.split(","))]


def test_parts_make_the_word(words):
    a = F.col("analysis")
    rows = M.analyze_words(words).select("word", F.concat(a["root"], F.array_join(M.suffix_chain(a), "")).alias("back"), M.gloss(a).alias("g")).collect()
    assert all(r["word"] == r["back"] for r in rows)
    assert {r["word"]: r["g"] for r in rows}["мектептер"] == "мектеп+PL"


def test_top_k_and_beam(words):
    top = {r["word"]: r["a"] for r in words.select("word", M.analyses(F.col("word"), top_k=4).alias("a")).collect()}
    for w, root, tags, score in GOLD:
        scores = [x["score"] for x in top[w]]
        assert scores == sorted(scores, reverse=True) and top[w][0]["root"] == root
        keys = [(x["root"], tuple(m["tag"] for m in x["morphemes"])) for x in top[w]]
        assert len(keys) == len(set(keys))
    narrow = words.select("word", M.best(F.col("word"), M.Segmenter(beam_size=2))["root"].alias("r")).collect()
    assert {r["word"]: r["r"] for r in narrow}["балаларына"] == "бала"


def test_no_shuffle_but_the_distinct(words):
    plan = M.analyze_words(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Python" not in plan


def test_suffix_matches(spark):
    w = spark.createDataFrame([("мектептер",), ("ым",)], "word string")
    got = {(r["word"], r["slot"], r["surface"], r["licensed"]) for r in M.suffix_matches(w, S.suffix_table(spark)).collect()}
    assert ("мектептер", "PLURAL", "тер", True) in got and ("ым", "POSSESSIVE", "м", True) in got and ("ым", "POSSESSIVE", "ым", True) not in got


def test_root_and_suffixes(spark):
    from pyspark.sql import functions as F

    from tilspark.operators import morphology as M

    rows = spark.createDataFrame([("балаларына",), ("үй",)], "word string").select(M.root_suffix(F.col("word")).alias("a")).collect()
    assert rows[0]["a"]["root"] == "бала" and "".join(rows[0]["a"]["suffixes"]) == "ларына" and (rows[1]["a"]["root"], rows[1]["a"]["suffixes"]) == ("үй", [])
