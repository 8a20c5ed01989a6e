import random
import re

from pyspark.sql import functions as F

from tilspark.functions import phonology as P
from tilspark.functions import sql
from tilspark.functions import text as T
from tilspark.operators import vocab
from tilspark.sources import config, files


def one(spark, make, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    return [r[0] for r in df.coalesce(1).select(make(F.col("x")).alias("y")).collect()]


def test_normalize(spark):
    got = one(spark, T.normalize, "Сәлеметсіз бе, әлем!", "12", "  көп   бос  орын ", "5а", None, "Сәлеметсіз бе, әлем! 12 saǵat, т.б.", "й ё")
    assert got == ["сәлеметсіз бе әлем", "бір екі", "көп бос орын", "беса", "", "сәлеметсіз бе әлем бір екі ат тағы басқа", "й ё"]


def test_normalize_options(spark):
    assert one(spark, lambda x: T.normalize(x, keep_unknown=True, expand_numbers=False), "Kod-9!") == ["kod-9!"]
    assert one(spark, lambda x: T.normalize(x, exact_nfc=True), "Й") == ["й"]


def test_homoglyphs_need_whole_runs(spark):
    assert one(spark, T.repair_homoglyphs, "kota kotd xy") == ["кота kotd ху"]


def test_tokens(spark):
    assert one(spark, T.words, " a  b\tc ", "", None) == [["a", "b", "c"], [], []]
    assert one(spark, T.characters, "аб в", "") == [["а", "б", "в"], []]


def test_vocab(spark):
    df = spark.createDataFrame([("сәлем әлем",)], "text string")
    assert vocab.vocab_map(vocab.build_vocab(df)) == {"е": 0, "л": 1, "м": 2, "с": 3, "ә": 4, "|": 5, "[UNK]": 6, "[PAD]": 7}


def test_labels(spark):
    v = {"а": 0, "б": 1, "|": 2, "[UNK]": 3, "[PAD]": 4}
    df = spark.createDataFrame([(1, "аб а"), (1, "ж"), (2, "а")], "b int, t string").select("b", vocab.encode_labels(F.col("t"), v).alias("labels"))
    got = {tuple(r["padded"]) for r in vocab.pad_labels(df, "b").collect()}
    assert got == {(0, 1, 2, 0), (3, -100, -100, -100), (0,)}
    back = vocab.pad_labels(df, "b").select(vocab.decode_labels(F.col("padded"), v).alias("t")).collect()
    assert {r["t"] for r in back} == {"аб а", "[UNK]", "а"}


def test_phonology(spark):
    assert one(spark, P.harmony_class, "мектеп", "бала", "үй", "қазақ", "", "ту") == ["front", "back", "front", "back", "back", "back"]
    assert one(spark, P.final_class, "бала", "мектеп", "үй", "қазақ", "") == ["vowel", "voiceless", "sonorant", "voiced", "vowel"]
    assert one(spark, P.is_rounded, "үй", "бала", "") == [True, False, False]


def test_sql_names(spark):
    sql.register(spark)
    r = spark.sql("SELECT kaz_normalize('Сәлем, 12!') a, kaz_harmony('үй') b, kaz_final_class('үй') c, kaz_words(' x  y ') d, kaz_gloss('мектептер') e").first()
    assert [tuple(x["a"]) for x in spark.sql("SELECT kaz_analyze(w) a FROM VALUES ('балаларына'), ('үй') AS t(w)").collect()] == [("бала", ["PL", "POSS", "CASE"]), ("үй", [])]
    assert tuple(r) == ("сәлем бір екі", "front", "sonorant", ["x", "y"], "мектеп+PL")


def test_files(spark, tmp_path):
    (tmp_path / "r.txt").write_text("Мен келдім\r\n\nол кетті\n", encoding="utf-8")
    (tmp_path / "h.txt").write_text("мен келді\n\nол кетті", encoding="utf-8")
    ref, hyp = files.read_lines(spark, str(tmp_path / "r.txt")), files.read_lines(spark, str(tmp_path / "h.txt"))
    got = sorted(map(tuple, files.pair_lines(ref, hyp).collect()))
    assert got == [(0, "мен келдім", "мен келді"), (1, "", ""), (2, "ол кетті", "ол кетті")]
    assert files.read_corpus(spark, str(tmp_path / "r.txt")).count() == 2
    v = {"а": 0, "[PAD]": 1}
    files.save_vocab(v, str(tmp_path / "v.json"))
    assert files.load_vocab(str(tmp_path / "v.json")) == v


def test_unequal_files_are_an_error(spark):
    import pytest

    a = spark.createDataFrame([(0, "x"), (1, "y")], "utt_id long, text string")
    with pytest.raises(ValueError):
        files.pair_lines(a, a.limit(1))
    assert files.pair_lines(a, a.limit(1), strict=False).count() == 1


def test_dataset(spark, tmp_path):
    t = files.sample_data(spark, 200).select(F.col("utt_id").alias("file_name"), F.col("text").alias("transcript"))
    files.prepare_dataset(t, str(tmp_path / "d"))
    n = files.read_dataset(spark, str(tmp_path / "d"), "test").count()
    assert 5 <= n <= 40 and n + files.read_dataset(spark, str(tmp_path / "d"), "train").count() == 200


def test_audio(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(b"\x00\x40" * 4)
    r = files.read_audio(spark, str(tmp_path)).first()
    assert r["sampling_rate"] == 16000 and r["audio"] == [0.5] * 4


def test_config(tmp_path):
    import json

    import pytest

    (tmp_path / "c.json").write_text(json.dumps({"batch-size": 4}))
    c = config.load(str(tmp_path / "c.json"))
    assert c.batch_size == 4 and config.with_overrides(c, {"epochs": 2, "seed": None, "other": 1}).epochs == 2
    with pytest.raises(SystemExit):
        config.from_dict({"nope": 1})


def test_normalize_reads_its_input_once(spark):
    """Texts are taken apart once, whatever they hold."""
    plan = spark.range(1).select(F.col("id").cast("string").alias("x")).select(T.normalize(F.upper("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1


def test_normalize_odd_texts(spark):
    rng = random.Random(3)
    pool = [*T.ALPHABET, *"aeocpxykmthbdfgz0123456789 \t\n.,'ґђѐӨӘЁЙҒј", "й", "\xa0", "é", "ß", "\U0001f600", "т.б.", "т.с.с.", "ғ.", "жыл.", "aeo", "12"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(2000)] + ["a" * 20000, "a" * 20000 + "z", "7" * 5000]

    def plain(x):
        for parts, letter in T.COMPOSED:
            x = x.replace(parts, letter)
        x = x.lower()
        for short, full in T.ABBREVIATIONS:
            x = x.replace(short, f" {full} ")
        look = str.maketrans(T.HOMOGLYPHS_FROM, T.HOMOGLYPHS_TO)
        x = re.sub("[a-z]+", lambda m: m[0].translate(look) if set(m[0]) <= set(T.HOMOGLYPHS_FROM) else m[0], x)
        x = re.sub("[0-9]+", lambda m: " ".join(T.DIGITS[int(c)] for c in m[0]), x)
        return re.sub(f"[^{T.ALPHABET}]+", " ", x).strip(" ")

    want = [plain(x) for x in texts]
    assert one(spark, T.normalize, *texts) == want
    assert one(spark, T.normalized_words, *texts) == [x.split() for x in want]
