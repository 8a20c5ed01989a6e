import math
import random

import pytest
from pyspark.sql import functions as F

from tilspark.operators import morph_wer as MW
from tilspark.operators import vocab
from tilspark.plans import jobs
from tilspark.sources import files


def test_demo(spark):
    out = jobs.demo(spark)
    lines = dict(x.split(":") for x in out.replace(" ", "").split("\n") if x.count(":") == 1)
    assert lines["WER"] == "0.3333" and lines["M-WER"] == "0.1167" and (lines["exact"], lines["suffixonly"], lines["rooterrors"], lines["utterances"]) == ("6", "3", "0", "3")
    assert "'қалаға' -> 'қалада'" in out and "балалар         бала+PL" in out


def test_lm_and_decoding(spark, tmp_path):
    (tmp_path / "c.txt").write_text("мен мектепке барамын\n\nол үйге келді\nмен үйге барамын\n", encoding="utf-8")
    for word_level in (False, True):
        p = jobs.build_lm(spark, str(tmp_path / "c.txt"), str(tmp_path / f"lm{word_level}"), 2, word_level)
        assert 1 < p < 50
    chars = {c: i for i, c in enumerate("меноүйл")} | {vocab.WORD_DELIMITER: 7, vocab.UNKNOWN: 8, vocab.PADDING: 9}
    ids = [chars[c] for c in "мен|ол"]
    rows = [(1, t, [math.log(0.9 if k == i else 0.1 / 9) for k in range(10)]) for t, i in enumerate(ids)]
    frames = spark.createDataFrame(rows, "utt_id long, t int, lp array<double>")
    for strategy, lm, words in (("greedy", None, False), ("beam+lm", "lmFalse", False), ("beam+lm", "lmTrue", True)):
        out = jobs.decode(spark, frames, chars, strategy, lm and str(tmp_path / lm), words)
        assert out.first()["text"] == "мен ол"
    (tmp_path / "e.txt").write_text("\n")
    with pytest.raises(SystemExit):
        jobs.build_lm(spark, str(tmp_path / "e.txt"), str(tmp_path / "none"))


def test_score_files(spark, tmp_path):
    (tmp_path / "r").write_text("мен мектепке барамын\n", encoding="utf-8")
    (tmp_path / "h").write_text("Мен мектепте барамын!\n", encoding="utf-8")
    assert "0.3333" in jobs.score_files(spark, str(tmp_path / "r"), str(tmp_path / "h"))
    free = jobs.score_files(spark, str(tmp_path / "r"), str(tmp_path / "h"), MW.MorphWER(w_suffix=0.0))
    assert "M-WER               : 0.0000" in free and "utterances          : 1" in free
    files.write_transcripts(spark.createDataFrame([("a.wav", "мен")], "name string, text string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "a.wav\tмен"


def _wav(path, values, rate=16_000, width=2, channels=1):
    import wave

    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(b"".join(int(v * (1 << (8 * width - 1))).to_bytes(width, "little", signed=True) for v in values for _ in range(channels)))


def test_wavs_to_text_and_datasets(spark, tmp_path):
    wavs = tmp_path / "wavs"
    wavs.mkdir()
    tokens = {c: i for i, c in enumerate("мено")} | {vocab.WORD_DELIMITER: 4, vocab.UNKNOWN: 5, vocab.PADDING: 6}
    spell = lambda text: [tokens[c] / 16 for c in text.replace(" ", "|")]
    _wav(wavs / "a.wav", spell("мен"))
    _wav(wavs / "b.wav", [v for v in spell("ноон") for _ in (0, 1)], rate=32_000, width=3, channels=2)
    (wavs / "a.txt").write_text("Мен!", encoding="utf-8")
    (wavs / "b.txt").write_text("Но он", encoding="utf-8")

    def log_probs(samples, rate):
        assert rate == 16_000
        return [[math.log(0.94 if k == round(float(x) * 16) else 0.01) for k in range(7)] for x in samples]

    out = {r["name"]: r["text"] for r in jobs.transcribe_wavs(spark, str(wavs), log_probs, tokens, "greedy").collect()}
    assert out["a.wav"] == "мен" and set(out) == {"a.wav", "b.wav"}
    data = files.package_dataset(spark, str(wavs), str(tmp_path / "data"), test_size=1.0)
    assert sorted((r["file_name"], r["text"], r["sampling_rate"], len(r["audio"])) for r in data.collect()) == [("a.wav", "мен", 16_000, 3), ("b.wav", "но он", 16_000, 4)]
    (wavs / "metadata.tsv").write_text("file_name\ttranscript\na.wav\tол\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_transcripts(spark, str(wavs)).collect()] == [("a.wav", "ол")]
    ready = vocab.prepare_examples(data.where("file_name = 'a.wav'"), tokens).first()
    assert ready["labels"] == [0, 1, 2] and abs(sum(ready["input_values"])) < 1e-5


def test_evaluate_frames_against_a_dataset(spark, tmp_path):
    tokens = {c: i for i, c in enumerate("мено")} | {vocab.WORD_DELIMITER: 4, vocab.UNKNOWN: 5, vocab.PADDING: 6}
    rows = [(1, t, [math.log(0.94 if k == i else 0.01) for k in range(7)]) for t, i in enumerate(tokens[c] for c in "мен|но")]
    frames = spark.createDataFrame(rows, "utt_id long, t int, lp array<double>")
    spark.createDataFrame([(1, "мен он", "test"), (2, "но", "test"), (3, "мен", "train")], "utt_id long, text string, split string").write.partitionBy("split").parquet(str(tmp_path / "d"))
    out = jobs.evaluate(spark, frames, str(tmp_path / "d"), tokens)
    assert "WER                 : 0.6667" in out and "deletions           : 1" in out and "utterances          : 2" in out


def test_metric_of_predicted_ids(spark):
    v = {c: i for i, c in enumerate("мено")} | {vocab.WORD_DELIMITER: 4, vocab.UNKNOWN: 5, vocab.PADDING: 6}
    rows = [([0, 0, 6, 1, 2, 4, 2, 3, 6], [0, 1, 2, 4, 2, 3, -100, -100]), ([0, 1, 1, 2], [0, 1, 1, 2, -100])]
    r = vocab.batch_wer(spark.createDataFrame(rows, "ids array<int>, labels array<int>"), v).first()
    assert (r["edits"], r["n_ref"]) == (1, 3)


def test_lines_are_numbered_across_splits_and_files(spark, tmp_path):
    """A large file is many tasks, and its lines have the numbers they'd have in one."""
    rng = random.Random(8)
    breaks = ["\n", "\n", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\n\n"]
    whole = "".join(rng.choice(["", "a", "мен", "b c", "x" * 40]) + rng.choice(breaks) for _ in range(4000)) + "end"
    for name, text in {"many": whole, "empty": "", "n": "a\n", "b": "a\x0b", "bn": "a\x0b\n", "u": "a\n\u2028", "only": "\n", "x": "a\x85b"}.items():
        with open(tmp_path / f"{name}.txt", "w", encoding="utf-8", newline="") as f:
            f.write(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for name in ("many", "empty", "n", "b", "bn", "u", "only", "x"):
            with open(tmp_path / f"{name}.txt", encoding="utf-8", newline="") as f:
                want = f.read().splitlines()
            got = files.read_lines(spark, str(tmp_path / f"{name}.txt"), normalized=False)
            assert [tuple(r) for r in got.orderBy("utt_id").collect()] == list(enumerate(want))
            if name == "many":
                assert got.rdd.getNumPartitions() > 4
        spark.range(500).select(F.col("id").cast("string").alias("value")).repartitionByRange(7, "id").sortWithinPartitions(F.col("value").cast("int")).write.text(str(tmp_path / "folder"))
        got = files.read_lines(spark, str(tmp_path / "folder"), normalized=False).collect()
        assert sorted(map(tuple, got)) == [(i, str(i)) for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
