"""Whole jobs: score transcripts, build a language model, decode or transcribe, prepare a dataset.

    python -m tilspark.plans.jobs score --ref r.txt --hyp h.txt [--w-root 1.0] [--w-suffix 0.35]
    python -m tilspark.plans.jobs evaluate --frames frames.parquet --dataset dir --vocab vocab.json [--strategy greedy]
    python -m tilspark.plans.jobs build-lm --corpus c.txt --out lm [--order 3] [--word-level]
    python -m tilspark.plans.jobs decode --frames frames.parquet --vocab vocab.json --out out [--strategy beam+lm --lm lm --beam-width 32]
    python -m tilspark.plans.jobs prepare --transcripts t.tsv --out dir [--test-size 0.1]
    python -m tilspark.plans.jobs package --audio-dir wavs --out dir [--test-size 0.1 --min-char-count 1]
    python -m tilspark.plans.jobs demo

Frames are log-probabilities, ``utt_id, t, lp``; ``transcribe_wavs`` makes them from recordings by a
function of the caller's (a network runs outside this engine).
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, ctc, vocab
from ..operators import language_model as LM
from ..operators import morph_wer as MW
from ..operators import morphology as M
from ..sources import files

#: references and what a recogniser might make of them
DEMO = [("балалар қалаға барды", "балалар қалада барды"), ("достарым кітап оқыды", "достарым кітаптар оқыды"), ("біз ауылда тұрамыз", "біз ауылға тұрамыз")]


def score_pairs(pairs: DataFrame, params: MW.MorphWER = MW.MorphWER()) -> str:
    """The report over ``utt_id, ref, hyp``."""
    pairs = pairs.persist()
    try:
        wer = alignment.word_error_rate(pairs).first()["wer"]
        cer = alignment.character_error_rate(pairs).first()["cer"]
        shown = [r["example"] for r in MW.examples(pairs, params).collect()]  # a dozen at most
        return files.report(wer, cer, MW.morph_wer(pairs, params).first(), pairs.count(), shown)
    finally:
        pairs.unpersist()


def score_files(spark: SparkSession, ref: str, hyp: str, params: MW.MorphWER = MW.MorphWER()) -> str:
    return score_pairs(files.pair_lines(files.read_lines(spark, ref), files.read_lines(spark, hyp)), params)


def evaluate(spark: SparkSession, frames: DataFrame, dataset: str, tokens: dict[str, int], strategy: str = "greedy", params: MW.MorphWER = MW.MorphWER(), **options) -> str:
    """The report of decoded frames against the test split (or all) of a prepared dataset whose
    ``utt_id`` they carry."""
    ref = files.read_dataset(spark, dataset).select("utt_id", F.col("text").alias("ref"))
    hyp = decode(spark, frames, tokens, strategy, **options).select("utt_id", F.col("text").alias("hyp"))
    return score_pairs(ref.join(hyp, "utt_id", "left").select("utt_id", "ref", F.coalesce("hyp", F.lit("")).alias("hyp")), params)


def lm_sequences(corpus: DataFrame, word_level: bool = False) -> DataFrame:
    """``sent_id, toks``: words, or each word's root and tags; words are analysed once each."""
    numbered = corpus.select(F.monotonically_increasing_id().alias("sent_id"), "toks")
    if word_level:
        return numbered
    rows = numbered.select("sent_id", F.posexplode("toks").alias("pos", "word"))
    known = M.analyze_words(rows).select("word", M.morpheme_tokens(F.col("analysis")).alias("m"))
    s = rows.join(known, "word").groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s"))
    return s.select("sent_id", F.flatten(F.transform("s", lambda x: x["m"])).alias("toks"))


def build_lm(spark: SparkSession, corpus: str, out: str, order: int = 3, word_level: bool = False) -> float:
    """Trains and saves a model; returns its perplexity on the corpus."""
    text = files.read_corpus(spark, corpus)
    if text.isEmpty():
        raise SystemExit("no sentences in the corpus")
    sequences = lm_sequences(text, word_level).persist()
    try:
        return LM.KneserNey.train(sequences, order, path=out).perplexity(sequences).first()["perplexity"]
    finally:
        sequences.unpersist()


def decode(spark: SparkSession, frames: DataFrame, tokens: dict[str, int], strategy: str = "beam", lm_path: str | None = None, word_level: bool = False, beam_width: int = 32) -> DataFrame:
    """``utt_id, text``; the padding token is the blank."""
    lm = None
    if lm_path:
        local = LM.KneserNey.load(spark, lm_path).filed()
        lm = ctc.word_scorer(local) if word_level else ctc.morpheme_scorer(local, M.local_tokens)
    params = ctc.BeamSearch(blank_id=tokens[vocab.PADDING], word_delimiter=vocab.WORD_DELIMITER, beam_width=beam_width)
    return ctc.transcribe(frames, {i: t for t, i in tokens.items()}, strategy, params, lm)


def audio_frames(audio: DataFrame, log_probs: Callable, *, id_col: str = "path") -> DataFrame:
    """``utt_id, t, lp`` (and ``name``) of recordings: ``log_probs(samples, rate)`` gives the rows of a
    recording's matrix.  It travels to the workers, so a network is best loaded on its first call."""

    def run(parts):
        for pdf in parts:
            for key, name, rate, x in zip(pdf["utt_id"], pdf["name"], pdf["sampling_rate"], pdf["audio"]):
                rows = [list(map(float, r)) for r in log_probs(x, rate)]
                yield pd.DataFrame({"utt_id": [key] * len(rows), "name": [name] * len(rows), "t": range(len(rows)), "lp": rows})

    named = audio.select(F.xxhash64(id_col).alias("utt_id"), F.element_at(F.split(id_col, "/"), -1).alias("name"), "sampling_rate", "audio")
    return named.mapInPandas(run, "utt_id long, name string, t int, lp array<double>")


def transcribe_wavs(spark: SparkSession, path: str, log_probs: Callable, tokens: dict[str, int], strategy: str = "beam", **options) -> DataFrame:
    """``name, text`` of the wav files of a folder, read as mono at 16 kHz."""
    frames = audio_frames(files.read_audio(spark, path, target_rate=16_000), log_probs).persist()
    names = frames.select("utt_id", "name").distinct()
    return decode(spark, frames, tokens, strategy, **options).join(names, "utt_id").select("name", "text")


def demo(spark: SparkSession) -> str:
    words = spark.createDataFrame([(w,) for pair in DEMO for s in pair for w in s.split()], "word string").distinct()
    glosses = M.analyze_words(words).select("word", M.gloss(F.col("analysis")).alias("g")).orderBy("word").collect()
    pairs = spark.createDataFrame([(i, *p) for i, p in enumerate(DEMO)], "utt_id long, ref string, hyp string")
    return "\n".join([*(f"{r['word']:<16}{r['g']}" for r in glosses), score_pairs(pairs)])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="job", required=True)
    names = {
        "score": ("ref", "hyp"), "evaluate": ("frames", "dataset", "vocab"), "build-lm": ("corpus", "out"), "decode": ("frames", "vocab", "out"),
        "prepare": ("transcripts", "out"), "package": ("audio-dir", "out"), "demo": (),
    }
    parsers = {}
    for job, required in names.items():
        parsers[job] = sub.add_parser(job)
        for r in required:
            parsers[job].add_argument(f"--{r}", required=True)
    parsers["build-lm"].add_argument("--order", type=int, default=3)
    for job in ("build-lm", "decode", "evaluate"):
        parsers[job].add_argument("--word-level", action="store_true")
    for job in ("score", "evaluate"):
        parsers[job].add_argument("--w-root", type=float, default=MW.MorphWER.w_root)
        parsers[job].add_argument("--w-suffix", type=float, default=MW.MorphWER.w_suffix)
    for job, strategy in (("decode", "beam"), ("evaluate", "greedy")):
        parsers[job].add_argument("--strategy", default=strategy, choices=("greedy", "beam", "beam+lm"))
        parsers[job].add_argument("--lm")
        parsers[job].add_argument("--beam-width", type=int, default=32)
    for job in ("prepare", "package"):
        parsers[job].add_argument("--test-size", type=float, default=0.1)
        parsers[job].add_argument("--seed", type=int, default=42)
        parsers[job].add_argument("--min-char-count", type=int, default=1)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"tilspark {a.job}").getOrCreate()
    if a.job in ("score", "evaluate"):
        params = MW.MorphWER(w_root=a.w_root, w_suffix=a.w_suffix)
    if a.job == "score":
        print(score_files(spark, a.ref, a.hyp, params))
    elif a.job == "evaluate":
        print(evaluate(spark, spark.read.parquet(a.frames), a.dataset, files.load_vocab(a.vocab), a.strategy, params, lm_path=a.lm, word_level=a.word_level, beam_width=a.beam_width))
    elif a.job == "build-lm":
        print(f"perplexity: {build_lm(spark, a.corpus, a.out, a.order, a.word_level):.4f}")
    elif a.job == "decode":
        out = decode(spark, spark.read.parquet(a.frames), files.load_vocab(a.vocab), a.strategy, a.lm, a.word_level, a.beam_width)
        files.write_transcripts(out.select(F.col("utt_id").cast("string").alias("name"), "text"), a.out)
    elif a.job in ("prepare", "package"):
        if a.job == "prepare":
            t = spark.read.csv(a.transcripts, sep="\t", header=True)
            data = files.prepare_dataset(t, a.out, test_size=a.test_size, seed=a.seed)
        else:
            data = files.package_dataset(spark, a.audio_dir, a.out, test_size=a.test_size, seed=a.seed)
        files.save_vocab(vocab.vocab_map(vocab.build_vocab(data, min_count=a.min_char_count)), f"{a.out}-vocab.json")
    else:
        print(demo(spark))


if __name__ == "__main__":
    main()
