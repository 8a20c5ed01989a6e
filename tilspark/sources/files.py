"""Files in and out: corpora, paired transcripts, prepared datasets, vocabularies, reports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_corpus(spark: SparkSession, path: str, *, normalized: bool = True) -> DataFrame:
    """``text, toks`` of each line that has words; splittable, in no order."""
    lines = spark.read.text(path)
    if normalized:
        rows = lines.select(T.normalize(F.col("value")).alias("text")).withColumn("toks", F.array_remove(F.split("text", " "), ""))
    else:
        rows = lines.select(F.col("value").alias("text"), T.words(F.col("value")).alias("toks"))
    return rows.where(F.size("toks") > 0)


#: what ends a line, besides the line ends at which files are split
_BREAKS = r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def read_lines(spark: SparkSession, path: str, *, normalized: bool = True) -> DataFrame:
    """``utt_id, text``: lines by number, empty ones kept; of a folder, the files' lines in the order of
    their names.

    Files are read in splits.  A first pass counts the lines of each split; a line's number is what the
    splits before its own hold, and its place there.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"))
    rows = lines.select("file", "at", "size", F.explode(F.split("value", _BREAKS)).alias("text")).withColumn("place", F.monotonically_increasing_id())
    ends = F.max_by(F.col("text") == "", "place").alias("blank")
    splits = rows.groupBy("file", "at", "size").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), ends).orderBy("file", "at").collect()  # a row for each split
    starts, total = [], 0
    for k, s in enumerate(splits):
        final = k + 1 == len(splits) or splits[k + 1]["file"] != s["file"]
        # a file that ends with one of the other breaks has no empty line behind it
        over = 1 if final and s["blank"] and _ends_with_break(spark, s["file"], s["size"]) else 0
        starts.append((s["file"], s["at"], total - s["first"], s["last"] - over))
        total += s["n"] - over
    starts = spark.createDataFrame(starts, "file string, at bigint, shift bigint, last bigint")
    rows = rows.join(F.broadcast(starts), ["file", "at"]).where(F.col("place") <= F.col("last"))
    return rows.select((F.col("place") + F.col("shift")).alias("utt_id"), (T.normalize(F.col("text")) if normalized else F.col("text")).alias("text"))


def _ends_with_break(spark: SparkSession, file: str, size: int) -> bool:
    """Are the last bytes of a file a break that isn't a line end?"""
    jvm = spark._jvm
    name = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = name.getFileSystem(spark._jsc.hadoopConfiguration()).open(name)
    try:
        stream.seek(max(0, size - 3))
        tail = bytes(stream.read() for _ in range(min(3, size)))
    finally:
        stream.close()
    return tail[-1:] in tuple(bytes([c]) for c in (0x0B, 0x0C, 0x1C, 0x1D, 0x1E)) or tail[-2:] == b"\xc2\x85" or tail in (b"\xe2\x80\xa8", b"\xe2\x80\xa9")


def pair_lines(ref: DataFrame, hyp: DataFrame, *, strict: bool = True) -> DataFrame:
    """``utt_id, ref, hyp`` by line number.  ``strict``: different numbers of lines are an error;
    otherwise the longer side loses its rest."""
    if strict:
        n, m = ref.count(), hyp.count()
        if n != m:
            raise ValueError(f"{n} references and {m} hypotheses")
    return ref.select("utt_id", F.col("text").alias("ref")).join(hyp.select("utt_id", F.col("text").alias("hyp")), "utt_id")


def read_dataset(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """The split of a prepared dataset, or all of it if it isn't split (partition pruning)."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if "split" in df.columns else df


def _with_split(df: DataFrame, key_col: str, text_col: str, test_size: float, seed: int) -> DataFrame:
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key_col).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return df.select("*", T.normalize(F.col(text_col)).alias("text"), F.when(place < test_size, "test").otherwise("train").alias("split")).where("text <> ''")


def prepare_dataset(transcripts: DataFrame, path: str | None = None, *, key_col: str = "file_name", text_col: str = "transcript", test_size: float = 0.1, seed: int = 42) -> DataFrame:
    """Normalised transcripts with a ``split`` by the hash of the key, so it doesn't depend on order or
    partitioning; written by split if a path is given.  Own design."""
    out = _with_split(transcripts, key_col, text_col, test_size, seed).select(F.col(key_col), "text", "split")
    if path:
        out.write.mode("overwrite").partitionBy("split").parquet(path)
    return out


def _pcm(content: bytes) -> tuple[int, "np.ndarray"]:
    """Sampling rate and mono samples in -1 to 1 of a PCM wav file (8, 16, 24 or 32 bits)."""
    import io
    import wave

    import numpy as np

    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = np.frombuffer(w.readframes(w.getnframes()), np.uint8)
    if width == 1:
        x = (data.astype(np.float32) - 128) / 128
    else:  # the bytes of a sample become the upper ones of an int32
        wide = np.zeros((len(data) // width, 4), np.uint8)
        wide[:, 4 - width :] = data.reshape(-1, width)
        x = wide.view("<i4")[:, 0] / float(1 << 31)
    return rate, x.astype(np.float32).reshape(-1, channels).mean(1)


def _resampled(x: "np.ndarray", rate: int, target: int) -> "np.ndarray":
    """Linear interpolation at the target's instants; above its band, a mean over each target step first."""
    import numpy as np

    if rate == target or not len(x):
        return x
    if rate > target:
        width = round(rate / target)
        x = np.convolve(x, np.ones(width, np.float32) / width, "same") if width > 1 else x
    at = np.arange(int(len(x) * target / rate)) * (rate / target)
    return np.interp(at, np.arange(len(x)), x).astype(np.float32)


def read_audio(spark: SparkSession, path: str, *, target_rate: int | None = None) -> DataFrame:
    """``path, sampling_rate, audio`` (array of float, channels averaged) of PCM wav files, resampled to
    ``target_rate`` if one is given."""

    def decode(frames):
        for pdf in frames:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                rate, x = _pcm(content)
                out.append((p, target_rate or rate, _resampled(x, rate, target_rate or rate)))
            yield pd.DataFrame(out, columns=["path", "sampling_rate", "audio"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content").mapInPandas(decode, "path string, sampling_rate int, audio array<float>")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, transcript`` of a folder: its ``metadata.csv`` or ``metadata.tsv``, or else a ``.txt``
    beside each ``.wav``."""
    from pyspark.errors import AnalysisException

    for name, sep in (("metadata.csv", ","), ("metadata.tsv", "\t")):
        try:
            return spark.read.csv(f"{path}/{name}", sep=sep, header=True).select("file_name", "transcript")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    texts = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", ".wav")
    return texts.select(name.alias("file_name"), F.trim(F.decode("content", "UTF-8")).alias("transcript"))


def package_dataset(spark: SparkSession, audio_dir: str, path: str, *, test_size: float = 0.1, seed: int = 42, target_rate: int = 16_000) -> DataFrame:
    """A folder of recordings as a dataset by split: mono audio of one rate beside its normalised
    transcript; files without one, and transcripts without text, are left out.  Own design."""
    audio = join_transcripts(read_audio(spark, audio_dir, target_rate=target_rate), read_transcripts(spark, audio_dir))
    out = _with_split(audio, "file_name", "transcript", test_size, seed)
    out.select("file_name", "text", "sampling_rate", "audio", "split").write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path)


def join_transcripts(audio: DataFrame, transcripts: DataFrame, *, key_col: str = "file_name") -> DataFrame:
    """Audio files with the transcripts of their base names."""
    return audio.withColumn(key_col, F.element_at(F.split("path", "/"), -1)).join(transcripts, key_col)


def sample_data(spark: SparkSession, n: int = 16, seed: int = 42) -> DataFrame:
    """``utt_id, text, frequency``: n short sentences over a small lexicon and a tone for each.  Own design."""
    who, where, what = ["мен", "ол", "біз", "бала"], ["мектепке", "үйге", "қалаға", "ауылға"], ["барамын", "келді", "кетті", "барады"]
    pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "utt_id"), F.lit(len(words))) + 1).cast("int"))
    return spark.range(n).withColumnRenamed("id", "utt_id").select("utt_id", F.concat_ws(" ", pick(who, 1), pick(where, 2), pick(what, 3)).alias("text"), (220.0 + 20 * F.pmod("utt_id", F.lit(20))).alias("frequency"))


def save_vocab(vocab: dict[str, int], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(vocab, f, ensure_ascii=False, indent=2)


def load_vocab(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_transcripts(df: DataFrame, path: str) -> None:
    """``name<TAB>text`` lines."""
    df.select("name", "text").write.mode("overwrite").csv(path, sep="\t", quote="", escape="")


def report(wer: float, cer: float, m, utterances: int, examples: list[str] = ()) -> str:
    """The console block of an evaluation; ``m`` is a row of ``morph_wer``."""
    rows = [
        ("utterances", utterances), ("reference words", m["n_ref_words"]), ("WER", f"{wer:.4f}"), ("CER", f"{cer:.4f}"), ("M-WER", f"{m['m_wer']:.4f}"),
        ("WER, same alignment", f"{m['wer_equivalent']:.4f}"), ("exact", m["exact"]), ("suffix only", m["suffix_only"]), ("root errors", m["root_errors"]),
        ("insertions", m["insertions"]), ("deletions", m["deletions"]),
    ]
    lines = [f"{name:<20}: {value}" for name, value in rows]
    return "\n".join([*lines, *(f"  {e}" for e in examples)])
