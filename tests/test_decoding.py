import itertools
import math
import random

import pytest

from tilspark.operators import ctc
from tilspark.operators import language_model as LM
from tilspark.operators import morphology as M

CHARS = {1: "а", 2: "б", 3: "|"}
THREE = ["мен мектепке барамын", "мен үйге барамын", "ол мектепке келді"]


def frames(spark, *utterances):
    hot = lambda i: [math.log(0.9 if k == i else 0.1 / 3) for k in range(4)]
    return spark.createDataFrame([(u, t, hot(i)) for u, ids in enumerate(utterances) for t, i in enumerate(ids)], "utt_id long, t int, lp array<double>")


def sentences(spark, texts):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "sent_id long, toks array<string>")


def probs(m, queries):
    df = m.counts.sparkSession.createDataFrame([(i, w, c) for i, (w, c) in enumerate(queries)], "i int, word string, ctx array<string>")
    tables = [r["p"] for r in m.score(df).orderBy("i").collect()]
    local = m.local()
    assert tables == pytest.approx([local.prob(w, c) for w, c in queries])
    return tables


def test_greedy(spark):
    got = ctc.greedy_decode(frames(spark, [1, 1, 0, 1, 3, 2], [0, 0]), CHARS)
    assert {r["utt_id"]: r["text"] for r in got.collect()} == {0: "аа б", 1: ""}


def test_beam(spark):
    got = ctc.beam_decode(frames(spark, [1, 0, 2, 0, 1]), CHARS, ctc.BeamSearch(beam_width=8))
    assert got.first()["text"] == "аба"
    assert ctc.search([], CHARS) == [("", 0.0)]


def test_beam_mass_is_exact():
    rows = [[math.log(0.9 if k == i else 0.1 / 3) for k in range(4)] for i in [1, 0, 2, 0, 1]]
    mass = 0.0
    for path in itertools.product(range(4), repeat=5):
        text = "".join(CHARS[c] for c, _ in itertools.groupby(path) if c)
        if text == "аба":
            mass += math.exp(sum(r[c] for r, c in zip(rows, path)))
    text, score = ctc.search(rows, CHARS, ctc.BeamSearch(beam_width=10**6))[0]
    assert text == "аба" and score == pytest.approx(math.log(mass)) == pytest.approx(-0.378693, abs=1e-6)


def test_strategies(spark):
    f = frames(spark, [1, 0, 2])
    assert {ctc.transcribe(f, CHARS, s).first()["text"] for s in ("greedy", "beam", "beam+lm")} == {"аб"}
    with pytest.raises(ValueError):
        ctc.transcribe(f, CHARS, "other")


def test_bigrams(spark):
    m = LM.KneserNey.train(sentences(spark, THREE), 2)
    assert probs(m, [("барамын", ["мектепке"]), ("келді", ["үйге"])]) == pytest.approx([0.3, 0.0666667], abs=1e-6)


def test_trigrams(spark):
    m = LM.KneserNey.train(sentences(spark, THREE), 3)
    q = [("барамын", ["мен", "мектепке"]), ("келді", ["мен", "мектепке"]), ("барамын", ["ол", "мектепке"]), ("zzz", ["мен", "мектепке"])]
    assert probs(m, q) == pytest.approx([0.406566, 0.189394, 0.239899, 0.026455], abs=1e-6)


def test_middle_orders(spark):
    s = sentences(spark, ["а б"] * 10)
    assert probs(LM.KneserNey.train(s, 3), [("б", ["zz", "а"]), ("б", ["<s>", "а"])]) == pytest.approx([9.625, 1.43125])
    assert all(0 <= p <= 1 for p in probs(LM.KneserNey.train(s, 3, strict=True), [("б", ["zz", "а"]), ("а", ["<s>", "<s>"])]))


def test_unigram_order(spark):
    m = LM.KneserNey.train(sentences(spark, ["а б"]), 1)
    assert probs(m, [("а", []), ("q", [])]) == pytest.approx([1 / (1 + 5 + 1)] * 2)


def test_save_and_load(spark, tmp_path):
    m = LM.KneserNey.train(sentences(spark, ["а б а", "а а б"]), 2)
    m.save(str(tmp_path / "lm"))
    q = [("б", ["а"])]
    assert probs(LM.KneserNey.load(spark, str(tmp_path / "lm")), q) == pytest.approx([0.125])


def test_perplexity(spark):
    s = sentences(spark, THREE)
    m = LM.KneserNey.train(s, 2)
    scored = {r["sent_id"]: (r["n_tokens"], r["logp"]) for r in m.score_sentences(s).collect()}
    want = math.exp(-sum(lp for _, lp in scored.values()) / sum(n for n, _ in scored.values()))
    assert m.perplexity(s).first()[0] == pytest.approx(want)
    assert m.perplexity(s.limit(0)).first()[0] == math.inf


def test_word_and_morpheme_scorers(spark):
    m = LM.KneserNey.train(sentences(spark, ["мектеп PL бала", "бала PL"]), 2).local()
    assert ctc.word_scorer(m)(["мектеп"], "PL") == pytest.approx(m.logprob("PL", ["мектеп"]))
    score = ctc.morpheme_scorer(m, M.local_tokens)(["бала"], "мектептер")
    assert score == pytest.approx(m.logprob("мектеп", ["бала"]) + m.logprob("PL", ["мектеп"]))


@pytest.mark.parametrize("strict", [False, True])
def test_model_in_files(spark, strict, monkeypatch):
    """The same values as a collected model's, with blocks of a few lines, whatever words hold; nothing
    of the model's size comes to the driver."""
    rng = random.Random(4)
    words = [*"abcdefgh", "a\tb", "c\nd", "\\n", "ж" * 300, "\U0001f600", "é"]
    sents = spark.createDataFrame([(rng.choices(words, k=rng.randint(1, 9)),) for _ in range(300)], "toks array<string>")
    m = LM.KneserNey.train(sents, 3, strict=strict)
    local = m.local()
    monkeypatch.setattr(LM.LocalKneserNey, "of", None)
    monkeypatch.setattr(LM.SortedFiles, "BLOCK", 64)
    monkeypatch.setattr(LM.SortedFiles, "HELD", 2)
    filed = m.filed()
    for _ in range(2000):
        word, context = rng.choice([*words, "unseen", LM.EOS]), rng.choices([*words, "unseen", LM.BOS], k=rng.randint(0, 3))
        assert filed.logprob(word, context) == local.logprob(word, context)


def test_counts_of_large_tables_are_cut(spark, tmp_path, monkeypatch):
    """Tasks grow in number with the files, not with what each holds."""
    rng = random.Random(6)
    sents = spark.createDataFrame([(rng.choices("abcdefghij", k=rng.randint(0, 20)),) for _ in range(2000)], "toks array<string>").coalesce(1)
    sents.write.parquet(str(tmp_path / "sents"))
    sents = spark.read.parquet(str(tmp_path / "sents"))
    counts = LM.ngram_counts(sents, 3)
    want = sorted(map(tuple, counts.collect())), sorted(map(tuple, LM.continuation_counts(counts).collect()))
    size = sum(f.stat().st_size for f in (tmp_path / "sents").glob("*.parquet"))
    monkeypatch.setattr(LM.scratch, "PIECE", size // 30)
    cut = LM.ngram_counts(sents, 3)
    rest = LM.continuation_counts(cut)
    assert cut.rdd.getNumPartitions() >= 30 and rest.rdd.getNumPartitions() >= 30
    assert (sorted(map(tuple, cut.collect())), sorted(map(tuple, rest.collect()))) == want
