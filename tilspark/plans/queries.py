"""Queries over the test tables, one or more for each operator, and DuckDB SQL for their rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phonology as P
from ..functions import suffixes as S
from ..functions import text as T
from ..operators import alignment as L
from ..operators import ctc, vocab
from ..operators import language_model as LM
from ..operators import morph_wer as MW
from ..operators import morphology as M
from ..sources import files, scratch
from . import bridges as B

# ---------------------------------------------------------------- SQL parts

_VOWEL = P.VOWELS


def _sql_runs(x: str, inside: str, change: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[{inside}]+|[^{inside}]+'), lambda r: CASE WHEN regexp_full_match(r, '[{inside}]+') THEN {change} ELSE r END), '')"


def _sql_abbreviations(x: str) -> str:
    for short, full in T.ABBREVIATIONS:
        x = f"replace({x}, '{short}', ' {full} ')"
    return x


def _sql_homoglyphs(x: str) -> str:
    return _sql_runs(x, "a-z", f"CASE WHEN regexp_full_match(r, '[{T.HOMOGLYPHS_FROM}]+') THEN translate(r, '{T.HOMOGLYPHS_FROM}', '{T.HOMOGLYPHS_TO}') ELSE r END")


def _sql_digits(x: str) -> str:
    return _sql_runs(x, "0-9", f"array_to_string(list_transform(string_split(r, ''), lambda d: {B.sql_list(T.DIGITS)}[d::INT + 1]), ' ')")


def _sql_normalize(x: str) -> str:
    x = _sql_digits(_sql_homoglyphs(_sql_abbreviations(f"lower(nfc_normalize(coalesce({x}, '')))")))
    return f"trim(regexp_replace(regexp_replace({x}, '[^{T.ALPHABET} ]', ' ', 'g'), ' +', ' ', 'g'))"


def _sql_words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def _sql_harmony(w: str) -> str:
    firm, soft = (f"regexp_extract({w}, '([{a}])[^{a}]*$', 1)" for a in (P.FRONT + P.BACK, P.NEUTRAL))
    return f"CASE WHEN {firm} <> '' THEN CASE WHEN contains('{P.FRONT}', {firm}) THEN 'front' ELSE 'back' END WHEN {soft} IN ('и', 'ё') THEN 'front' ELSE 'back' END"


def _sql_final(w: str) -> str:
    last = f"right({w}, 1)"
    return f"CASE WHEN {last} = '' OR contains('{_VOWEL}', {last}) THEN 'vowel' WHEN contains('{P.VOICELESS}', {last}) THEN 'voiceless' WHEN contains('{P.SONORANT}', {last}) THEN 'sonorant' ELSE 'voiced' END"


_SQL_SUFFIX = "(VALUES " + ", ".join(
    f"('{chain}', '{s.slot}', '{s.tag}', '{s.surface}', {repr(s.harmony) if s.harmony else 'NULL'}, '{','.join(s.after)}')"
    for chain, slots in S.CHAINS.items() for slot in slots for s in S.SUFFIXES if s.slot == slot
) + ") x(chain, slot, tag, surface, harmony, after)"


def _sql_licensed(stem: str) -> str:
    return f"((harmony IS NULL OR harmony = {_sql_harmony(stem)}) AND (after = '' OR list_contains(string_split(after, ','), {_sql_final(stem)})))"


def _sql_analyses(words: str) -> str:
    """CTEs up to ``parses(word, root, tags, chain, score, rk)`` for a relation of distinct words."""
    parts = [f"w0 AS (SELECT DISTINCT word FROM ({words}) q)", f"sx AS (SELECT * FROM {_SQL_SUFFIX})"]
    final = []
    for order, (chain, slots) in enumerate(S.CHAINS.items()):
        prev = f"{chain}0"
        parts.append(f"{prev} AS (SELECT word, word AS stem, 0.0::DOUBLE AS s, '' AS tags, '' AS surf, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2, 0.0::DOUBLE AS s3, 0 AS o1, 0 AS o2, 0 AS o3 FROM w0)")
        for k, slot in enumerate(reversed(slots), 1):
            stem = "left(stem, length(stem) - length(surface))"
            peel = (
                f"SELECT word, {stem} AS stem, s + (CASE WHEN {_sql_licensed(stem)} THEN 1.0::DOUBLE ELSE -0.9::DOUBLE END - 0.35::DOUBLE) AS s, tag || CASE WHEN tags = '' THEN '' ELSE ',' || tags END AS tags, surface || CASE WHEN tags = '' THEN '' ELSE ',' || surf END AS surf, s1, s2, s3, "
                + ", ".join(f"4 - length(surface) AS o{i}" if i == k else f"o{i}" for i in (1, 2, 3))
                + f" FROM {prev} JOIN sx ON slot = '{slot}' AND right(stem, length(surface)) = surface AND length(stem) - length(surface) >= 2"
            )
            both = f"SELECT word, stem, s, tags, surf, s1, s2, s3, o1, o2, o3 FROM {prev} UNION ALL {peel}"
            cols = ", ".join(f"s AS s{i}" if i == k else f"s{i}" for i in (1, 2, 3))
            parts.append(f"{chain}{k} AS (SELECT word, stem, s, tags, surf, {cols}, o1, o2, o3 FROM ({both}) q)")
            prev = f"{chain}{k}"
        deficit = f"(greatest(0, 3 - length(stem)) + CASE WHEN regexp_matches(stem, '[{_VOWEL}]') THEN 0 ELSE 2 END)"
        final.append(f"SELECT word, stem AS root, tags, surf, '{chain}' AS chain, {order} AS co, s - 0.08::DOUBLE * {deficit} AS score, s3, s2, s1, o1, o2, o3 FROM {prev} WHERE tags <> ''")
    deficit = f"(greatest(0, 3 - length(word)) + CASE WHEN regexp_matches(word, '[{_VOWEL}]') THEN 0 ELSE 2 END)"
    final.append(f"SELECT word, word, '', '', 'root', 2, CASE WHEN regexp_matches(word, '[{_VOWEL}]') THEN 0.15::DOUBLE ELSE -0.2::DOUBLE END - 0.08::DOUBLE * {deficit}, 0, 0, 0, 0, 0, 0 FROM w0")
    order = "score DESC, co, s3 DESC, s2 DESC, s1 DESC, o1, o2, o3"
    parts.append(f"every AS ({' UNION ALL '.join(final)})")
    parts.append(f"firsts AS (SELECT *, row_number() OVER (PARTITION BY word, root, tags ORDER BY {order}) AS d FROM every)")
    parts.append(f"parses AS (SELECT word, root, tags, surf, chain, score, row_number() OVER (PARTITION BY word ORDER BY {order}) AS rk FROM firsts WHERE d = 1)")
    return ",\n".join(parts)


# ---------------------------------------------------------------- inputs


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as the reference of the next one."""
    c = B.read(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("ref"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return scratch.spread(a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt_id"), "ref", "hyp"))


_SQL_TURNS = "turns AS (SELECT a.conv_id * 1000 + a.turn AS utt_id, coalesce(a.text, '') AS ref, coalesce(b.text, '') AS hyp FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, word``: an inflected word for each document, and all words of its text."""
    d = B.read(spark, sf_dir, "documents")
    own = d.select("doc_id", F.explode(T.normalized_words(B.translit(F.col("text")))).alias("word"))
    return d.select("doc_id", B.inflected(F.col("doc_id") * 7 + 3).alias("word")).unionByName(own)


_SQL_ALL_WORDS = f"SELECT doc_id, {B.sql_inflected('doc_id * 7 + 3')} AS word FROM documents UNION ALL SELECT doc_id, unnest({_sql_words(_sql_normalize(B.sql_translit('text')))}) AS word FROM documents"

#: what sets the numbers of made sentences apart from those of turns
_MADE = 10**12


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``utt_id, ref, hyp``: all pairs of turns, normalised, and for each document a sentence of four
    inflected words with a disturbed copy."""
    say = lambda c: T.normalize(B.translit(F.col(c)))
    turns = _turns(spark, sf_dir).select("utt_id", say("ref").alias("ref"), say("hyp").alias("hyp"))
    n = F.col("doc_id")
    word = lambda k: B.inflected(n * 13 + k)
    other = lambda k: B.inflected(n * 13 + k + len(B.ROOTS) * F.pmod(n, F.lit(3)))
    ref = F.concat_ws(" ", *[word(k) for k in range(4)])
    hyp = F.concat_ws(" ", word(0), other(1), F.when(F.pmod(n, F.lit(5)) == 0, other(7)), other(2), F.when(F.pmod(n, F.lit(4)) != 0, word(3)))
    return B.read(spark, sf_dir, "documents").select((n + _MADE).alias("utt_id"), ref.alias("ref"), hyp.alias("hyp")).unionByName(turns)


def _sql_pairs() -> str:
    """CTEs up to ``pairs(utt_id, r, h)``."""
    word = lambda k: B.sql_inflected(f"doc_id * 13 + {k}")
    other = lambda k: B.sql_inflected(f"doc_id * 13 + {k} + {len(B.ROOTS)} * (doc_id % 3)")
    say = lambda c: _sql_words(_sql_normalize(B.sql_translit(c)))
    return f"""{_SQL_TURNS}, pairs AS (SELECT utt_id, {say('ref')} AS r, {say('hyp')} AS h FROM turns
UNION ALL SELECT doc_id + {_MADE}, [{', '.join(word(k) for k in range(4))}], list_filter([{word(0)}, {other(1)}, CASE WHEN doc_id % 5 = 0 THEN {other(7)} END, {other(2)}, CASE WHEN doc_id % 4 <> 0 THEN {word(3)} END], lambda x: x IS NOT NULL) FROM documents)"""


def _sentences(spark: SparkSession, sf_dir: str, table: str = "conversations") -> DataFrame:
    """``sent_id, toks``: turns as normalised Cyrillic words."""
    c = B.read(spark, sf_dir, table)
    key = F.col("conv_id") * 1000 + F.col("turn") if table == "conversations" else F.col("item_id")
    toks = T.normalized_words(B.translit(F.col("text")))
    return c.select(key.alias("sent_id"), toks.alias("toks")).where(F.size("toks") > 0)


_SQL_SENTENCES = f"sents AS (SELECT * FROM (SELECT conv_id * 1000 + turn AS sent_id, {_sql_words(_sql_normalize(B.sql_translit('text')))} AS toks FROM conversations) q WHERE len(toks) > 0)"


def _sql_grams(order: int) -> str:
    rows = " UNION ALL ".join(f"SELECT {n} AS n, p[i:i + {n - 2}] AS ctx, p[i + {n - 1}] AS word FROM (SELECT p, unnest(range(1, len(p) - {n - 2})) AS i FROM pad) q" if n > 1 else "SELECT 1 AS n, []::VARCHAR[] AS ctx, unnest(p) AS word FROM pad" for n in range(1, order + 1))
    return f"pad AS (SELECT {'list_concat(' + B.sql_list([LM.BOS] * (order - 1)) + ', list_concat(toks, ' + B.sql_list([LM.EOS]) + '))'} AS p FROM sents), grams AS (SELECT n, ctx, word, count(*) AS c FROM ({rows}) q GROUP BY ALL)"


_SQL_CONT = "cont AS (SELECT n - 1 AS n, ctx[2:] AS ctx, word, count(*) AS k FROM grams WHERE n > 1 GROUP BY ALL)"
_SQL_DISC = """cc AS (SELECT n, count(*) FILTER (WHERE c = 1)::DOUBLE AS n1, count(*) FILTER (WHERE c = 2)::DOUBLE AS n2, count(*) FILTER (WHERE c = 3)::DOUBLE AS n3, count(*) FILTER (WHERE c = 4)::DOUBLE AS n4 FROM grams GROUP BY n),
dy AS (SELECT *, n1 / nullif(n1 + 2 * n2, 0) AS y FROM cc),
da AS (SELECT *, CASE WHEN n1 = 0 THEN 0.5::DOUBLE ELSE 1 - 2 * y * n2 / n1 END AS a FROM dy),
db AS (SELECT *, CASE WHEN n1 = 0 THEN 0.5::DOUBLE WHEN n2 > 0 THEN 2 - 3 * y * n3 / n2 ELSE a END AS b FROM da),
dc AS (SELECT *, CASE WHEN n1 = 0 THEN 0.5::DOUBLE WHEN n3 > 0 THEN 3 - 4 * y * n4 / n3 ELSE b END AS c3 FROM db),
disc AS (SELECT n, greatest(0, least(1, a)) AS d1, greatest(0, least(2, b)) AS d2, greatest(0, least(3, c3)) AS d3 FROM dc)"""


def _sql_contexts(order: int, strict: bool = False) -> str:
    counted = f"(SELECT n, ctx, c FROM grams WHERE n = {order} UNION ALL SELECT n, ctx, k FROM cont WHERE n < {order})" if strict else "grams"
    return f"""fol AS (SELECT n, ctx, count(*) FILTER (WHERE c = 1) AS n1, count(*) FILTER (WHERE c = 2) AS n2, count(*) FILTER (WHERE c >= 3) AS n3 FROM {counted} q WHERE n > 1 GROUP BY n, ctx),
rw AS (SELECT n + 1 AS n, list_append(ctx, word) AS ctx, c AS raw FROM grams WHERE n < {order}),
ty AS (SELECT n, ctx, sum(k) AS types FROM cont WHERE n > 1 AND n < {order} GROUP BY n, ctx),
stats AS (SELECT rw.n, rw.ctx, CASE WHEN rw.n < {order} AND coalesce(types, 0) > 0 THEN types ELSE raw END::DOUBLE AS total, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3
  FROM rw LEFT JOIN fol ON rw.n = fol.n AND rw.ctx = fol.ctx LEFT JOIN ty ON rw.n = ty.n AND rw.ctx = ty.ctx)"""


def _sql_scores(queries: str, order: int, strict: bool = False) -> str:
    """CTEs up to ``scored(id, word, p)`` for a relation (id, word, ctx)."""
    grams = lambda n: "(SELECT n, ctx, word, k AS c FROM cont)" if strict and n < order else "grams"
    out = [
        "vocab AS (SELECT DISTINCT word FROM grams WHERE n = 1 UNION SELECT unnest(['<s>', '</s>', '<unk>']))",
        "tot AS (SELECT greatest(coalesce((SELECT sum(k) FROM cont WHERE n = 1), 0), 1)::DOUBLE AS t, (SELECT count(*) FROM vocab) AS v)",
        f"q1 AS (SELECT q.id, q.word, q.ctx, CASE WHEN coalesce(k, 0) > 0 THEN k / t ELSE 1.0::DOUBLE / (t + v + 1) END AS p FROM ({queries}) q LEFT JOIN vocab ON vocab.word = q.word LEFT JOIN cont ON cont.n = 1 AND cont.word = CASE WHEN vocab.word IS NULL THEN '<unk>' ELSE q.word END CROSS JOIN tot)",
    ]
    for n in range(2, order + 1):
        out.append(f"""q{n} AS (SELECT q.id, q.word, q.ctx, CASE WHEN coalesce(s.total, 0) > 0 THEN greatest(coalesce(g.c, 0) - CASE coalesce(g.c, 0) WHEN 0 THEN 0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) / s.total + (d1 * n1 + d2 * n2 + d3 * n3) / s.total * q.p ELSE q.p END AS p
  FROM q{n - 1} q LEFT JOIN stats s ON s.n = {n} AND s.ctx = q.ctx[len(q.ctx) - {n - 2}:] LEFT JOIN {grams(n)} g ON g.n = {n} AND g.ctx = q.ctx[len(q.ctx) - {n - 2}:] AND g.word = q.word LEFT JOIN disc ON disc.n = {n})""")
    return ",\n".join([*out, f"scored AS (SELECT * FROM q{order})"])


_ORDER = 3
_SQL_COUNTED = f"{_SQL_SENTENCES}, {_sql_grams(_ORDER)}, {_SQL_CONT}, {_SQL_DISC}"
_SQL_MODEL = f"{_SQL_COUNTED}, {_sql_contexts(_ORDER)}"
_SQL_HELD = f"held AS (SELECT * FROM (SELECT item_id AS sent_id, {_sql_words(_sql_normalize(B.sql_translit('text')))} AS toks FROM benchmark) q WHERE len(toks) > 0), hp AS (SELECT sent_id, list_concat(['<s>', '<s>'], list_concat(toks, ['</s>'])) AS p FROM held), hq AS (SELECT sent_id AS id, p[i] AS word, p[i - 2:i - 1] AS ctx FROM (SELECT sent_id, p, unnest(range(3, len(p) + 1)) AS i FROM hp) q)"


#: a symbol for each component of an embedding: the blank, the alphabet, the delimiter, some capitals
_SYMBOLS = ["", *sorted(T.ALPHABET), "|", *"ABCDEFGHIJKLMNOPQRST"]


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[int, str]]:
    """Twelve embeddings in a row make the frames of an utterance, their components its symbols."""
    e = B.read(spark, sf_dir, "embeddings")
    lp = F.transform("embedding", lambda x: F.round(x.cast("double") * 4 - 2, 6))
    return e.select(F.floor(F.col("vec_id") / 12).cast("bigint").alias("utt_id"), F.pmod("vec_id", F.lit(12)).cast("int").alias("t"), lp.alias("lp")), dict(enumerate(_SYMBOLS))


_SQL_FRAMES = "f AS (SELECT vec_id // 12 AS utt_id, vec_id % 12 AS t, list_transform(embedding, lambda x: round(x::DOUBLE * 4 - 2, 6)) AS lp FROM embeddings)"


#: a vocabulary: the alphabet and the special tokens
_V = {c: i for i, c in enumerate([*sorted(T.ALPHABET), vocab.WORD_DELIMITER, vocab.UNKNOWN, vocab.PADDING])}


# ---------------------------------------------------------------- queries


def normalize_documents(spark, sf_dir):
    d = B.read(spark, sf_dir, "documents")
    return d.select("doc_id", T.normalize(B.translit(F.col("text"))).alias("normalized"), F.size(T.normalized_words(F.col("text"))).cast("bigint").alias("n_words"))


def homoglyph_repair(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select("doc_id", T.repair_homoglyphs(F.lower("text")).alias("repaired"))


def digit_expand(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select("doc_id", T.expand_digits(F.lower("text")).alias("expanded"))


def abbreviation_expand(spark, sf_dir):
    text = F.concat(B.translit(F.col("text")), F.lit(" т.б. жыл."))
    return B.read(spark, sf_dir, "documents").select("doc_id", T.expand_abbreviations(text).alias("expanded"))


def char_vocab(spark, sf_dir):
    d = B.read(spark, sf_dir, "documents").select(B.translit(F.col("text")).alias("text"))
    return vocab.build_vocab(d, min_count=2).select("token", F.col("id").cast("bigint").alias("id"))


def char_histogram(spark, sf_dir):
    return vocab.char_counts(B.read(spark, sf_dir, "documents").select(B.translit(F.col("text")).alias("text")))


def _distinct_words(spark, sf_dir):
    d = B.read(spark, sf_dir, "documents").select(F.explode(T.normalized_words(B.translit(F.col("text")))).alias("word"))
    return d.distinct()


_SQL_WORDS = f"SELECT DISTINCT unnest({_sql_words(_sql_normalize(B.sql_translit('text')))}) AS word FROM documents"


def phonology(spark, sf_dir):
    w = F.col("word")
    return _distinct_words(spark, sf_dir).select("word", P.harmony_class(w).alias("harmony"), P.final_class(w).alias("final_class"), P.is_rounded(w).alias("rounded"), P.last_vowel(w).alias("last_vowel"))


def suffix_match(spark, sf_dir):
    return M.suffix_matches(_words(spark, sf_dir).select("word").distinct(), S.suffix_table(spark))


def analyze_best(spark, sf_dir):
    a = F.col("analysis")
    return M.analyze_words(_words(spark, sf_dir)).select("word", a["root"].alias("root"), F.array_join(M.tags(a), ",").alias("tags"), a["chain"].alias("chain"), F.round(a["score"], 6).alias("score"))


def analyze_topk(spark, sf_dir):
    words = _words(spark, sf_dir).select("word").distinct()
    rows = words.select("word", F.posexplode(M.analyses(F.col("word"), top_k=3)).alias("k", "a"))
    return rows.select("word", (F.col("k") + 1).cast("bigint").alias("rk"), F.col("a.root").alias("root"), F.array_join(M.tags(F.col("a")), ",").alias("tags"), F.round("a.score", 6).alias("score"))


def gloss(spark, sf_dir):
    return M.analyze_words(_words(spark, sf_dir)).select("word", M.gloss(F.col("analysis")).alias("gloss"))


def root_frequency(spark, sf_dir):
    words = _words(spark, sf_dir)
    counts = words.groupBy("word").agg(F.count("*").alias("c"))
    return counts.withColumn("root", M.best(F.col("word"))["root"]).groupBy("root").agg(F.sum("c").alias("n"), F.count("*").alias("n_forms"))


def tag_distribution(spark, sf_dir):
    counts = _words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("c")).withColumn("a", M.best(F.col("word")))
    return counts.select("c", F.explode(M.tags(F.col("a"))).alias("tag")).groupBy("tag").agg(F.sum("c").alias("n"))


def wer_turns(spark, sf_dir):
    return L.word_error_rate(_turns(spark, sf_dir)).withColumn("wer", F.round("wer", 9))


def cer_turns(spark, sf_dir):
    return L.character_error_rate(_turns(spark, sf_dir)).withColumn("cer", F.round("cer", 9))


def word_distances(spark, sf_dir):
    r, h = T.words(F.col("ref")), T.words(F.col("hyp"))
    return _turns(spark, sf_dir).select("utt_id", r.alias("r"), h.alias("h")).select("utt_id", L.edit_distance(F.col("r"), F.col("h")).cast("bigint").alias("distance"))


def align_ops(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("utt_id", L.align(T.words(F.col("ref")), T.words(F.col("hyp"))).alias("ops"))
    return p.select("utt_id", F.concat_ws(",", F.transform("ops", lambda o: o["op"])).alias("ops"), *L.op_counts(F.col("ops")))


def mwer_lexicon(spark, sf_dir):
    out = MW.morph_wer(_pairs(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def mwer_breakdown(spark, sf_dir):
    ops = MW.costed(MW.aligned(_pairs(spark, sf_dir)))
    return ops.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


def mwer_examples(spark, sf_dir):
    return MW.examples(_pairs(spark, sf_dir)).select("utt_id", F.col("pos").cast("bigint").alias("pos"), "example")


def ngram_counts(spark, sf_dir):
    return LM.ngram_counts(_sentences(spark, sf_dir), _ORDER).select(F.col("n").cast("bigint").alias("n"), F.replace("ctx", F.lit(LM.SEP), F.lit(" ")).alias("ctx"), "word", "c")


def continuation_counts(spark, sf_dir):
    c = LM.continuation_counts(LM.ngram_counts(_sentences(spark, sf_dir), _ORDER))
    return c.select(F.col("n").cast("bigint").alias("n"), F.replace("ctx", F.lit(LM.SEP), F.lit(" ")).alias("ctx"), "word", "k")


def discounts(spark, sf_dir):
    d = LM.discounts(LM.ngram_counts(_sentences(spark, sf_dir), _ORDER))
    return d.select(F.col("n").cast("bigint").alias("n"), *[F.round(c, 9).alias(c) for c in ("d1", "d2", "d3")])


def context_stats(spark, sf_dir):
    m = LM.KneserNey.train(_sentences(spark, sf_dir), _ORDER)
    return m.contexts.select(F.col("n").cast("bigint").alias("n"), F.replace("ctx", F.lit(LM.SEP), F.lit(" ")).alias("ctx"), F.col("total").cast("double").alias("total"), "n1", "n2", "n3")


def lm_score(spark, sf_dir):
    m = LM.KneserNey.train(_sentences(spark, sf_dir), _ORDER)
    s = m.score_sentences(_sentences(spark, sf_dir, "benchmark"))
    return s.select("sent_id", "n_tokens", F.round("logp", 5).alias("logp"))


def perplexity(spark, sf_dir):
    m = LM.KneserNey.train(_sentences(spark, sf_dir), _ORDER)
    return m.perplexity(_sentences(spark, sf_dir, "benchmark")).select(F.round("perplexity", 4).alias("perplexity"))


def _morpheme_sentences(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    rows = pairs.select("utt_id", F.posexplode(T.words(F.col("ref"))).alias("pos", "word"))
    rows = rows.join(M.analyze_words(rows), "word").select("utt_id", "pos", M.morpheme_tokens(F.col("analysis")).alias("m"))
    s = rows.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s"))
    return s.select(F.col("utt_id").alias("sent_id"), F.flatten(F.transform("s", lambda x: x["m"])).alias("toks"))


def morpheme_sequences(spark, sf_dir):
    return _morpheme_sentences(spark, sf_dir).select("sent_id", F.array_join("toks", " ").alias("tokens"))


def ctc_greedy(spark, sf_dir):
    frames, chars = _frames(spark, sf_dir)
    return ctc.greedy_decode(frames, chars)


def ctc_beam(spark, sf_dir):
    frames, chars = _frames(spark, sf_dir)
    return ctc.beam_decode(frames, chars, n_best=3).select("utt_id", "rank", "text", F.round("score", 9).alias("score"))


def ctc_beam_lm(spark, sf_dir):
    frames, chars = _frames(spark, sf_dir)
    lm = LM.KneserNey.train(_morpheme_sentences(spark, sf_dir), 2).filed()
    scorer = ctc.morpheme_scorer(lm, M.local_tokens)
    return ctc.beam_decode(frames, chars, ctc.BeamSearch(), scorer).select("utt_id", "text", F.round("score", 9).alias("score"))


def collate_labels(spark, sf_dir):
    """Labels of eight documents' words a batch, padded."""
    v = _V
    d = _pairs(spark, sf_dir).select("utt_id", F.floor(F.col("utt_id") / 8).alias("batch"), vocab.encode_labels(F.col("ref"), v).alias("labels"))
    p = vocab.pad_labels(d, "batch")
    return p.select("utt_id", F.array_join(F.transform("padded", lambda x: x.cast("string")), ",").alias("padded"), vocab.decode_labels(F.col("padded"), v).alias("decoded"))


def dataset_split(spark, sf_dir):
    d = _pairs(spark, sf_dir).select(F.col("utt_id").alias("file_name"), F.col("ref").alias("transcript"))
    return files.prepare_dataset(d)


# sources, sinks and jobs: the tables go out as files and come back


def corpus_scan(spark, sf_dir):
    path = scratch.path(spark, "corpus")
    B.read(spark, sf_dir, "documents").select(F.coalesce(B.translit(F.col("text")), F.lit(""))).write.text(path)
    return files.read_corpus(spark, path).select("text", F.size("toks").cast("bigint").alias("n_words"))


def _line_files(spark, sf_dir) -> tuple[str, str]:
    """Reference and hypothesis files of the turns, in the order of their ids."""
    out = []
    for side in ("ref", "hyp"):
        out.append(scratch.path(spark, side))
        rows = _turns(spark, sf_dir).select("utt_id", F.regexp_replace(B.translit(F.coalesce(side, F.lit(""))), r"\s+", " ").alias("value"))
        rows.repartitionByRange("utt_id").sortWithinPartitions("utt_id").select("value").write.text(out[-1])
    return out[0], out[1]


def paired_lines(spark, sf_dir):
    ref, hyp = _line_files(spark, sf_dir)
    return files.pair_lines(files.read_lines(spark, ref), files.read_lines(spark, hyp))


def prepared_test_split(spark, sf_dir):
    path = scratch.path(spark, "prepared")
    files.prepare_dataset(_pairs(spark, sf_dir).select(F.col("utt_id").alias("file_name"), F.col("ref").alias("transcript")), path)
    return files.read_dataset(spark, path, "test").select("file_name", "text")


def vocab_file(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:  # the driver writes and reads it
        files.save_vocab(vocab.vocab_map(vocab.build_vocab(B.read(spark, sf_dir, "conversations").select(B.translit(F.col("text")).alias("text")))), f"{folder}/vocab.json")
        known = files.load_vocab(f"{folder}/vocab.json")
    return spark.createDataFrame(list(known.items()), "token string, id long")


def transcript_file(spark, sf_dir):
    path = scratch.path(spark, "transcripts")
    files.write_transcripts(_pairs(spark, sf_dir).select(F.concat(F.col("utt_id").cast("string"), F.lit(".wav")).alias("name"), F.col("hyp").alias("text")), path)
    return spark.read.csv(path, sep="\t", schema="name string, text string").select("name", F.coalesce("text", F.lit("")).alias("text"))


def lm_saved(spark, sf_dir):
    """Scores of a model that was saved and loaded."""
    path = scratch.path(spark, "saved")
    LM.KneserNey.train(_sentences(spark, sf_dir), _ORDER).save(path)
    s = LM.KneserNey.load(spark, path).score_sentences(_sentences(spark, sf_dir, "benchmark"))
    return s.select("sent_id", "n_tokens", F.round("logp", 5).alias("logp"))


def lm_score_strict(spark, sf_dir):
    s = LM.KneserNey.train(_sentences(spark, sf_dir), _ORDER, strict=True).score_sentences(_sentences(spark, sf_dir, "benchmark"))
    return s.select("sent_id", "n_tokens", F.round("logp", 5).alias("logp"))


def build_lm_words(spark, sf_dir):
    """The perplexity that the model-building job reports, at word level."""
    from . import jobs

    corpus = scratch.path(spark, "corpus")
    B.read(spark, sf_dir, "conversations").select(F.regexp_replace(B.translit(F.coalesce("text", F.lit(""))), r"\s+", " ")).write.text(corpus)
    value = jobs.build_lm(spark, corpus, scratch.path(spark, "lm"), _ORDER, word_level=True)
    return spark.createDataFrame([(round(value, 4),)], "perplexity double")


def batch_metric(spark, sf_dir):
    """The training metric: hypotheses as frame ids with blanks between, references as padded labels."""
    ids = F.flatten(F.transform(vocab.encode_labels(F.col("hyp"), _V), lambda i: F.array(i, F.lit(_V[vocab.PADDING]))))
    rows = _pairs(spark, sf_dir).select(F.floor(F.col("utt_id") / 8).alias("batch"), ids.alias("ids"), vocab.encode_labels(F.col("ref"), _V).alias("labels"))
    return vocab.batch_wer(vocab.pad_labels(rows, "batch"), _V, labels_col="padded").withColumn("wer", F.round("wer", 9))


def root_suffix(spark, sf_dir):
    rows = _words(spark, sf_dir).select("word").distinct().select("word", M.root_suffix(F.col("word")).alias("a"))
    return rows.select("word", F.col("a.root").alias("root"), F.array_join("a.suffixes", ",").alias("suffixes"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate over consecutive turns."""
    return wer_turns(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        normalize_documents, homoglyph_repair, digit_expand, abbreviation_expand, char_vocab, char_histogram, phonology, suffix_match, analyze_best, analyze_topk, gloss,
        root_frequency, tag_distribution, wer_turns, cer_turns, word_distances, align_ops, mwer_lexicon, mwer_breakdown, mwer_examples, ngram_counts, continuation_counts,
        discounts, context_stats, lm_score, perplexity, morpheme_sequences, ctc_greedy, ctc_beam, ctc_beam_lm, collate_labels, dataset_split,
        corpus_scan, paired_lines, prepared_test_split, vocab_file, transcript_file, lm_saved, lm_score_strict, build_lm_words, batch_metric, root_suffix,
    )
}

# a distance by a recursive walk over the rows of the matrix: one row of the relation for each reference item
_SQL_DISTANCE = """
walk AS (SELECT utt_id, 0 AS i, list_transform(range(0, len(h) + 1), lambda x: x::BIGINT) AS d, r, h FROM {0}
UNION ALL SELECT utt_id, i + 1, list_reduce(list_prepend([i + 1]::BIGINT[], list_transform(range(1, len(h) + 1), lambda j: [least(d[j + 1] + 1, d[j] + CASE WHEN h[j] = r[i + 1] THEN 0 ELSE 1 END)]::BIGINT[])), lambda acc, x: list_append(acc, least(x[1], acc[len(acc)] + 1))), r, h FROM walk WHERE i < len(r)),
dist AS (SELECT utt_id, d[len(d)] AS distance, len(r) AS n FROM walk WHERE i = len(r))"""

_SQL_SURFACES = B.sql_list(sorted({x.surface for x in S.SUFFIXES}))


def _sql_ops() -> str:
    """CTEs up to ``ops(utt_id, pos, ref, hyp, kind, cost)``.  DuckDB's distance counts bytes: each
    surface becomes one ASCII character."""
    spell = lambda x: f"CASE WHEN {x}.surf = '' THEN '' ELSE array_to_string(list_transform(string_split({x}.surf, ','), lambda s: chr((32 + list_position({_SQL_SURFACES}, s))::INT)), '') END"
    words = "SELECT a AS word FROM script WHERE op = 'sub' UNION SELECT b FROM script WHERE op = 'sub'"
    return f"""{_sql_costs()}, {_sql_analyses(words)}, best AS (SELECT * FROM parses WHERE rk = 1),
subs AS (SELECT s.*, x.root = y.root AS same, {spell('x')} AS ca, {spell('y')} AS cb FROM script s JOIN best x ON x.word = s.a JOIN best y ON y.word = s.b WHERE op = 'sub'),
ops AS (SELECT utt_id, pos, a AS ref, b AS hyp, CASE WHEN same THEN 'suffix' ELSE 'root' END AS kind, CASE WHEN same THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END + 0.35::DOUBLE * levenshtein(ca, cb) / greatest(length(ca), length(cb), 1) AS cost FROM subs
UNION ALL SELECT utt_id, pos, a, b, CASE op WHEN 'match' THEN 'exact' ELSE op END, CASE op WHEN 'match' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM script WHERE op <> 'sub')"""


def _sql_log_add(a: str, b: str) -> str:
    return f"(CASE WHEN greatest({a}, {b}) = '-inf'::DOUBLE THEN '-inf'::DOUBLE ELSE greatest({a}, {b}) + ln(1 + exp(least({a}, {b}) - greatest({a}, {b}))) END)"


def _sql_log_sum(x: str) -> str:
    return f"coalesce(list_max({x}) + ln(list_sum(list_transform({x}, lambda e: exp(e - list_max({x}))))), '-inf'::DOUBLE)"




def _sql_costs() -> str:
    """CTEs up to ``script(utt_id, op, a, b, pos)``: scripts are found by walking the distance matrix back."""
    return f"""{_sql_pairs()},
walk AS (SELECT utt_id, 0 AS i, list_transform(range(0, len(h) + 1), lambda x: x::BIGINT) AS d, r, h FROM pairs
UNION ALL SELECT utt_id, i + 1, list_reduce(list_prepend([i + 1]::BIGINT[], list_transform(range(1, len(h) + 1), lambda j: [least(d[j + 1] + 1, d[j] + CASE WHEN h[j] = r[i + 1] THEN 0 ELSE 1 END)]::BIGINT[])), lambda acc, x: list_append(acc, least(x[1], acc[len(acc)] + 1))), r, h FROM walk WHERE i < len(r)),
mat AS (SELECT utt_id, list(d ORDER BY i) AS m, any_value(r) AS r, any_value(h) AS h FROM walk GROUP BY utt_id),
back AS (SELECT utt_id, len(r) AS i, len(h) AS j, 0 AS k, '' AS op, NULL::VARCHAR AS a, NULL::VARCHAR AS b, m, r, h FROM mat
UNION ALL SELECT utt_id, CASE WHEN o IN ('match', 'sub', 'del') THEN i - 1 ELSE i END, CASE WHEN o IN ('match', 'sub', 'ins') THEN j - 1 ELSE j END, k + 1, o, CASE WHEN o <> 'ins' THEN r[i] END, CASE WHEN o <> 'del' THEN h[j] END, m, r, h
 FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND r[i] = h[j] THEN 'match' WHEN i > 0 AND j > 0 AND m[i + 1][j + 1] = m[i][j] + 1 THEN 'sub' WHEN i > 0 AND m[i + 1][j + 1] = m[i][j + 1] + 1 THEN 'del' ELSE 'ins' END AS o FROM back WHERE i > 0 OR j > 0) q),
script AS (SELECT utt_id, op, a, b, row_number() OVER (PARTITION BY utt_id ORDER BY k DESC) - 1 AS pos FROM back WHERE k > 0)"""


SQL = {
    "normalize_documents": f"SELECT doc_id, {_sql_normalize(B.sql_translit('text'))} AS normalized, len({_sql_words(_sql_normalize('text'))})::BIGINT AS n_words FROM documents",
    "homoglyph_repair": f"SELECT doc_id, {_sql_homoglyphs('lower(text)')} AS repaired FROM documents",
    "digit_expand": f"SELECT doc_id, {_sql_digits('lower(text)')} AS expanded FROM documents",
    "abbreviation_expand": f"SELECT doc_id, {_sql_abbreviations(B.sql_translit('text') + ' || $$ т.б. жыл.$$')} AS expanded FROM documents",
    "char_vocab": f"""WITH c AS (SELECT token FROM (SELECT unnest(string_split(replace({_sql_normalize(B.sql_translit('text'))}, ' ', ''), '')) AS token FROM documents) q WHERE token <> '' GROUP BY token HAVING count(*) >= 2),
e AS (SELECT 0 AS g, 0 AS o, token FROM c UNION ALL VALUES (1, 0, '|'), (1, 1, '[UNK]'), (1, 2, '[PAD]')) SELECT token, row_number() OVER (ORDER BY g, o, token) - 1 AS id FROM e""",
    "char_histogram": f"SELECT token, count(*) AS c FROM (SELECT unnest(string_split(replace({_sql_normalize(B.sql_translit('text'))}, ' ', ''), '')) AS token FROM documents) q WHERE token <> '' GROUP BY token",
    "phonology": f"SELECT word, {_sql_harmony('word')} AS harmony, {_sql_final('word')} AS final_class, contains('{P.ROUNDED}', lv) AND lv <> '' AS rounded, nullif(lv, '') AS last_vowel FROM (SELECT word, regexp_extract(word, '([{_VOWEL}])[^{_VOWEL}]*$', 1) AS lv FROM ({_SQL_WORDS}) q) q",
    "suffix_match": f"WITH w AS (SELECT DISTINCT word FROM ({_SQL_ALL_WORDS}) q), m AS (SELECT word, slot, surface, left(word, length(word) - length(surface)) AS stem, harmony, after FROM w JOIN {_SQL_SUFFIX} ON right(word, length(surface)) = surface AND length(word) > length(surface)) SELECT word, slot, surface, stem, {_sql_licensed('stem')} AS licensed FROM m",
    "analyze_best": f"WITH {_sql_analyses(_SQL_ALL_WORDS)} SELECT word, root, tags, chain, round(score, 6) AS score FROM parses WHERE rk = 1",
    "analyze_topk": f"WITH {_sql_analyses(_SQL_ALL_WORDS)} SELECT word, rk, root, tags, round(score, 6) AS score FROM parses WHERE rk <= 3",
    "gloss": f"WITH {_sql_analyses(_SQL_ALL_WORDS)} SELECT word, root || CASE WHEN tags = '' THEN '' ELSE '+' || replace(tags, ',', '+') END AS gloss FROM parses WHERE rk = 1",
    "root_frequency": f"WITH {_sql_analyses(_SQL_ALL_WORDS)}, c AS (SELECT word, count(*) AS c FROM ({_SQL_ALL_WORDS}) q GROUP BY word) SELECT root, sum(c)::BIGINT AS n, count(*) AS n_forms FROM c JOIN parses USING (word) WHERE rk = 1 GROUP BY root",
    "tag_distribution": f"WITH {_sql_analyses(_SQL_ALL_WORDS)} SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM ({_SQL_ALL_WORDS}) q JOIN parses USING (word) WHERE rk = 1 AND tags <> '') q GROUP BY tag",
    "wer_turns": f"WITH RECURSIVE {_SQL_TURNS}, t AS (SELECT utt_id, {_sql_words('ref')} AS r, {_sql_words('hyp')} AS h FROM turns), {_SQL_DISTANCE.format('t')} SELECT sum(distance)::BIGINT AS edits, sum(n)::BIGINT AS n_ref, round(sum(distance)::DOUBLE / sum(n), 9) AS wer FROM dist",
    # DuckDB's distance counts bytes: the characters of a pair are renamed to ASCII first
    "cer_turns": f"""WITH {_SQL_TURNS}, t AS (SELECT string_split(replace(ref, ' ', ''), '') AS r, string_split(replace(hyp, ' ', ''), '') AS h, list_distinct(string_split(ref || hyp, '')) AS u FROM turns),
e AS (SELECT array_to_string(list_transform(r, lambda c: chr((31 + list_position(u, c))::INT)), '') AS r, array_to_string(list_transform(h, lambda c: chr((31 + list_position(u, c))::INT)), '') AS h FROM t)
SELECT sum(levenshtein(r, h))::BIGINT AS edits, sum(length(r))::BIGINT AS n_ref, round(sum(levenshtein(r, h))::DOUBLE / sum(length(r)), 9) AS cer FROM e""",
    "word_distances": f"WITH RECURSIVE {_SQL_TURNS}, t AS (SELECT utt_id, {_sql_words('ref')} AS r, {_sql_words('hyp')} AS h FROM turns), {_SQL_DISTANCE.format('t')} SELECT utt_id, distance FROM dist",
    "align_ops": f"WITH RECURSIVE {_sql_costs()} SELECT utt_id, string_agg(op, ',' ORDER BY pos) AS ops, count(*) FILTER (WHERE op = 'match') AS n_match, count(*) FILTER (WHERE op = 'sub') AS n_sub, count(*) FILTER (WHERE op = 'del') AS n_del, count(*) FILTER (WHERE op = 'ins') AS n_ins FROM script GROUP BY utt_id",
    "mwer_breakdown": f"WITH RECURSIVE {_sql_ops()} SELECT kind, count(*) AS n, round(sum(cost), 6) AS cost FROM ops GROUP BY kind",
    "mwer_lexicon": f"""WITH RECURSIVE {_sql_ops()}, t AS (SELECT count(ref) AS n_ref_words, count(*) FILTER (WHERE kind = 'exact') AS exact, count(*) FILTER (WHERE kind = 'suffix') AS suffix_only, count(*) FILTER (WHERE kind = 'root') AS root_errors,
count(*) FILTER (WHERE kind = 'ins') AS insertions, count(*) FILTER (WHERE kind = 'del') AS deletions, sum(cost) AS c FROM ops)
SELECT round(c / n_ref_words, 6) AS m_wer, round((suffix_only + root_errors + insertions + deletions)::DOUBLE / n_ref_words, 6) AS wer_equivalent, n_ref_words, exact, suffix_only, root_errors, insertions, deletions, round(c, 6) AS total_cost FROM t""",
    "mwer_examples": f"WITH RECURSIVE {_sql_ops()} SELECT utt_id, pos, chr(39) || ref || chr(39) || ' -> ' || chr(39) || hyp || chr(39) || '  (root ok, suffix Δ, cost=' || printf('%.2f', cost) || ')' AS example FROM ops WHERE kind = 'suffix' ORDER BY utt_id, pos LIMIT 12",
    "morpheme_sequences": f"WITH {_sql_pairs()}, x AS (SELECT utt_id, i, r[i] AS word FROM (SELECT utt_id, r, unnest(range(1, len(r) + 1)) AS i FROM pairs) q), {_sql_analyses('SELECT word FROM x')} SELECT utt_id AS sent_id, string_agg(root || CASE WHEN tags = '' THEN '' ELSE ' ' || replace(tags, ',', ' ') END, ' ' ORDER BY i) AS tokens FROM x JOIN parses USING (word) WHERE rk = 1 GROUP BY utt_id",
    "ngram_counts": f"WITH {_SQL_SENTENCES}, {_sql_grams(_ORDER)} SELECT n::BIGINT AS n, array_to_string(ctx, ' ') AS ctx, word, c FROM grams",
    "continuation_counts": f"WITH {_SQL_SENTENCES}, {_sql_grams(_ORDER)}, {_SQL_CONT} SELECT n::BIGINT AS n, array_to_string(ctx, ' ') AS ctx, word, k FROM cont",
    "discounts": f"WITH {_SQL_SENTENCES}, {_sql_grams(_ORDER)}, {_SQL_DISC} SELECT n::BIGINT AS n, round(d1, 9) AS d1, round(d2, 9) AS d2, round(d3, 9) AS d3 FROM disc",
    "context_stats": f"WITH {_SQL_MODEL} SELECT n::BIGINT AS n, array_to_string(ctx, ' ') AS ctx, total, n1, n2, n3 FROM stats",
    "lm_score": f"WITH {_SQL_MODEL}, {_SQL_HELD}, {_sql_scores('SELECT id, word, ctx FROM hq', _ORDER)} SELECT id AS sent_id, count(*) AS n_tokens, round(sum(CASE WHEN p > 0 THEN ln(p) ELSE -30 END), 5) AS logp FROM scored GROUP BY id",
    "perplexity": f"WITH {_SQL_MODEL}, {_SQL_HELD}, {_sql_scores('SELECT id, word, ctx FROM hq', _ORDER)} SELECT round(exp(-sum(CASE WHEN p > 0 THEN ln(p) ELSE -30 END) / count(*)), 4) AS perplexity FROM scored",
    "corpus_scan": f"SELECT text, n_words FROM (SELECT text, len({_sql_words('text')})::BIGINT AS n_words FROM (SELECT {_sql_normalize('line')} AS text FROM (SELECT unnest(string_split_regex({B.sql_translit('text')}, '\\r\\n|\\n|\\r')) AS line FROM documents) q) q) q WHERE n_words > 0",
    "paired_lines": f"WITH {_SQL_TURNS} SELECT row_number() OVER (ORDER BY utt_id) - 1 AS utt_id, {_sql_normalize(B.sql_translit('ref'))} AS ref, {_sql_normalize(B.sql_translit('hyp'))} AS hyp FROM turns",
    "prepared_test_split": f"WITH {_sql_pairs()} SELECT utt_id AS file_name, array_to_string(r, ' ') AS text FROM pairs WHERE len(r) > 0 AND ('0x' || left(md5('42:' || utt_id::VARCHAR), 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < 0.1::DOUBLE",
    "vocab_file": f"""WITH c AS (SELECT DISTINCT token FROM (SELECT unnest(string_split(replace({_sql_normalize(B.sql_translit('text'))}, ' ', ''), '')) AS token FROM conversations) q WHERE token <> ''),
e AS (SELECT 0 AS g, 0 AS o, token FROM c UNION ALL VALUES (1, 0, '|'), (1, 1, '[UNK]'), (1, 2, '[PAD]')) SELECT token, row_number() OVER (ORDER BY g, o, token) - 1 AS id FROM e""",
    "transcript_file": f"WITH {_sql_pairs()} SELECT utt_id::VARCHAR || '.wav' AS name, array_to_string(h, ' ') AS text FROM pairs",
    "lm_saved": f"WITH {_SQL_MODEL}, {_SQL_HELD}, {_sql_scores('SELECT id, word, ctx FROM hq', _ORDER)} SELECT id AS sent_id, count(*) AS n_tokens, round(sum(CASE WHEN p > 0 THEN ln(p) ELSE -30 END), 5) AS logp FROM scored GROUP BY id",
    "lm_score_strict": f"WITH {_SQL_COUNTED}, {_sql_contexts(_ORDER, True)}, {_SQL_HELD}, {_sql_scores('SELECT id, word, ctx FROM hq', _ORDER, True)} SELECT id AS sent_id, count(*) AS n_tokens, round(sum(CASE WHEN p > 0 THEN ln(p) ELSE -30 END), 5) AS logp FROM scored GROUP BY id",
    "build_lm_words": f"WITH {_SQL_MODEL}, own AS (SELECT sent_id AS id, p[i] AS word, p[i - 2:i - 1] AS ctx FROM (SELECT sent_id, p, unnest(range(3, len(p) + 1)) AS i FROM (SELECT sent_id, list_concat(['<s>', '<s>'], list_concat(toks, ['</s>'])) AS p FROM sents) q) q), {_sql_scores('SELECT id, word, ctx FROM own', _ORDER)} SELECT round(exp(-sum(CASE WHEN p > 0 THEN ln(p) ELSE -30 END) / count(*)), 4) AS perplexity FROM scored",
    "batch_metric": f"WITH RECURSIVE {_sql_pairs()}, {_SQL_DISTANCE.format('pairs')} SELECT sum(distance)::BIGINT AS edits, sum(n)::BIGINT AS n_ref, round(sum(distance)::DOUBLE / sum(n), 9) AS wer FROM dist",
    "root_suffix": f"WITH {_sql_analyses(_SQL_ALL_WORDS)} SELECT word, root, surf AS suffixes FROM parses WHERE rk = 1",
    "ctc_greedy": f"""WITH {_SQL_FRAMES},
b AS (SELECT utt_id, t, list_position(lp, list_max(lp)) - 1 AS id FROM f), g AS (SELECT *, lag(id) OVER (PARTITION BY utt_id ORDER BY t) AS prev FROM b)
SELECT utt_id, trim(replace(coalesce(string_agg({B.sql_list(_SYMBOLS)}[id + 1], '' ORDER BY t) FILTER (WHERE id <> 0 AND (prev IS NULL OR id <> prev)), ''), '|', ' ')) AS text FROM g GROUP BY utt_id""",
    # a step of the recursion is a frame: each prefix and symbol contribute mass to one or two prefixes
    "ctc_beam": f"""WITH RECURSIVE {_SQL_FRAMES}, fr AS (SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY t) AS k, lp FROM f),
sy AS (SELECT utt_id, k, s, lp[s] AS p, {B.sql_list(_SYMBOLS)}[s] AS ch FROM (SELECT utt_id, k, lp, unnest(range(1, len(lp) + 1)) AS s FROM fr) q WHERE lp[s] > -12),
beam AS (SELECT DISTINCT utt_id, 0::BIGINT AS k, '' AS prefix, 0.0::DOUBLE AS pb, '-inf'::DOUBLE AS pn FROM fr
UNION ALL SELECT utt_id, k, prefix, pb, pn FROM (
 SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY {_sql_log_add('pb', 'pn')} DESC) AS rk FROM (
  SELECT utt_id, k, prefix, {_sql_log_sum("list(v) FILTER (WHERE b AND v > '-inf'::DOUBLE)")} AS pb, {_sql_log_sum("list(v) FILTER (WHERE NOT b AND v > '-inf'::DOUBLE)")} AS pn FROM (
   SELECT utt_id, k, c.prefix AS prefix, c.b AS b, c.v AS v FROM (
    SELECT x.utt_id, y.k, unnest(CASE WHEN s = 1 THEN [{{'prefix': prefix, 'b': true, 'v': {_sql_log_add('pb', 'pn')} + p}}]
     WHEN prefix <> '' AND ch = right(prefix, 1) THEN [{{'prefix': prefix, 'b': false, 'v': pn + p}}, {{'prefix': prefix || ch, 'b': false, 'v': pb + p}}]
     ELSE [{{'prefix': prefix || ch, 'b': false, 'v': {_sql_log_add('pb', 'pn')} + p}}] END) AS c FROM beam x JOIN sy y ON y.utt_id = x.utt_id AND y.k = x.k + 1) q) q
  GROUP BY utt_id, k, prefix) q) q WHERE rk <= 32),
last AS (SELECT utt_id, max(k) AS k FROM fr GROUP BY utt_id)
SELECT utt_id, rank, text, round(score, 9) AS score FROM (SELECT utt_id, (row_number() OVER (PARTITION BY utt_id ORDER BY score DESC))::INT AS rank, text, score FROM (
 SELECT utt_id, trim(replace(prefix, '|', ' ')) AS text, {_sql_log_add('pb', 'pn')} AS score FROM beam JOIN last USING (utt_id, k)) q) q WHERE rank <= 3""",
    "collate_labels": f"""WITH {_sql_pairs()}, l AS (SELECT utt_id, utt_id // 8 AS batch, array_to_string(r, ' ') AS ref, list_transform(string_split(array_to_string(r, '|'), ''), lambda c: list_position({B.sql_list(list(_V))}, c) - 1) AS labels FROM pairs),
m AS (SELECT *, max(len(labels)) OVER (PARTITION BY batch) AS most FROM l)
SELECT utt_id, array_to_string(list_concat(labels, list_transform(range(0, most - len(labels)), lambda x: -100)), ',') AS padded, ref AS decoded FROM m""",
    "dataset_split": f"WITH {_sql_pairs()} SELECT utt_id AS file_name, array_to_string(r, ' ') AS text, CASE WHEN ('0x' || left(md5('42:' || utt_id::VARCHAR), 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < 0.1::DOUBLE THEN 'test' ELSE 'train' END AS split FROM pairs WHERE len(r) > 0",
}
