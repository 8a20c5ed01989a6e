"""Morphological analysis of words: a root and an ordered chain of suffixes.

The search is one narrow projection: arrays of open parses grow slot by slot inside higher-order
functions, so analysing a word neither joins nor shuffles.  An analysis depends on the word alone:
``analyze_words`` runs over distinct words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonology as P
from ..functions.suffixes import CHAINS, SUFFIXES


@dataclass(frozen=True)
class Segmenter:
    min_root_len: int = 2
    lambda_seg: float = 0.35
    lambda_len: float = 0.08
    unlicensed_penalty: float = 0.9
    licensed_bonus: float = 1.0
    beam_size: int = 8


_STATE = "struct<stem:string,score:double,morphemes:array<struct<surface:string,tag:string,licensed:boolean>>,scores:array<double>,options:array<int>>"
#: more open parses than this never arise, so wider beams prune nothing
_MOST_PARSES = 7


def licensed(stem: Column, harmony: Column, after: Column) -> Column:
    """May the suffix follow the stem: harmony and final sound agree, where it asks for them."""
    return (harmony.isNull() | (harmony == P.harmony_class(stem))) & ((F.size(after) == 0) | F.array_contains(after, P.final_class(stem)))


def _slot_map(slot: str) -> tuple[Column, str, int]:
    rows = [s for s in SUFFIXES if s.slot == slot]
    value = lambda s: F.struct(F.lit(s.harmony).cast("string").alias("harmony"), F.array(*[F.lit(a) for a in s.after]).cast("array<string>").alias("after"))
    return F.create_map(*[x for s in rows for x in (F.lit(s.surface), value(s))]), rows[0].tag, max(len(s.surface) for s in rows)


def _peel(states: Column, slot: str, seg: Segmenter) -> Column:
    """All states that skip the slot or take off one of its suffixes, longest first."""
    table, tag, longest = _slot_map(slot)

    def state(stem, score, morphemes, s, option):
        return F.struct(stem.alias("stem"), score.alias("score"), morphemes.alias("morphemes"), F.array_append(s["scores"], score).alias("scores"), F.array_append(s["options"], option).alias("options"))

    def options(s: Column) -> Column:
        # each step binds its values once for the next
        tails = F.transform(F.array(*[F.lit(n) for n in range(longest, 0, -1)]), lambda n: F.struct(n.alias("n"), F.right(s["stem"], n).alias("surface"), F.left(s["stem"], F.length(s["stem"]) - n).alias("stem")))
        tails = F.filter(tails, lambda t: (F.length(t["stem"]) >= max(1, seg.min_root_len)) & (F.length(t["surface"]) == t["n"]) & F.map_contains_key(table, t["surface"]))
        tails = F.transform(tails, lambda t: F.struct(t.alias("t"), F.element_at(table, t["surface"]).alias("e")))
        tails = F.transform(tails, lambda t: F.struct(t["t"].alias("t"), licensed(t["t"]["stem"], t["e"]["harmony"], t["e"]["after"]).alias("ok")))
        gain = lambda t: F.when(t["ok"], F.lit(seg.licensed_bonus)).otherwise(F.lit(-seg.unlicensed_penalty)) - F.lit(seg.lambda_seg)
        tails = F.transform(tails, lambda t: F.struct(t["t"].alias("t"), t["ok"].alias("ok"), (s["score"] + gain(t)).alias("score")))
        # suffixes come off the end: the inner ones go to the front
        morpheme = lambda t: F.struct(t["t"]["surface"].alias("surface"), F.lit(tag).alias("tag"), t["ok"].alias("licensed"))
        taken = F.transform(tails, lambda t: state(t["t"]["stem"], t["score"], F.array_prepend(s["morphemes"], morpheme(t)), s, longest + 1 - t["t"]["n"]).cast(_STATE))
        skip = state(s["stem"], s["score"], s["morphemes"], s, F.lit(0)).cast(_STATE)
        return F.concat(F.array(skip), taken)

    found = F.flatten(F.transform(states, options))
    if seg.beam_size < _MOST_PARSES:
        ranked = F.array_sort(F.transform(found, lambda x, i: F.struct((-x["score"]).alias("worst"), i.alias("i"), x.alias("x"))))
        found = F.transform(F.slice(ranked, 1, seg.beam_size), lambda r: r["x"])
    return found


def _deficit(root: Column, seg: Segmenter) -> Column:
    return F.greatest(F.lit(0), seg.min_root_len + 1 - F.length(root)) + F.when(root.rlike(f"[{P.VOWELS}]"), 0).otherwise(2)


def clean_word(word: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(word, F.lit("")), r"(?U)^\s+|\s+$", ""))


def analyses(word: Column, seg: Segmenter = Segmenter(), top_k: int = 1) -> Column:
    """``array<struct<root, morphemes, chain, score>>``, best first."""
    word = clean_word(word)
    start = F.array(F.struct(word.alias("stem"), F.lit(0.0).alias("score"), F.array().cast("array<struct<surface:string,tag:string,licensed:boolean>>").alias("morphemes"), F.array().cast("array<double>").alias("scores"), F.array().cast("array<int>").alias("options")).cast(_STATE))
    found = []
    for order, (chain, slots) in enumerate(CHAINS.items()):
        states = F.filter(reduce(lambda s, slot: _peel(s, slot, seg), reversed(slots), start), lambda s: F.size(s["morphemes"]) > 0)
        found.append(F.transform(states, lambda s: _ranked(s["score"] - F.lit(seg.lambda_len) * _deficit(s["stem"], seg), order, s["scores"], s["options"], s["stem"], s["morphemes"], chain)))
    bare = F.when(word.rlike(f"[{P.VOWELS}]"), 0.15).otherwise(-0.2) - F.lit(seg.lambda_len) * _deficit(word, seg)
    none = F.array().cast("array<struct<surface:string,tag:string,licensed:boolean>>")
    zeros, no_options = F.array(*[F.lit(0.0)] * 3), F.array(*[F.lit(0)] * 3)
    every = F.concat(*found, F.array(_ranked(bare, len(CHAINS), zeros, no_options, word, none, "root")))
    if top_k == 1:
        return F.array(F.array_max(every)["a"])
    ranked = F.reverse(F.array_sort(every))
    # of parses with one root and one row of tags, the first stays
    key = lambda x: F.concat_ws("+", F.array(x["root"]), F.transform(x["morphemes"], lambda m: m["tag"]))
    add = lambda kept, x: F.when(F.exists(kept, lambda k: key(k) == key(x["a"])), kept).otherwise(F.array_append(kept, x["a"]))
    return F.slice(F.aggregate(ranked, F.filter(F.transform(ranked, lambda x: x["a"]), lambda x: F.lit(False)), add), 1, top_k)


def _ranked(final: Column, order: int, scores: Column, options: Column, root: Column, morphemes: Column, chain: str) -> Column:
    """A parse behind its place in the order: score, chain, inner scores, then the earlier option."""
    return F.struct(
        final.alias("final"), F.lit(-order).alias("chain"), F.reverse(scores).alias("scores"), F.transform(options, lambda o: -o).alias("options"),
        F.struct(root.alias("root"), morphemes.alias("morphemes"), F.lit(chain).alias("chain"), final.alias("score")).alias("a"),
    )


def best(word: Column, seg: Segmenter = Segmenter()) -> Column:
    return F.element_at(analyses(word, seg), 1)


def root_suffix(word: Column, seg: Segmenter = Segmenter()) -> Column:
    """``struct<root, suffixes>`` of a word's best analysis, suffixes from the root outward."""
    # bound once, taken apart after
    return F.element_at(F.transform(analyses(word, seg), lambda a: F.struct(a["root"].alias("root"), suffix_chain(a).alias("suffixes"))), 1)


def tags(analysis: Column) -> Column:
    return F.transform(analysis["morphemes"], lambda m: m["tag"])


def suffix_chain(analysis: Column) -> Column:
    return F.transform(analysis["morphemes"], lambda m: m["surface"])


def gloss(analysis: Column) -> Column:
    return F.concat_ws("+", F.array(analysis["root"]), tags(analysis))


def morpheme_tokens(analysis: Column) -> Column:
    """The word's tokens in a morpheme language model: root, then tags."""
    return F.concat(F.array(analysis["root"]), tags(analysis))


def analyze_words(words: DataFrame, seg: Segmenter = Segmenter(), *, word_col: str = "word") -> DataFrame:
    """``word, analysis`` of each distinct word: the one shuffle is the distinct."""
    return words.select(F.col(word_col).alias("word")).distinct().withColumn("analysis", best(F.col("word"), seg))


def suffix_matches(words: DataFrame, suffixes: DataFrame, *, word_col: str = "word") -> DataFrame:
    """``word, slot, surface, stem, licensed`` of every suffix that ends a word: an equi-join on the
    word's tails with the (80-row) suffix table."""
    tails = words.select(F.col(word_col).alias("word")).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where(F.length("word") > F.col("n"))
    tails = tails.select("word", F.right("word", F.col("n")).alias("surface"), F.expr("left(word, length(word) - n)").alias("stem"))
    out = tails.join(F.broadcast(suffixes), "surface")
    return out.select("word", "slot", "surface", "stem", licensed(F.col("stem"), F.col("harmony"), F.col("after")).alias("licensed"))


def local_tokens(word: str, seg: Segmenter = Segmenter()) -> list[str]:
    """``morpheme_tokens`` of one word in plain Python, for decoders inside workers.  Options rank as in
    ``analyses``: a skipped slot (0) first, then longer suffixes (-6) before shorter ones (-8)."""
    word = word.strip().lower()

    def cls(stem: str) -> str:
        last = stem[-1:]
        return "vowel" if not last or last in P.VOWELS else "voiceless" if last in P.VOICELESS else "sonorant" if last in P.SONORANT else "voiced"

    def harmony(stem: str) -> str:
        firm = [c for c in stem if c in P.FRONT + P.BACK]
        soft = [c for c in stem if c in P.NEUTRAL]
        return ("front" if firm[-1] in P.FRONT else "back") if firm else "front" if soft and soft[-1] in "иё" else "back"

    def deficit(root: str) -> int:
        return max(0, seg.min_root_len + 1 - len(root)) + (0 if any(c in P.VOWELS for c in root) else 2)

    bare = (0.15 if any(c in P.VOWELS for c in word) else -0.2) - seg.lambda_len * deficit(word)
    best = ((bare, -len(CHAINS), (0.0,) * 3, (0,) * 3), [word])
    for order, slots in enumerate(CHAINS.values()):
        states = [(word, 0.0, [], (), ())]
        for slot in reversed(slots):
            new = []
            for stem, score, found, scores, options in states:
                new.append((stem, score, found, (*scores, score), (*options, 0)))
                for s in sorted((s for s in SUFFIXES if s.slot == slot), key=lambda s: -len(s.surface)):
                    rest = stem[: len(stem) - len(s.surface)]
                    if len(rest) < max(1, seg.min_root_len) or not stem.endswith(s.surface):
                        continue
                    ok = s.harmony in (None, harmony(rest)) and (not s.after or cls(rest) in s.after)
                    value = score + ((seg.licensed_bonus if ok else -seg.unlicensed_penalty) - seg.lambda_seg)
                    new.append((rest, value, [s.tag, *found], (*scores, value), (*options, len(s.surface) - 9)))
            states = sorted(new, key=lambda x: -x[1])[: seg.beam_size] if seg.beam_size < _MOST_PARSES else new
        for stem, score, found, scores, options in states:
            if found:
                key = (score - seg.lambda_len * deficit(stem), -order, tuple(reversed(scores)), options)
                if key > best[0]:
                    best = (key, [stem, *found])
    return best[1]
