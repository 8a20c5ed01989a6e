import random

import pytest

COMMON = " ".join(f"shared{k}" for k in range(60))


def texts() -> list[str | None]:
    """Small texts with all the cases: null, empty, blank, long, copies, near copies, shared passages,
    repeated lines, periodic filler, other scripts."""
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    out: list[str | None] = [None, "", " \n\t ", "One two", "one TWO", "one\x0btwo three"]
    base = [say(rng.randint(60, 200)) for _ in range(12)]
    out += base
    out += [base[0], base[0], base[1] + " tail", "head " + base[2]]
    for b in base[3:6]:  # near copies of growing distance
        w = b.split()
        for k in (1, 2, 4, 9):
            c = list(w)
            for p in rng.sample(range(len(c)), k):
                c[p] = f"edit{k}x{p}"
            out.append(" ".join(c))
    out += [say(30) + " " + COMMON + " " + say(30) for _ in range(8)]
    out += [COMMON, COMMON + " " + COMMON]
    out += ["\n".join([say(8), "A line that Many hold", say(9), "  a LINE that many hold\t", "short", say(3)]) for _ in range(6)]
    out += ["ab " * 500, "ab " * 180, "x" * 700, "x" * 199, "é漢 \U0001f600 " * 60, say(6000), "don't  we'll\n\n '  tis <|endoftext|> 12½ ##$$ é"]
    # a sequence and its complement: polynomials modulo a power of two take them for equal
    morse = [bin(k).count("1") % 2 for k in range(1024)]
    for a, b in (("a", "b"), ("b", "a")):
        one = "".join((a, b)[k] for k in morse)
        out += [one, " ".join(("one" + a, "two" + b)[k] for k in morse), f"{one}\n{one[::-1]} {a}\n{one[1:]}"]
    return out


@pytest.fixture(scope="session")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The texts with a repeated row, and columns whose names the operators use themselves."""
    data = [(i, t, f"s{i % 3}" if i % 7 else None, "en", None if t is None else len(t), i, "x", 1) for i, t in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long, size long, kept string, th int")
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
