import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tilspark.llm import op8_byte_bpe as op8

from .test_operators import LOWER, brute_quality, linked

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, docs, rows, tmp_path):
    docs.select("doc_id", "text", "source", "lang", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == at.columns
        out.write.parquet(str(tmp_path / name))
        at = seen[name] = spark.read.parquet(str(tmp_path / name))
    texts = {i: t for i, t in rows if brute_quality(t)[-1]}
    assert sorted(r["doc_id"] for r in seen["quality_rules"].collect()) == sorted(texts)
    first, kept = {}, {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i in sorted(texts):
        lines = texts[i].split("\n")
        kept[i] = "\n".join(x for x in lines if len(key(x)) < 10 or first.setdefault(key(x), i) == i)
    assert {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"].collect())
    one = set(linked(list(kept.items())).values())
    assert {r["doc_id"] for r in seen["jaccard_join"].collect()} == one
    mixed = [r["doc_id"] for r in seen["mix_sources"].collect()]
    # each document as often as the inverted Poisson distribution of its source's mean says
    source = {i: f"s{i % 3}" if i % 7 else None for i in one}
    sizes = defaultdict(int)
    for i in one:
        sizes[source[i]] += len(kept[i])
    weights = {x: z**0.5 if z else 0.0 for x, z in sizes.items()}
    want = Counter()
    for i in one:
        z = sizes[source[i]]
        mean = weights[source[i]] / sum(weights.values()) * sum(sizes.values()) / z if z else 0.0
        u, p, k = int(hashlib.md5(f"17:{i}:1".encode()).hexdigest()[:13], 16) / 2.0**52, math.exp(-mean), 0
        total = p
        while mean and u >= total:
            k += 1
            p *= mean / k
            total += p
        want[i] = k
    assert Counter(mixed) == +want
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op8.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in seen["byte_bpe"].collect())
    ids = {i: np.array(lib.encode_ordinary(kept[i]), "<u4") for i in set(mixed)}
    assert got == sorted((i, len(ids[i]), ids[i].tobytes()) for i in mixed)
    assert pipeline.run(spark, str(tmp_path)).count() == len(mixed)
