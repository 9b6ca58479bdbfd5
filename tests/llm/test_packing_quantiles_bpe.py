"""Packing, percentile sketches and byte-pair encoding against brute force and round trips."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import bpe, packing, quantiles


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=120))
def test_assignment_is_whole_and_tight(sizes):
    home = packing.assign(np.array(sizes, dtype=np.int64), 100)
    used = {}
    for s, h in zip(sizes, home.tolist()):
        used[h] = used.get(h, 0) + s
    assert len(home) == len(sizes) and all(v <= 100 for v in used.values())
    lower = max(1, -(-sum(sizes) // 100)) if sizes else 0
    assert len(used) <= 2 * lower + 1


def test_pack(spark):
    rows = [(1, 5000, "x"), (2, None, "가나다라"), (3, 0, None), (4, -5, ""), (5, 2048, "x"), (6, 2049, "x"), (6, 2049, "x"), (None, 10, "x"), (7, 0, "abcdefgh")]
    df = spark.createDataFrame([(a, b, c, "clash") for a, b, c in rows], "id long, token_count int, content string, context_id string").coalesce(1)
    got = packing.pack_contents(df).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["id"], []).append(r["part_tokens"])
    assert sorted(parts[1]) == [904, 2048, 2048] and parts[2] == [3] and parts[3] == [0] and parts[4] == [0] and parts[5] == [2048]
    assert sorted(parts[6]) == [1, 1, 2048, 2048] and parts[None] == [10] and parts[7] == [2]
    used = {}
    for r in got:
        used[r["context_id"]] = used.get(r["context_id"], 0) + r["part_tokens"]
    assert max(used.values()) <= 2048
    assert packing.pack_contents(df.limit(0)).count() == 0


def test_fill_of_real_lengths(spark):
    rng = random.Random(1)
    sizes = [min(2048, int(rng.lognormvariate(5, 0.9)) + 1) for _ in range(30_000)]
    df = spark.createDataFrame([(i, s, None) for i, s in enumerate(sizes)], "id long, token_count int, content string").repartition(2)
    packed = packing.pack_contents(df)
    assert packed.count() == len(sizes)
    contexts = packed.select("context_id").distinct().count()
    assert sum(sizes) / (contexts * 2048) > 0.97


def exact(values, p):
    s = sorted(values)
    return s[math.floor(p / 100 * (len(s) - 1))]


def test_percentile_error_bound_and_merging(spark):
    rng = random.Random(2)
    values = [rng.lognormvariate(3, 2) * rng.choice([1, 1, 1, -1]) for _ in range(3000)] + [0.0] * 40 + [1e-12, -1e-12]
    rows = [("g", i % 3, v) for i, v in enumerate(values)] + [("g", 0, None), ("g", 1, float("nan")), ("g", 2, float("inf")), ("one", 0, 7.0), (None, 0, 2.0)]
    df = spark.createDataFrame(rows, "k string, day int, v double")
    parts = [quantiles.build_sketch(df.where(f"day = {d}"), ["k"], "v", 0.02) for d in range(3)]
    merged = quantiles.merge_sketches(parts, ["k"])
    whole = quantiles.build_sketch(df, ["k"], "v", 0.02)
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, whole.select(*merged.columns).collect()))
    got = {r["k"]: r for r in quantiles.read_percentiles(merged, ["k"], [1, 25, 50, 90, 99.9], 0.02).collect()}
    for p, name in ((1, "p1"), (25, "p25"), (50, "p50"), (90, "p90"), (99.9, "p99_9")):
        want = exact(values, p)
        assert abs(got["g"][name] - want) <= 0.02 * abs(want) + 1e-4
    assert got["g"]["n"] == len(values) and abs(got["one"]["p50"] - 7) <= 0.14 and None in got
    assert quantiles.read_percentiles(quantiles.build_sketch(df.limit(0), ["k"], "v"), ["k"], [50]).count() == 0


def test_each_trace_counts_once(spark):
    t = dt.datetime(2025, 3, 1, 12)
    rows = [("a", "2025-03-02", 5, t, "Answer ", {"total": 9.0}), ("a", "2025-03-01", 7, t, "/answer", {"total": 1.0, "rerank": None}), (None, "2025-03-01", 1, None, None, {"total": 2.0}), (None, "2025-03-01", 1, None, None, {"total": 2.0}), ("b", "2025-03-01", 2, t, "", None)]
    df = spark.createDataFrame(rows, "trace_id string, dt string, line_no long, trace_ts timestamp_ntz, endpoint string, timing_ms map<string,double>")
    got = sorted((r["endpoint"], r["span"], r["ms"]) for r in quantiles.span_values(df).where("ms is not null").collect())
    assert got == [("answer", "total", 1.0), ("unknown", "total", 2.0), ("unknown", "total", 2.0)]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.default_vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_ids_like_the_public_library(text):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(bpe.default_vocabulary()) if not hasattr(test_ids_like_the_public_library, "r") else test_ids_like_the_public_library.r
    test_ids_like_the_public_library.r = ranks
    if not hasattr(test_ids_like_the_public_library, "e"):
        test_ids_like_the_public_library.e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import regex

    got = bpe.encode_texts([text], bpe.WordIds(ranks), regex.compile(bpe.PATTERN).findall).to_pylist()[0]
    assert got == test_ids_like_the_public_library.e.encode_ordinary(text)


def test_short_and_long_merges_agree(ranks):
    rng = random.Random(3)
    for n in (1, 2, 3, 50, 191, 192, 193, 400, 900):
        word = "".join(rng.choice("abcdefghe가나다") for _ in range(n)).encode()
        assert bpe.merge_short(word, ranks) == bpe.merge_long(word, ranks)
        assert b"".join({v: k for k, v in ranks.items()}[i] for i in bpe.merge_long(word, ranks)) == word


def test_corpus(spark, ranks):
    texts = [(1, "hello <|endoftext|> 안녕"), (2, None), (3, ""), (4, " \n "), (4, " \n "), (None, "x" * 60_000), (6, "😀́​")]
    df = spark.createDataFrame([(a, b, [0]) for a, b in texts], "doc_id long, text string, ids array<int>")
    got = bpe.encode_corpus(df).collect()
    back = {v: k for k, v in ranks.items()}
    assert len(got) == len(texts)
    for r in got:
        text = {k: t for k, t in texts}[r["doc_id"]]
        assert b"".join(back[i] for i in r["ids"]).decode() == (text or "")
        assert 50256 not in r["ids"]
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_token_estimate(spark):
    row = spark.createDataFrame([("가나다라",), ("abcde",), ("",), (None,)], "t string").select(packing.text_tokens(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in row] == [3, 2, 0, 0]
