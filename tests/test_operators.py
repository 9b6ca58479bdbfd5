"""Lines, chunks, retrieval, context, verification, traces and index health on small tables."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import chunking, context, health, lines, retrieval, traces, verify


def windows_by_loop(text, window=800, overlap=150):
    if len(text) <= window:
        return [(0, len(text))]
    out, pos = [], 0
    while pos < len(text):
        end = pos + window
        if end < len(text):
            cut = max(text[pos:end].rfind(c) for c in "\n .")
            if cut > window // 2:
                end = pos + cut + 1
        out.append((pos, end))
        step = end - pos - overlap
        pos += step if step > 0 else window // 2
    return out


def test_window_spans(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("가나다 .\nx") if rng.random() < 0.2 else "가" for _ in range(n)) for n in (0, 1, 799, 800, 801, 3000, 9000)] + ["가" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, row in zip(texts, df.select(chunking.window_spans(F.col("t")).alias("s")).collect()):
        assert [(x["st"], x["en"]) for x in row["s"]] == windows_by_loop(t)


def test_heading_paths_like_a_stack(spark):
    rng = random.Random(2)
    rows = [(i, "#" * k + f" h{i}" if (k := rng.randint(0, 8)) in range(1, 7) else f"t{i}") for i in range(400)]
    got = {r["pos"]: r["heading_path"] for r in lines.heading_paths(spark.createDataFrame([(1, p, t) for p, t in rows], "d int, pos int, line string"), "d").collect()}
    stack = []
    for p, t in rows:
        if t[0] == "#":
            level = len(t) - len(t.lstrip("#"))
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, t.lstrip("# ")))
        assert got[p] == [h for _, h in stack]


def test_contents_list_and_cleaning(spark):
    text = "# 목차\n제1장 ··· 3\n## 안\n# 본문\n<!-- page:2 -->\n| a |\n|---|\n| x | y |\n|---|---|\n- 3 -\n\n| 하나 |\n끝\n####### 깊은"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    kept = lines.join_lines(lines.without_contents(lines.split_lines(df.where("t is not null"), "id", "t"), "id"), "id")
    assert {r["id"]: r["text"] for r in kept.collect()}[1].startswith("# 본문")
    clean = {r["id"]: r["text"] for r in chunking.cleaned_texts(df, "id", "t").collect()}
    assert "page:2" not in clean[1] and "- 3 -" not in clean[1] and "| 하나 |" not in clean[1] and "| x | y |" in clean[1] and clean[1].endswith("끝\n깊은")


def test_pages(spark):
    df = spark.createDataFrame([(1, "앞\n<!-- page:2 -->\n둘\n<!-- page:3 -->\n \n<!--page:4-->넷"), (2, None)], "id int, t string")
    assert [tuple(r) for r in lines.pages(df, "id", "t").orderBy("page").collect()] == [(1, 1, "앞"), (1, 2, "둘"), (1, 4, "넷")]


def test_adaptive_chunks(spark):
    long = "\n\n".join("문장 하나입니다. " * 20 for _ in range(12))
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'값' * 40} |" for i in range(100))
    text = f"머리말\n<!-- page:1 -->\n# A\n{long}\n## B\n앞\n{table}\n뒤\n# C\n"
    rows = chunking.adaptive_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t").orderBy("section", "part_index").collect()
    by_path = {p: list(g) for p, g in itertools.groupby(rows, key=lambda r: tuple(r["heading_path"]))}
    assert set(by_path) == {(), ("A",), ("A", "B")}
    assert all(len(r["content"]) <= 1500 for r in by_path["A",]) and [r["part_index"] for r in by_path["A",]] == list(range(1, len(by_path["A",]) + 1))
    kinds = [r["chunk_type"] for r in by_path["A", "B"]]
    assert kinds[0] == kinds[-1] == "text" and set(kinds[1:-1]) == {"table"}
    tables = [r["content"] for r in by_path["A", "B"] if r["chunk_type"] == "table"]
    assert all(t.startswith("| a | b |\n|---|---|\n") and len(t) <= 2400 for t in tables)
    assert [x for t in tables for x in t.split("\n")[2:]] == table.split("\n")[2:]


def test_short_tail_joins_even_beyond_the_limit(spark):
    df = spark.createDataFrame([("가" * 1190 + "\n\n" + "나" * 50,)], "t string")
    assert [len(p) for p in df.select(chunking.text_parts(F.col("t")).alias("p")).first()["p"]] == [1242]


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(120, 8))
    m[5] = 0
    m[7] = m[6]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(999, None)], "vec_id long, embedding array<double>").repartition(3)
    queries = rows.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["rank"]): r["row_id"] for r in retrieval.dense_topk(queries, rows, 4).collect()}
    u = m / np.where(np.linalg.norm(m, axis=1) == 0, 1, np.linalg.norm(m, axis=1))[:, None]
    for q in range(20):
        if q == 5:
            assert (q, 1) not in got
            continue
        scores = sorted(((-round(float(u[q] @ u[r]), 9), r) for r in range(120) if r != 5))[:4]
        assert [got[q, k + 1] for k in range(4)] == [r for _, r in scores]
    assert retrieval.dense_topk(queries.limit(0), rows, 4).count() == 0


def test_dense_by_length_and_with_nulls(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, None]), (5, []), (6, None), (7, [2.0, 0.0])], "vec_id long, embedding array<double>").repartition(3)
    queries = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["rank"]): r["row_id"] for r in retrieval.dense_topk(queries, rows, 2).collect()}
    assert got == {(1, 1): 1, (1, 2): 7, (2, 1): 2, (2, 2): 1, (3, 1): 3, (7, 1): 1, (7, 2): 7}


def bm25_by_loop(queries, rows, k, allowed=lambda q, r: True):
    words = {r: [t for t in re.split(r"[\W_]+", (x or "").lower()) if t] for r, x in rows.items()}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    out = {}
    for q, text in queries.items():
        asked = {t for t in re.split(r"[\W_]+", text.lower()) if t}
        score = {}
        for r, w in words.items():
            tf = Counter(w)
            s = sum(np.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in asked if tf[t])
            if s and allowed(q, r):
                score[r] = round(s, 6)
        out[q] = sorted(score, key=lambda r: (-score[r], r))[:k]
    return out


def test_bm25_against_a_loop(spark, monkeypatch):
    """With blocks of queries and of rows, repeated and empty texts, ties, and conditions on hits."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng = random.Random(15)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = {i: text(rng.randint(0, 25)) for i in range(90)} | {90: None, 91: "", 92: "w1 w1 w2", 93: "w1 w1 w2", 94: "w3 " * 3000}
    queries = {i: text(rng.randint(1, 4)) for i in range(20)} | {20: "", 21: "nothing here", 22: "w1 w2"}
    places = {r: ("a" if r % 3 else "b", f"d{r % 5}", r % 7 or None, r % 9) for r in rows}
    frame = spark.createDataFrame([(r, t, *places[r]) for r, t in rows.items()], "id long, content string, service_code string, document_id string, start_page int, end_page int").repartition(4)
    plain = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    got = {}
    for r in retrieval.bm25_topk(plain, frame, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["row_id"])
    expect = bm25_by_loop(queries, rows, 5)
    assert got == {q: r for q, r in expect.items() if r}
    conditions = {q: {"service_code": [None, "", "a"][q % 3], "document_id": "d1" if q % 4 == 0 else None, "start_page": 2 if q % 5 == 0 else None, "end_page": 5 if q % 2 else None, "include_keywords": ["w2"] if q % 7 == 0 else [], "exclude_keywords": ["w9"] if q % 3 == 1 else None} for q in queries}

    def allowed(q, r):
        c, (service, document, start, end), t = conditions[q], places[r], rows[r] or ""
        pages = (c["start_page"] is None or start is not None and start >= c["start_page"]) and (c["end_page"] is None or end is not None and end <= c["end_page"])
        return (not c["service_code"] or service == c["service_code"]) and (not c["document_id"] or document == c["document_id"]) and pages and all(w in t for w in c["include_keywords"]) and not any(w in t for w in c["exclude_keywords"] or [])

    asked = spark.createDataFrame([(q, t, tuple(conditions[q].values())) for q, t in queries.items()], f"query_id long, query string, filter {retrieval.FILTER}")
    got = {}
    for r in retrieval.bm25_topk(asked, frame, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["row_id"])
    assert got == {q: r for q, r in bm25_by_loop(queries, rows, 5, allowed).items() if r}
    assert retrieval.bm25_topk(plain.limit(0), frame, 5).count() == 0 and retrieval.bm25_topk(plain, frame.limit(0), 5).count() == 0


def test_exact_percentiles_without_a_buffer(spark):
    rng = np.random.default_rng(16)
    values = {"a": rng.lognormal(3, 2, 1000), "b": rng.normal(0, 5, 57), "c": np.r_[np.zeros(150), -np.ones(30)], None: rng.integers(0, 4, 400).astype(float), "d": np.array([7.0])}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    percents = (10, 25, 50, 75, 90, 99)
    for r in traces.grouped_percentiles(df, ["g"], "v", percents).collect():
        v = np.sort(values[r["g"]])
        assert r["n"] == len(v)
        for p in percents:
            expect = np.percentile(v, p) if len(v) >= 100 else v[min(len(v) - 1, int(len(v) * p / 100))]
            assert r[f"p{p}"] == pytest.approx(expect, abs=6e-5)
    whole = np.concatenate(list(values.values()))
    assert traces.grouped_percentiles(df, [], "v", (50,)).first()["p50"] == pytest.approx(np.percentile(whole, 50), abs=6e-5)
    assert traces.grouped_percentiles(df.limit(0), ["g"], "v", (50,)).count() == 0


def test_rrf_and_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, row_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, row_id long, rank int")
    assert [r["row_id"] for r in retrieval.fuse([a, b], 3).orderBy("rank").collect()] == [11, 10, 12]


def test_first_seen_union(spark):
    hits = spark.createDataFrame([(1, 1, 5, 1), (1, 1, 6, 2), (1, 2, 6, 1), (1, 2, 7, 2)], "query_id int, sub_no int, row_id int, rank int")
    assert [r["row_id"] for r in retrieval.first_seen(hits).orderBy("rank").collect()] == [5, 6, 7]


def test_retry_loop(spark):
    queries = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "none")], "query_id int, query string")

    def search(q):
        score = F.when(F.col("query") == "good", 0.9).otherwise(0.1)
        return q.where("query <> 'none'").select("query_id", F.lit(1).alias("row_id"), score.alias("score"), F.lit(1).alias("rank"))

    rewrite = lambda q, n: F.when((q == "bad") & (F.lit(n) == 1), "good").otherwise(q)
    got = {r["query_id"]: (r["attempt"], r["score"]) for r in retrieval.retry(queries, search, rewrite).collect()}
    assert got == {1: (0, 0.9), 2: (1, 0.9)}


def test_filter_rules(spark):
    rows = [(1, "A", "d", 1, 3, "가 나"), (2, "A", "d", None, None, "가"), (3, "B", "e", 2, 9, "나")]
    df = spark.createDataFrame(rows, "id int, service_code string, document_id string, start_page int, end_page int, content string")
    pick = lambda **k: {r["id"] for r in df.where(retrieval.build_filter(**k)).collect()}
    assert pick() == {1, 2, 3} and pick(service_code="") == {1, 2, 3} and pick(service_code="A") == {1, 2}
    assert pick(start_page=0) == {1, 3} and pick(end_page=3) == {1} and pick(include=["가"], exclude=["나"]) == {2}


def test_siblings_and_budget(spark):
    chunks = spark.createDataFrame([(i, "A", "d", "P", i, 7, f"p{i}") for i in range(1, 8)] + [(20, "A", "e", "P", 3, 7, "other"), (30, "A", "d", None, None, None, "lone")], "id int, service_code string, document_id string, heading_path string, part_index int, part_total int, content string")
    hits = chunks.where("id in (1, 4, 30)").select(F.lit(9).alias("query_id"), F.col("id").alias("chunk_id"), F.when(F.col("id") == 4, 1).otherwise(2).alias("rank"), "service_code", "document_id", "heading_path", "part_index", "part_total", "content")
    parts = context.sibling_window(hits, chunks)
    assert {r["chunk_id"] for r in parts.collect()} == {2, 3, 4, 5, 6, 30}
    text = context.group_sections(parts).first()["context"]
    assert text == "lone" + context.GLUE + "P\n\np2\n\np3\n\np4\n\np5\n\np6"
    df = spark.createDataFrame([(context.GLUE.join(["a" * 40, "b" * 4, "c" * 400]),)], "t string")
    fit = lambda most: df.select(context.fit_budget(F.col("t"), context.token_count(F.col("t")), F.lit(most)).alias("c")).first()["c"]
    assert fit(1000)["truncated"] is False
    assert fit(25)["text"] == "a" * 40 + context.GLUE + "b" * 4 and fit(3)["text"] == "b" * 4 and fit(1)["text"] == "aa"


def test_verification(spark):
    answers = spark.createDataFrame([(1, "g", "제1조에 따라 100만원"), (2, "g", "제9조에 따라 3개월"), (3, "g", "50만원이다"), (4, "g", "5회"), (5, "g", None)], "id int, grp string, content string")
    sources = spark.createDataFrame([(10, "g", "제1조 1,000,000원 90일"), (11, "g", "제8조")], "id int, grp string, content string")
    wrong = verify.unsupported(answers, sources, ["grp"], "id", "id")
    got = {r["answer_id"]: r["risk_level"] for r in verify.verdicts(answers, wrong, "id").collect()}
    assert got == {1: "pass", 2: "hard_fail", 3: "soft_fail", 4: "warn", 5: "pass"}


@pytest.mark.parametrize(
    ("missing", "value", "unit", "text", "kind"),
    [
        (["제42조"], None, None, "제43조", "generation_error"), (["제43조 제1항"], None, None, "제43조 제2항", "generation_error"), (["제43조"], None, None, "제43조 제1항", "generation_error"),
        (["제10조"], None, None, "제43조", "retrieval_gap"), ([], 1.2e7, "KRW", "1,000만원", "unit_error"), ([], 5e8, "KRW", "100만원", "minor"), ([], 30.0, "AGE", "31세", "minor"), ([], None, None, "", "minor"),
    ],
)
def test_failure(spark, missing, value, unit, text, kind):
    wrong = [(0, "x", unit, value)] if unit else []
    df = spark.createDataFrame([(missing, wrong, text)], "m array<string>, w array<struct<pos:int,original:string,unit:string,value:double>>, c string")
    row = df.select(verify.failure_type(F.col("m"), F.col("w"), F.col("c")).alias("k")).withColumn("n", F.lit(1)).first()
    assert row["k"] == kind
    hint = df.select(verify.hint(F.lit(kind), F.col("m"), F.col("w"), F.col("c")).alias("h")).first()["h"]
    assert bool(hint) == (kind in ("generation_error", "unit_error"))


@pytest.mark.parametrize("n", [1, 2, 99, 100, 101, 250])
def test_percentile_rules(spark, n):
    import statistics

    rng = random.Random(n)
    values = [round(rng.random(), 3) for _ in range(n)]
    row = traces.grouped_percentiles(spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v double"), ["g"], "v").first()
    s = sorted(values)
    for p in traces.PERCENTS:
        want = s[min(n - 1, int(n * p / 100))] if n < 100 else statistics.quantiles(s, n=100, method="inclusive")[p - 1]
        assert abs(row[f"p{p}"] - round(want, 4)) < 2e-4
    assert row["n"] == n


def test_histogram_edges(spark):
    got = [r["n"] for r in traces.histogram(spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.3, 0.95, 1.0, 7.0, None)], "v double"), "v").orderBy("bin").collect()]
    assert got == [2, 0, 1, 0, 0, 0, 0, 0, 0, 3] and len(got) == 10


def test_dispersion_against_pairs(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(40, 6)) + 1
    row = health.dispersion(spark.createDataFrame([([float(x) for x in v],) for v in m], "embedding array<double>").repartition(3)).first()
    u = m / np.linalg.norm(m, axis=1)[:, None]
    c = [u[i] @ u[j] for i, j in itertools.combinations(range(40), 2)]
    assert row["pairs"] == 780 and abs(row["mean"] - np.mean(c)) < 1e-6 and abs(row["stddev"] - np.std(c)) < 1e-6


def test_renumber(spark):
    df = spark.createDataFrame([(1, "d", "P", 1), (2, "d", "P", 2), (3, "d", None, 3), (4, "d", None, 4)], "id int, document_id string, heading_path string, seq int")
    got = {r["id"]: (r["part_index"], r["part_total"]) for r in chunking.renumber_parts(df, ["document_id"], ["seq"]).collect()}
    assert got == {1: (1, 2), 2: (2, 2), 3: (1, 1), 4: (1, 1)}


def test_images_find_their_places(spark):
    from paperloom.operators import merge

    schema = "service_code string, document_id string, id int, seq int, heading_path string, start_page int"
    base = spark.createDataFrame([("A", "d", 1, 1, "P", 1), ("A", "d", 2, 2, "P", 2), ("A", "d", 3, 3, "Q", 3), ("A", "d", 4, 4, None, None)], schema)
    images = spark.createDataFrame([("A", "d", 11, 1, "P", 9), ("A", "d", 12, 2, "", 2), ("A", "d", 13, 3, "nowhere", 1), ("A", "d", 14, 4, None, 7), ("A", "d", 15, 5, "P", 1), ("A", "d", 16, 6, None, None)], schema)
    got = [r["id"] for r in merge.merge_images(base, images, ["service_code", "document_id"]).orderBy("seq").collect()]
    assert got == [1, 2, 11, 15, 12, 3, 4, 13, 14, 16]
    assert merge.merge_images(base, images.limit(0), ["service_code", "document_id"]).count() == 4


def test_requests_and_tables(spark):
    from paperloom.functions import requests

    df = spark.createDataFrame([("<table><tr><th>a</th><th>b</th></tr><tr><td>1 <b>x</b></td></tr></table>",), ("<p>no</p>",), (None,)], "h string")
    got = [r[0] for r in df.select(requests.html_table(F.col("h"))).collect()]
    assert got == ["| a | b |\n| --- | --- |\n| 1 x |  |", "<p>no</p>", None]
    j = spark.createDataFrame([("가나 다", "가나다라"), ("", "x"), (None, None)], "a string, b string").select(requests.bigram_jaccard(F.col("a"), F.col("b")).alias("j"))
    assert [round(r["j"], 4) for r in j.collect()] == [0.6667, 0.0, 0.0]
    s = spark.createDataFrame([(0.9,), (0.7,), (0.4,), (0.399,)], "s double").select(requests.score_signal(F.col("s")).alias("s"))
    assert [r["s"] for r in s.collect()] == ["up", "up", "reformulated", "down"]


def test_answer_plan(spark):
    from paperloom.plans import answer

    chunks = spark.createDataFrame([(1, "A", "d", "P", 1, 1, "제1조 보험료 는 100만원이다"), (2, "A", "d", "Q", 1, 1, "제2조 기간은 30일이다")], "id long, service_code string, document_id string, heading_path string, part_index int, part_total int, content string")
    requests = spark.createDataFrame([(5, ("보험료 010-1234-5678", None, ["a@b.com"]))], "query_id long, request struct<query:string,include_keywords:array<string>,exclude_keywords:array<string>>")
    ready = answer.prepare(requests)
    row = ready.first()
    assert row["query"] == "보험료 [PHONE_MASKED]" and row["pii_kinds"] == ["EMAIL", "PHONE"] and row["route"]["query_type"] == "simple_fact"
    given = answer.contexts(answer.retrieve(ready, chunks, k=1), chunks, 500)
    asked = spark.createDataFrame([(5, ("보험료 제2조", ["기간"], None))], "query_id long, request struct<query:string,include_keywords:array<string>,exclude_keywords:array<string>>")
    assert [r["row_id"] for r in answer.retrieve(answer.prepare(asked), chunks, k=2).collect()] == [2]  # words asked for are a condition
    good = answer.answer(ready, given, lambda q, c: c).first()
    bad = answer.answer(ready, given, lambda q, c: F.lit("제2조에 따라 120만원")).first()
    assert good["risk_level"] == "pass" and bad["risk_level"] == "hard_fail" and bad["failure_type"] == "generation_error" and "제1조" in bad["hint"]
