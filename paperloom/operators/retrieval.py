"""Retrieval over tables: filters, exact vector search, BM25, rank fusion, reranking.

Queries are a table too. A search goes over all rows once per block of queries,
which is broadcast and whose size is fixed. Rows are scored a batch at a time,
and a task keeps the best k of its rows per query, so that what is shuffled does
not grow with the pairs of rows and queries that have something in common.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import cut

QUERY_BLOCK = 2048  # queries of one pass
ROW_BLOCK = 1024  # rows that are scored at a time
RRF_K, K1, B = 60, 1.2, 0.75
FILTER = "struct<service_code:string,document_id:string,start_page:int,end_page:int,include_keywords:array<string>,exclude_keywords:array<string>>"


def build_filter(
    service_code: str | None = None, document_id: str | None = None, start_page: int | None = None, end_page: int | None = None,
    include: list[str] | None = None, exclude: list[str] | None = None, content: str = "content",
) -> Column:
    """Conjunction of the given conditions; empty strings and lists are no condition, page 0 is one.

    Rows without pages fail a page condition.
    """
    parts = [F.lit(True)]
    if service_code:
        parts.append(F.col("service_code") == service_code)
    if document_id:
        parts.append(F.col("document_id") == document_id)
    if start_page is not None:
        parts.append(F.col("start_page") >= start_page)
    if end_page is not None:
        parts.append(F.col("end_page") <= end_page)
    parts += [F.col(content).contains(w) for w in include or []]
    parts += [~F.col(content).contains(w) for w in exclude or []]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def best(df: DataFrame, by: list[str], order: list[Column], k: int | Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in the given order, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


class _Best:
    """The best k rows of each query of a block, ties by row id."""

    def __init__(self, queries: int, k: int):
        self.k, self.q, self.r = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.s = np.zeros(0)
        self.least = np.full(queries, -np.inf)  # score of the k-th row, once there are k

    def add(self, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> None:
        """Take in scored pairs of query number and row id."""
        q, r, s = np.r_[self.q, q], np.r_[self.r, r], np.r_[self.s, s]
        order = np.lexsort((r, -s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        kept = place < self.k
        self.q, self.r, self.s, place = q[kept], r[kept], s[kept], place[kept]
        last = place == self.k - 1
        self.least[self.q[last]] = self.s[last]

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        """The pairs as a batch: q (query id), r, score."""
        return pa.RecordBatch.from_arrays([pa.array(ids[self.q], pa.int64()), pa.array(self.r, pa.int64()), pa.array(self.s, pa.float64())], names=["q", "r", "score"])


def _vectors(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the lists of a given length that have a direction."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), size), False).to_numpy(zero_copy_only=False))
    m = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), size)
    norm = np.linalg.norm(m, axis=1) if size else np.zeros(len(at))
    good = norm > 0
    return at[good], m[good] / norm[good, None]


def dense_topk(queries: DataFrame, rows: DataFrame, k: int = 10, query_id: str = "query_id", row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact cosine neighbours: query_id, row_id, score, rank (ties by row id).

    All rows are searched for every query. Null and zero vectors, and vectors
    with a null in them, have no direction and are left out on both sides; a
    query meets rows of its own length.
    """
    ready = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, math.ceil(ready.count() / QUERY_BLOCK))
    context = queries.sparkSession.sparkContext
    base = rows.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias("r"), F.col(vector).cast("array<double>").alias("v"))

    def search(block: int) -> DataFrame:
        part = ready.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).toArrow().combine_chunks()
        ids, groups = part.column("q").to_numpy(), []
        lists = part.column("v").combine_chunks()
        for size in sorted(x for x in pc.unique(pc.list_value_length(lists)).to_pylist() if x):
            at, unit = _vectors(lists, size)
            groups.append((size, ids[at], unit))
        shared = context.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [_Best(len(q), k) for _, q, _ in shared.value]
            for batch in batches:
                for a in range(0, batch.num_rows, ROW_BLOCK):
                    r, lists = batch.column(0).slice(a, ROW_BLOCK).to_numpy(), batch.column(1).slice(a, ROW_BLOCK)
                    for (size, _, unit), top in zip(shared.value, best):
                        at, m = _vectors(lists, size)
                        s = np.round(unit @ m.T, 9)
                        i, j = np.nonzero(s >= top.least[:, None])
                        top.add(i, r[at[j]], s[i, j])
            for (_, q, _), top in zip(shared.value, best):
                yield top.rows(q)

        return base.mapInArrow(run, "q long, r long, score double")

    found = reduce(DataFrame.unionAll, [search(b) for b in range(blocks)])
    top = best(found, ["q"], [F.desc("score"), F.asc("r")], k)
    return top.select(F.col("q").alias("query_id"), F.col("r").alias("row_id"), "score", "rank")


def terms(text: Column) -> Column:
    """Search terms: lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(rows: DataFrame, wanted: list[str], kept: list[str]) -> DataFrame:
    """row_id, len, codes, tf and the ``kept`` columns of rows with ``row_id`` and ``t`` (terms).

    ``codes`` are the places in ``wanted`` of the terms that a row has, ``tf``
    how often it has each.
    """
    shared = rows.sparkSession.sparkContext.broadcast(wanted)
    schema = f"row_id long, len int, codes array<int>, tf array<int>, {', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in kept)}".rstrip(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(shared.value, pa.string())
        for batch in batches:
            lists = batch.column(1)
            size = pc.list_value_length(lists).to_numpy()
            code = pc.index_in(lists.flatten().cast(pa.string()), value_set=values)
            owner = np.repeat(np.arange(len(size)), size)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            pair = owner[known] * len(values) + code.drop_null().to_numpy()
            pair, tf = np.unique(pair, return_counts=True)
            offsets = pa.array(np.searchsorted(pair, np.arange(len(size) + 1) * len(values)), pa.int32())
            codes, tfs = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pair % max(1, len(values)), tf))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), codes, tfs, *batch.columns[2:]], names=["row_id", "len", "codes", "tf", *kept])

    return rows.select("row_id", "t", *kept).mapInArrow(run, schema)


class _Asked:
    """A block of queries as arrays: ids, (term, query) pairs by term, and what filters ask."""

    def __init__(self, pairs: list[tuple[int, str]], filters: dict[int, dict]):
        self.ids = np.array(sorted({q for q, _ in pairs}), dtype=np.int64)
        self.terms = sorted({t for _, t in pairs})
        place = {t: i for i, t in enumerate(self.terms)}
        by_term: list[list[int]] = [[] for _ in self.terms]
        for q, t in pairs:
            by_term[place[t]].append(int(np.searchsorted(self.ids, q)))
        self.by_term = [np.array(sorted(set(x)), dtype=np.int64) for x in by_term]
        asked = [filters.get(int(q)) or {} for q in self.ids]
        self.equal = {c: np.array([f.get(c) or "" for f in asked], dtype=object) for c in ("service_code", "document_id")}
        self.low = np.array([np.nan if f.get("start_page") is None else f["start_page"] for f in asked], dtype=float)
        self.high = np.array([np.nan if f.get("end_page") is None else f["end_page"] for f in asked], dtype=float)
        self.words = [([w for w in f.get("include_keywords") or [] if w], [w for w in f.get("exclude_keywords") or [] if w]) for f in asked]
        self.worded = np.array([bool(a or b) for a, b in self.words], dtype=bool)

    def allowed(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        """Queries by rows: whether the row meets the query's conditions but for words."""
        ok = np.ones((len(self.ids), len(rows["start_page"])), dtype=bool)
        for c, wanted in self.equal.items():
            for value in set(wanted.tolist()) - {""}:
                ok[np.ix_(wanted == value, rows[c] != value)] = False
        with np.errstate(invalid="ignore"):
            ok &= np.isnan(self.low)[:, None] | (rows["start_page"][None, :] >= self.low[:, None])
            ok &= np.isnan(self.high)[:, None] | (rows["end_page"][None, :] <= self.high[:, None])
        return ok

    def has_words(self, i: np.ndarray, j: np.ndarray, texts: list[str | None]) -> np.ndarray:
        """For pairs of query and row: whether the row has the words asked for and none of those refused."""
        ok = np.ones(len(i), dtype=bool)
        for at in np.flatnonzero(self.worded[i]):
            include, exclude = self.words[i[at]]
            text = texts[j[at]]
            ok[at] = text is not None and all(w in text for w in include) and not any(w in text for w in exclude)
        return ok


def bm25_topk(queries: DataFrame, rows: DataFrame, k: int = 10, row_id: str = "id", text: str = "content", avg_len: float | None = None) -> DataFrame:
    """BM25 of every query against every row: query_id, row_id, score, rank (ties by row id).

    ``queries`` has query_id, query and optionally ``filter``, a struct like
    ``FILTER`` whose conditions a hit must meet (as in ``build_filter``). Terms
    that a query repeats count once. Length and frequencies are those of all
    rows; ``avg_len`` overrides the mean. Rows are taken apart into terms once
    per block of queries.
    """
    filtered = "filter" in queries.columns
    extra = {"service_code": "string", "document_id": "string", "start_page": "int", "end_page": "int"} if filtered else {}
    ready = queries.select(F.col("query_id").cast("long").alias("query_id"), F.array_distinct(terms(F.col("query"))).alias("t"), *(["filter"] if filtered else []))
    blocks = max(1, math.ceil(ready.count() / QUERY_BLOCK))
    context = queries.sparkSession.sparkContext
    split = rows.select(F.col(row_id).cast("long").alias("row_id"), terms(F.col(text)).alias("t"), *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()], *([F.col(text).alias("_text")] if filtered else []))

    def search(block: int) -> DataFrame:
        part = ready.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        asked = _Asked([(r["query_id"], t) for r in part for t in r["t"]], {r["query_id"]: r["filter"].asDict() for r in part if r["filter"]} if filtered else {})
        index = cut(postings(split, asked.terms, [*extra, *(["_text"] if filtered else [])]))
        whole = index.agg(F.count("*").alias("docs"), F.avg("len").alias("mean")).first()
        df = np.zeros(len(asked.terms))
        for r in index.select(F.explode("codes").alias("c")).groupBy("c").count().collect():  # at most the terms of the block
            df[r["c"]] = r["count"]
        mean = max(avg_len or whole["mean"] or 1.0, 1e-9)
        shared = context.broadcast((asked, np.log((whole["docs"] - df + 0.5) / (df + 0.5) + 1), filtered))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, idf, by_filter = shared.value
            top = _Best(len(asked.ids), k)
            for batch in batches:
                for a in range(0, batch.num_rows, ROW_BLOCK):
                    piece = batch.slice(a, ROW_BLOCK)
                    r, size = piece.column(0).to_numpy(), piece.column(1).to_numpy()
                    lists = piece.column(2)
                    code, tf = lists.flatten().to_numpy(), piece.column(3).flatten().to_numpy()
                    owner = np.repeat(np.arange(len(r)), pc.list_value_length(lists).to_numpy())
                    weight = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / mean))
                    score = np.zeros((len(asked.ids), len(r)))
                    order = np.argsort(code, kind="stable")
                    code, owner, weight = code[order], owner[order], weight[order]
                    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else []
                    for x, y in zip(starts, [*starts[1:], len(code)]):
                        score[np.ix_(asked.by_term[code[x]], owner[x:y])] += weight[x:y]
                    score = np.round(score, 6)
                    if by_filter:
                        attributes = {c: np.array(piece.column(4 + n).to_pylist(), dtype=object if n < 2 else float) for n, c in enumerate(("service_code", "document_id", "start_page", "end_page"))}
                        score[~asked.allowed(attributes)] = 0
                    i, j = np.nonzero((score > 0) & (score >= top.least[:, None]))
                    if by_filter:
                        ok = asked.has_words(i, j, piece.column(8).to_pylist())
                        i, j = i[ok], j[ok]
                    top.add(i, r[j], score[i, j])
            yield top.rows(asked.ids)

        return index.where("size(codes) > 0").mapInArrow(run, "q long, r long, score double")

    found = reduce(DataFrame.unionAll, [search(b) for b in range(blocks)])
    top = best(found, ["q"], [F.desc("score"), F.asc("r")], k)
    return top.select(F.col("q").alias("query_id"), F.col("r").alias("row_id"), "score", "rank")


def fuse(lists: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: query_id, row_id, score, rank."""
    points = [x.select("query_id", "row_id", (F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("p")) for x in lists]
    summed = reduce(DataFrame.unionAll, points).groupBy("query_id", "row_id").agg(F.round(F.sum("p"), 9).alias("score"))
    return best(summed, ["query_id"], [F.desc("score"), F.asc("row_id")], k).select("query_id", "row_id", "score", "rank")


def overlap_score(query: Column, content: Column) -> Column:
    """Stand-in for a reranking model: share of the query's terms that the content has."""
    q = F.array_distinct(terms(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, terms(content))) / F.size(q))


def rerank(hits: DataFrame, queries: DataFrame, rows: DataFrame, k: int, row_id: str, text: str, score: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """The best ``k`` hits by a pair score of (query, content); ties keep their order. ``score`` may wrap a model's pandas UDF."""
    pairs = hits.select("query_id", "row_id", F.col("rank").alias("_before")).join(queries.select("query_id", "query"), "query_id")
    pairs = pairs.join(rows.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("_text")), "row_id")
    scored = pairs.withColumn("score", F.round(score(F.col("query"), F.col("_text")), 6))
    return best(scored, ["query_id"], [F.desc("score"), F.asc("_before")], k).select("query_id", "row_id", "score", "rank")


def source_rows(hits: DataFrame, chunks: DataFrame, fused: DataFrame) -> DataFrame:
    """What a client gets of reranked hits, in order: chunk_id as text, document, pages, content, type, both scores, image_paths (null where there are none)."""
    body = chunks.select(
        F.col("id").cast("long").alias("row_id"), F.col("id").cast("string").alias("chunk_id"), "document_id", F.array("start_page", "end_page").alias("page_range"), "content", "chunk_type",
        F.when(F.size("image_paths") > 0, F.col("image_paths")).alias("image_paths"),
    )
    scores = fused.select("query_id", "row_id", F.round("score", 4).alias("rrf_score"))
    rows = hits.select("query_id", "row_id", "rank", F.round("score", 4).alias("rerank_score")).join(body, "row_id").join(scores, ["query_id", "row_id"], "left")
    return rows.select("query_id", "rank", "chunk_id", "document_id", "page_range", "content", "chunk_type", "rrf_score", "rerank_score", "image_paths")


def first_seen(hits: DataFrame) -> DataFrame:
    """Union of subqueries' hits, each row once with its best place: query_id, row_id, rank over (sub_no, rank)."""
    once = hits.groupBy("query_id", "row_id").agg(F.min(F.struct("sub_no", "rank")).alias("_at"))
    return once.select("query_id", "row_id", F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "row_id")).alias("rank"))


def passes_gate(hits: DataFrame, queries: DataFrame, threshold: float = 0.3) -> DataFrame:
    """query_id, best, passed: whether a query's best score reaches the threshold; no hits do not."""
    top = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(top, "query_id", "left").withColumn("passed", F.coalesce(F.col("best") >= threshold, F.lit(False)))


def retry(queries: DataFrame, search: Callable[[DataFrame], DataFrame], rewrite: Callable[[Column, int], Column], threshold: float = 0.3, most: int = 2) -> DataFrame:
    """Search, then search again with rewritten queries where the best score is too low, at most ``most`` times.

    Returns the hits of each query's last attempt with ``attempt`` from 0. The
    route of a query is not changed by rewriting.
    """
    left, done = queries, []
    for attempt in range(most + 1):
        hits = search(left).withColumn("attempt", F.lit(attempt))
        gate = passes_gate(hits, left, threshold)
        if attempt == most:
            return reduce(DataFrame.unionByName, [*done, hits])
        done.append(hits.join(gate.where("passed").select("query_id"), "query_id", "left_semi"))
        left = left.join(gate.where("not passed").select("query_id"), "query_id", "left_semi").withColumn("query", rewrite(F.col("query"), attempt + 1))
    return hits
