"""From requests to checked answers: one lazy plan, models as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import guards, routing
from paperloom.operators import context, retrieval, verify
from paperloom.session import cut


PREFETCH, DEEPEST = 3, 8  # hits that are reranked and hits of a list at most, as multiples of k


def prepare(requests: DataFrame) -> DataFrame:
    """Guarded and routed requests: query_id, query, filter, kinds and threats found, route. ``requests`` has query_id and a request struct."""
    safe = guards.guard_request(F.col("request.query"), F.col("request.include_keywords"), F.col("request.exclude_keywords"))
    rows = requests.select("query_id", "request", safe.alias("g"))
    has = requests.schema["request"].dataType.names
    conditions = [F.col(f"request.{c}") if c in has else F.lit(None) for c in ("service_code", "document_id", "start_page", "end_page")]
    asked = F.struct(*conditions, "g.include_keywords", "g.exclude_keywords")
    return rows.select("query_id", "g.query", asked.cast(retrieval.FILTER).alias("filter"), "g.pii_kinds", "g.threats").withColumn("route", routing.classify(F.col("query")))


def _fused(queries: DataFrame, chunks: DataFrame, k: int, vectors: DataFrame | None, query_vectors: DataFrame | None) -> DataFrame:
    """Word and vector lists, each as deep as the query's route says, fused."""
    depth = queries.select("query_id", F.col("route.bm25_factor").alias("_words"), F.col("route.dense_factor").alias("_vectors"))
    lists = [(retrieval.bm25_topk(queries, chunks, DEEPEST * k), "_words")]
    if vectors is not None and query_vectors is not None:
        lists.append((retrieval.dense_topk(query_vectors, vectors, DEEPEST * k), "_vectors"))
    cut_lists = [x.join(depth, "query_id").where(F.col("rank") <= F.col(factor) * k).select("query_id", "row_id", "score", "rank") for x, factor in lists]
    return retrieval.fuse(cut_lists, PREFETCH * k)


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = 10, score: Callable[[Column, Column], Column] = retrieval.overlap_score) -> DataFrame:
    """Hits of routed queries: words and (where given) vectors, fused and reranked: query_id, row_id, score, rank."""
    return retrieval.rerank(_fused(queries, chunks, k, vectors, query_vectors), queries, chunks, k, "id", "content", score)


def compare(queries: DataFrame, chunks: DataFrame, k: int = 10, vectors: DataFrame | None = None, side_vectors: DataFrame | None = None, score: Callable[[Column, Column], Column] = retrieval.overlap_score) -> DataFrame:
    """Hits of comparisons: each side is searched alone in both lists, hits are united by first sight and reranked with the whole query.

    ``side_vectors`` has query_id, sub_no and embedding.
    """
    sides = queries.select("*", F.posexplode(routing.decompose(F.col("query"))).alias("sub_no", "part"))
    parts = sides.select((F.col("query_id") * 2 + F.col("sub_no")).alias("query_id"), F.col("part").alias("query"), "route", *[c for c in ("filter",) if c in queries.columns])
    if side_vectors is not None:
        side_vectors = side_vectors.select((F.col("query_id") * 2 + F.col("sub_no")).alias("query_id"), "embedding")
    hits = _fused(parts, chunks, max(k // 2, 3), vectors, side_vectors)
    hits = hits.select(F.shiftright("query_id", 1).alias("query_id"), F.col("query_id").bitwiseAND(1).alias("sub_no"), "row_id", "rank")
    return retrieval.rerank(retrieval.first_seen(hits), queries, chunks, k, "id", "content", score)


def search(queries: DataFrame, chunks: DataFrame, k: int = 10, rewrite: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """Hits of prepared requests: comparisons side by side, others whole, and again with a rewritten query where the best score is low."""

    def once(asked: DataFrame) -> DataFrame:
        two = (F.col("route.query_type") == "comparison") & routing.decompose(F.col("query")).isNotNull()
        return compare(asked.where(two), chunks, k).unionByName(retrieve(asked.where(~F.coalesce(two, F.lit(False))), chunks, k=k))

    return once(queries) if rewrite is None else retrieval.retry(queries, once, rewrite)


def second_attempt(answers: DataFrame, generate: Callable[[Column, Column, Column], Column], check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers after the second opinion: failures that a hint can mend are generated again, others are escalated or let pass.

    ``answers`` has query_id, query, context, answer, risk_level, failure_type
    and hint; ``generate`` makes an answer from (query, context, hint) and
    ``check`` gives query_id and risk_level of answers. Adds invoked,
    action_taken (regenerate, escalate, pass), before_risk, after_risk and
    improved; a second answer is kept whatever its risk, as there is no third.
    """
    bad = F.col("risk_level").isin("hard_fail", "soft_fail")
    kind = F.col("failure_type")
    action = F.when(bad & kind.isin("generation_error", "unit_error"), "regenerate").when(bad & kind.isin("retrieval_gap", "semantic_mismatch"), "escalate").when(bad, "pass")
    judged = answers.withColumn("invoked", F.coalesce(bad, F.lit(False))).withColumn("action_taken", action).withColumn("before_risk", F.when(bad, F.col("risk_level")))
    again = judged.where("action_taken = 'regenerate'").withColumn("answer", guards.sanitize_output(guards.strip_think(generate(F.col("query"), F.col("context"), F.col("hint"))))["cleaned"])
    again = cut(again)
    after = check(again).select("query_id", F.col("risk_level").alias("after_risk"))
    again = again.join(after, "query_id").withColumn("risk_level", F.col("after_risk")).withColumn("improved", F.col("after_risk") == "pass")
    kept = judged.where("action_taken is null or action_taken <> 'regenerate'").withColumn("after_risk", F.col("before_risk")).withColumn("improved", F.lit(None).cast("boolean"))
    return kept.unionByName(again)


def responses(answers: DataFrame, sources: DataFrame, cited: DataFrame, records: DataFrame) -> DataFrame:
    """What is sent back: query_id, answer, sources, citations, verification, escalation_required, is_refusal; what does not apply is null.

    ``answers`` come from ``second_attempt``, ``sources`` from
    ``retrieval.source_rows``, ``cited`` and ``records`` from ``verify``.
    """
    listed = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id", "rerank_score"))).alias("sources"))
    told = records.select(F.col("answer_id").alias("query_id"), "groundedness", "warnings")
    rows = answers.join(listed, "query_id", "left").join(cited.withColumnRenamed("answer_id", "query_id"), "query_id", "left").join(told, "query_id", "left")
    up = F.coalesce(F.col("action_taken") == "escalate", F.lit(False))
    shown = F.when(up | (F.size("warnings") > 0), F.struct("risk_level", "groundedness", "warnings"))
    return rows.select("query_id", "answer", "sources", "citations", shown.alias("verification"), F.when(up, F.lit(True)).alias("escalation_required"), verify.is_refusal(F.col("answer")).alias("is_refusal"))


def contexts(hits: DataFrame, chunks: DataFrame, tokens: int) -> DataFrame:
    """Context of each query: sections around its hits, cut to a budget: query_id, context, truncated."""
    body = chunks.select(F.col("id").cast("long").alias("row_id"), "service_code", "document_id", "heading_path", "part_index", "part_total", "content")
    rows = hits.select("query_id", "row_id", "rank").join(body, "row_id").withColumnRenamed("row_id", "chunk_id")
    grouped = context.group_sections(context.sibling_window(rows, chunks))
    fitted = grouped.withColumn("c", context.fit_budget(F.col("context"), context.token_count(F.col("context")), F.lit(tokens)))
    return fitted.select("query_id", F.col("c.text").alias("context"), "c.truncated")


def answer(queries: DataFrame, given: DataFrame, generate: Callable[[Column, Column], Column]) -> DataFrame:
    """Generated answers, cleaned and checked against their context: query_id, answer, threats, risk_level, failure_type, hint.

    ``generate`` makes the answer from (query, context); it may wrap a model.
    """
    made = queries.select("query_id", "query").join(given.select("query_id", "context"), "query_id")
    out = made.withColumn("o", guards.sanitize_output(guards.strip_think(generate(F.col("query"), F.col("context")))))
    out = cut(out.select("query_id", "context", F.col("o.cleaned").alias("answer"), F.col("o.threats").alias("threats")))  # read several times below
    wrong = verify.unsupported(out.select("query_id", "answer"), out.select("query_id", F.col("query_id").alias("source"), F.col("context").alias("answer")), ["query_id"], "query_id", "source", "answer")
    seen = verify.verdicts(out, wrong, "query_id").withColumnRenamed("answer_id", "query_id")
    rows = out.join(seen, "query_id").withColumn("failure_type", verify.failure_type(F.col("missing_references"), F.col("wrong_numbers"), F.col("context")))
    hint = verify.hint(F.col("failure_type"), F.col("missing_references"), F.col("wrong_numbers"), F.col("context"))
    return rows.select("query_id", "answer", "threats", "risk_level", "failure_type", hint.alias("hint"))
