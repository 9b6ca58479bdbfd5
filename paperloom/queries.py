"""Registered queries of the core package and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import facts, guards, layout, requests, routing
from paperloom.operators import chunking, context, health, lines, merge, orphans, recognition, retrieval, traces, verify
from paperloom.plans import answer, ingest
from paperloom.session import spread, table, work_folder
from paperloom.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


def _reference_sides(spark: SparkSession, d: str):
    names = ("tb_query_feedback", "tb_document_contents", "trace_record", "tb_document_chunks", "vector_points")
    return orphans.reference_sides(*(table(spark, d, n) for n in names))


_ORPHANS = r"""
WITH ops AS (SELECT lower(trim(op_kind)) AS kind, * FROM vector_points),
last AS (SELECT * FROM ops WHERE point_id IS NOT NULL AND kind IN ('upsert', 'delete')
  QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY op_at DESC NULLS LAST, op_id DESC) = 1),
points AS (SELECT point_id FROM last l WHERE kind = 'upsert' AND NOT EXISTS (
  SELECT 1 FROM ops w WHERE w.point_id IS NULL AND w.kind = 'delete' AND w.service_code IS NOT DISTINCT FROM l.service_code
    AND w.document_id IS NOT DISTINCT FROM l.document_id AND (w.op_at > l.op_at OR (w.op_at = l.op_at AND w.op_id > l.op_id)))),
refs AS (
  SELECT 'tb_query_feedback' AS table_name, 'trace_id' AS field_name, id AS row_id, created_at,
    lower(regexp_replace(trace_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS key FROM tb_query_feedback
  UNION ALL SELECT 'tb_document_contents', 'chunk_id', id, created_at, chunk_id::varchar FROM tb_document_contents
  UNION ALL SELECT 'tb_document_contents', 'qdrant_point_id', id, created_at, qdrant_point_id::varchar FROM tb_document_contents),
orphan AS (SELECT * FROM refs WHERE key <> '' AND NOT (
  (field_name = 'trace_id' AND key IN (SELECT lower(regexp_replace(trace_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) FROM trace_record WHERE trace_id IS NOT NULL))
  OR (field_name = 'chunk_id' AND key IN (SELECT id::varchar FROM tb_document_chunks WHERE id IS NOT NULL))
  OR (field_name = 'qdrant_point_id' AND key IN (SELECT point_id::varchar FROM points))))"""


@query(_ORPHANS + " SELECT table_name, field_name, row_id FROM orphan")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference whose target does not exist once all data is in."""
    return orphans.orphan_rows(*_reference_sides(spark, d))


@query(_ORPHANS + " SELECT table_name, field_name, created_at::date AS day, count(*) AS n_references, count(DISTINCT key) AS n_keys FROM orphan GROUP BY ALL")
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field and day."""
    return orphans.orphan_report(*_reference_sides(spark, d))


# --- guards and routing -------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trace_record").select("dt", "line_no", "request")


_EDGE_L, _EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _sql_mask(column: str) -> list[str]:
    """SQL of the masked text after each pattern, for an engine whose word bounds know Latin letters only."""
    steps = [f"coalesce({column}, '')"]
    bodies = {kind: p.removeprefix(r"\b").removesuffix(r"\b") for kind, p in guards.PII_PATTERNS}
    bodies["EMAIL"] = r"[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]*[\p{L}\p{N}_]"  # with its word bounds written out
    for kind, body in bodies.items():
        sql = steps[-1]
        for _ in range(2):  # twice, as two matches may share the character between them
            sql = f"regexp_replace({sql}, '{_EDGE_L}{body}{_EDGE_R}', '\\1[{kind}_MASKED]\\2', 'g')"
        steps.append(sql)
    return steps


@query(f"SELECT id, {_sql_mask('free_text')[-1]} AS masked FROM tb_query_feedback")
def guard_pii_mask(spark: SparkSession, d: str) -> DataFrame:
    """Feedback texts with the guard's patterns masked."""
    return table(spark, d, "tb_query_feedback").select("id", guards.mask_pii(F.col("free_text"))["masked"].alias("masked"))


@query(f"SELECT dt, line_no, list_transform(coalesce(request.include_keywords, []), lambda x: {_sql_mask('x')[-1]}) AS masked FROM trace_record")
def guard_pii_mask_list(spark: SparkSession, d: str) -> DataFrame:
    """Keyword lists of requests with every element masked."""
    return _requests(spark, d).select("dt", "line_no", guards.mask_pii_list(F.col("request.include_keywords"))["masked"].alias("masked"))


def _sql_flag(column: str, patterns) -> str:
    return ", ".join(f"CASE WHEN regexp_matches({column}, '(?{flags or 's'}){p}') THEN 1 ELSE 0 END AS t{i}" for i, (p, flags) in enumerate(patterns))


@query(f"""SELECT dt, line_no, {_sql_flag("coalesce(request.query, '')", guards.INJECTION_PATTERNS)},
  regexp_replace(coalesce(request.query, ''), '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}\\x{{2060}}\\x{{180E}}]', '', 'g') AS cleaned FROM trace_record""")
def guard_injection(spark: SparkSession, d: str) -> DataFrame:
    """Injection patterns (t0, t1, ...) met by each request's query, and the query without invisible characters."""
    safe = guards.sanitize_input(F.col("request.query"))
    flags = [F.array_contains(F.col("s.threats"), f"injection:{p[:40]}").cast("int").alias(f"t{i}") for i, (p, _) in enumerate(guards.INJECTION_PATTERNS)]
    return _requests(spark, d).select("dt", "line_no", safe.alias("s")).select("dt", "line_no", *flags, F.col("s.cleaned").alias("cleaned"))


_CLEANED = "text"
for _pattern, _flags in guards.LEAK_PATTERNS:
    _CLEANED = f"regexp_replace({_CLEANED}, '(?{_flags or 's'}){_pattern}', '', 'g')"


@query(f"SELECT doc_id, regexp_matches(text, '(?i){guards.PROFANITY}') AS profane, {_CLEANED} AS cleaned FROM documents WHERE text IS NOT NULL")
def guard_output(spark: SparkSession, d: str) -> DataFrame:
    """Documents taken as answers: role tokens removed, profanity flagged."""
    out = guards.sanitize_output(F.col("text"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", out.alias("o"))
    return rows.select("doc_id", F.exists("o.threats", lambda t: t.startswith("profanity:")).alias("profane"), F.col("o.cleaned").alias("cleaned"))


def _sql_has(p: str) -> str:
    return f"regexp_matches(coalesce(request.query, ''), '{p}')"


@query(f"""WITH m AS (SELECT dt, line_no, {_sql_has(routing.STRUCTURED)} AS r, {_sql_has(routing.PROCEDURE)} AS p, {_sql_has(routing.COMPARISON)} AS c, {_sql_has(routing.INTERPRETATION)} AS i FROM trace_record)
  SELECT dt, line_no,
    CASE WHEN r AND NOT (p OR c OR i) THEN 'bm25_heavy' WHEN r THEN 'hybrid' WHEN p OR c OR i THEN 'dense_heavy' ELSE 'hybrid' END AS strategy,
    CASE WHEN r AND NOT (p OR c OR i) THEN 'structured_lookup' WHEN r AND p THEN 'procedure' WHEN r AND c THEN 'comparison' WHEN r THEN 'interpretation'
      WHEN c THEN 'comparison' WHEN p THEN 'procedure' WHEN i THEN 'interpretation' ELSE 'simple_fact' END AS query_type,
    CASE WHEN r AND NOT (p OR c OR i) THEN 3 WHEN r OR NOT (p OR c OR i) THEN 6 ELSE 8 END AS dense_factor,
    CASE WHEN r AND NOT (p OR c OR i) THEN 8 WHEN r OR NOT (p OR c OR i) THEN 6 ELSE 3 END AS bm25_factor FROM m""")
def route_classify(spark: SparkSession, d: str) -> DataFrame:
    """Route of every request's query."""
    return _requests(spark, d).select("dt", "line_no", routing.classify(F.col("request.query")).alias("r")).select("dt", "line_no", "r.*")


@query(f"""WITH q AS (SELECT dt, line_no, request.query AS q FROM trace_record WHERE request.query IS NOT NULL),
  m AS (SELECT *, greatest(regexp_extract(q, '{routing.PAIR}', 1), regexp_extract(q, '{routing.PAIR}', 3)) AS a, greatest(regexp_extract(q, '{routing.PAIR}', 2), regexp_extract(q, '{routing.PAIR}', 4)) AS b,
    regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(q, '{routing.COMPARISON}', '', 'g'), '{routing.PAIR}', '', 'g')), '^[의가은는이를을에서]\\s*', ''), '\\s*[가이은는을를의에서?？]+$', '') AS rest FROM q)
  SELECT dt, line_no, trim(a || ' ' || rest) AS first, trim(b || ' ' || rest) AS second FROM m WHERE a <> '' AND b <> ''""")
def decompose_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Subqueries of requests that name two things to compare."""
    parts = _requests(spark, d).where("request.query is not null").select("dt", "line_no", routing.decompose(F.col("request.query")).alias("p"))
    return parts.where("p is not null").select("dt", "line_no", F.get("p", F.lit(0)).alias("first"), F.get("p", F.lit(1)).alias("second"))


# --- traces and feedback ------------------------------------------------------------------------------------------


@query("SELECT coalesce(endpoint, '?') AS endpoint, count(*) AS requests, count(error) AS errors FROM trace_record GROUP BY 1")
def trace_volume(spark: SparkSession, d: str) -> DataFrame:
    """Requests and errors per endpoint."""
    return traces.volume(table(spark, d, "trace_record"))


@query("""WITH r AS (SELECT coalesce(route.strategy, '?') AS s, coalesce(route.query_type, '?') AS t FROM trace_record WHERE route IS NOT NULL)
  SELECT 'strategy' AS dimension, s AS name, count(*) AS n FROM r GROUP BY s UNION ALL SELECT 'query_type', t, count(*) FROM r GROUP BY t""")
def trace_route(spark: SparkSession, d: str) -> DataFrame:
    """Routed requests per strategy and type."""
    return traces.routes(table(spark, d, "trace_record"))


@query("SELECT coalesce(decomposition.method, 'none') AS method, count(*) AS n FROM trace_record WHERE route.query_type = 'comparison' GROUP BY 1")
def trace_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Comparison requests per method."""
    return traces.decomposition(table(spark, d, "trace_record"))


_SCORES = "SELECT retrieval.rerank_scores[1] AS score FROM trace_record WHERE retrieval.rerank_scores[1] IS NOT NULL"


@query(f"SELECT count(*) AS n, {', '.join(f'round(quantile_cont(score, {p / 100}), 4) AS p{p}' for p in traces.PERCENTS)} FROM ({_SCORES})")
def trace_rerank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the first rerank score."""
    return traces.grouped_percentiles(traces.top_scores(table(spark, d, "trace_record")), [], "score")


@query(f"""WITH s AS ({_SCORES}), c AS (SELECT least(greatest(floor(score / 0.1::double), 0), 9)::int AS bin, count(*) AS n FROM s GROUP BY 1)
  SELECT b::int AS bin, coalesce(n, 0) AS n FROM range(10) t(b) LEFT JOIN c ON c.bin = b""")
def trace_rerank_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of the first rerank score."""
    return traces.histogram(traces.top_scores(table(spark, d, "trace_record")), "score")


@query("""SELECT count(*) AS answers, count(*) FILTER (crag.retries > 0) AS triggered, count(*) FILTER (crag.retries > 0 AND crag.score_after > crag.score_before) AS improved,
  round(avg(crag.score_after - crag.score_before) FILTER (crag.retries > 0), 4) AS mean_change, count(*) FILTER (crag.retries > 0 AND coalesce(crag.score_after, 0) < 0.3) AS still_below
  FROM trace_record WHERE endpoint = 'answer' AND crag IS NOT NULL""")
def trace_retry(spark: SparkSession, d: str) -> DataFrame:
    """Effect of rewriting queries."""
    return traces.retries(table(spark, d, "trace_record"))


@query("""SELECT coalesce(verification.risk_level, '?') AS risk_level, count(*) AS n, sum(verification.claims_count)::bigint AS claims, round(avg(verification.groundedness), 3) AS groundedness
  FROM trace_record WHERE verification IS NOT NULL GROUP BY 1""")
def trace_verification(spark: SparkSession, d: str) -> DataFrame:
    """Verified answers per risk level."""
    return traces.risks(table(spark, d, "trace_record"))


@query("""WITH v AS (SELECT round(verification.groundedness, 4) AS g FROM trace_record WHERE verification.groundedness IS NOT NULL), s AS (SELECT list_sort(list(g)) AS l, count(*) AS n, round(avg(g), 3) AS mean, min(g) AS least FROM v)
  SELECT n, mean, least, l[n // 2 + 1] AS p50, l[least(n - 1, floor(0.95 * n)::bigint) + 1] AS p95 FROM s""")
def trace_groundedness(spark: SparkSession, d: str) -> DataFrame:
    """Spread of groundedness."""
    return traces.groundedness(table(spark, d, "trace_record"))


@query(f"""WITH s AS (SELECT unnest(map_keys(timing_ms)) AS span, unnest(map_values(timing_ms)) AS ms FROM trace_record)
  SELECT span, count(ms) AS n, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95 FROM s WHERE span IN {traces.SPANS} AND ms IS NOT NULL GROUP BY span HAVING count(ms) >= 100""")
def trace_latency(spark: SparkSession, d: str) -> DataFrame:
    """p50 and p95 of each span."""
    return traces.latencies(table(spark, d, "trace_record"))


@query(f"""WITH s AS (SELECT dt, unnest(map_keys(timing_ms)) AS span, unnest(map_values(timing_ms)) AS ms FROM trace_record),
  g AS (SELECT dt, span, count(*) AS n, list_sort(list(ms)) AS l, quantile_cont(ms, 0.5) AS c50, quantile_cont(ms, 0.95) AS c95 FROM s WHERE span IN {traces.SPANS} AND ms IS NOT NULL GROUP BY ALL)
  SELECT dt, span, n, round(CASE WHEN n < 100 THEN l[least(n - 1, floor(n * 50 / 100)::bigint) + 1] ELSE c50 END, 4) AS p50, round(CASE WHEN n < 100 THEN l[least(n - 1, floor(n * 95 / 100)::bigint) + 1] ELSE c95 END, 4) AS p95 FROM g""")
def trace_latency_daily(spark: SparkSession, d: str) -> DataFrame:
    """p50 and p95 of each span and day; days of under 100 values take the value at a place."""
    return traces.daily_latencies(table(spark, d, "trace_record"))


@query("SELECT coalesce(error.type, '?') AS type, count(*) AS n FROM trace_record WHERE error IS NOT NULL GROUP BY 1")
def trace_errors(spark: SparkSession, d: str) -> DataFrame:
    """Requests per error type."""
    return traces.errors(table(spark, d, "trace_record"))


@query("SELECT coalesce(critic.failure_type, 'none') AS failure_type, coalesce(critic.action_taken, 'none') AS action_taken, count(*) AS n FROM trace_record WHERE critic.invoked GROUP BY 1, 2")
def trace_critic(spark: SparkSession, d: str) -> DataFrame:
    """Second opinions by failure and action."""
    return traces.critic(table(spark, d, "trace_record"))


@query("SELECT count(verification) AS verified, count(*) FILTER (critic.invoked) AS invoked, round(count(*) FILTER (critic.invoked) / count(verification)::double, 4) AS rate FROM trace_record")
def trace_critic_rate(spark: SparkSession, d: str) -> DataFrame:
    """Rate of second opinions."""
    return traces.critic_rate(table(spark, d, "trace_record"))


@query("""WITH g AS (SELECT input_guard AS g FROM trace_record WHERE input_guard IS NOT NULL)
  SELECT kind, count(*) AS n, (SELECT count(*) FROM g) AS guarded, (SELECT count(*) FROM g WHERE g.pii_count > 0) AS flagged FROM (SELECT unnest(g.pii_found) AS kind FROM g WHERE g.pii_count > 0) GROUP BY kind""")
def trace_input_guard(spark: SparkSession, d: str) -> DataFrame:
    """Personal data that the input guard found."""
    return traces.input_guards(table(spark, d, "trace_record"))


@query("""SELECT CASE WHEN t LIKE 'output_leak:%' THEN 'leak' WHEN t LIKE 'profanity:%' THEN 'profanity' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT unnest(output_guard.threats) AS t FROM trace_record) GROUP BY 1""")
def trace_output_guard(spark: SparkSession, d: str) -> DataFrame:
    """Threats in answers."""
    return traces.output_guards(table(spark, d, "trace_record"))


_ONE = "SELECT * FROM trace_record WHERE trim(trace_id) <> '' QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY dt, line_no DESC) = 1"


@query(f"""WITH t AS ({_ONE}), f AS (SELECT trace_id, signal FROM tb_query_feedback WHERE signal IN {traces.SIGNALS})
  SELECT signal, count(*) AS total, count(t.trace_id) AS matched, round(avg(retrieval.rerank_scores[1]), 4) AS mean_score, count(*) FILTER (verification.risk_level = 'hard_fail') AS hard_fail,
    round(count(t.trace_id) / count(*)::double, 3) AS match_rate FROM f LEFT JOIN t USING (trace_id) GROUP BY signal""")
def feedback_join(spark: SparkSession, d: str) -> DataFrame:
    """Feedback joined with its traces, per signal."""
    return traces.feedback_signals(table(spark, d, "tb_query_feedback"), table(spark, d, "trace_record"))


@query(f"""WITH t AS ({_ONE}), f AS (SELECT trace_id, signal FROM tb_query_feedback WHERE signal IN {traces.SIGNALS})
  SELECT coalesce(verification.risk_level, 'none') AS risk_level, count(*) FILTER (signal = 'up') AS up, count(*) FILTER (signal = 'down') AS down, count(*) FILTER (signal = 'reformulated') AS reformulated
  FROM f JOIN t USING (trace_id) GROUP BY 1""")
def feedback_risk_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Matched feedback by risk level and signal."""
    return traces.signal_risks(table(spark, d, "tb_query_feedback"), table(spark, d, "trace_record"))


# --- index, tables and joins --------------------------------------------------------------------------------------


@query("""SELECT s.service_code, c.service_name, count(*) AS documents, max(s.updated_at) AS newest FROM tb_document_status s LEFT JOIN tb_service_code c USING (service_code) GROUP BY ALL""")
def service_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents per service with the service's name."""
    s, c = table(spark, d, "tb_document_status"), table(spark, d, "tb_service_code")
    counts = s.groupBy("service_code").agg(F.count("*").alias("documents"), F.max("updated_at").alias("newest"))
    return counts.join(c.select("service_code", "service_name"), "service_code", "left").select("service_code", "service_name", "documents", "newest")


@query("""SELECT service_code, document_id, arg_max(status_code, (updated_at IS NOT NULL, coalesce(updated_at, created_at), id)) AS status_code FROM tb_document_status GROUP BY 1, 2""")
def status_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Newest status of each document."""
    s = table(spark, d, "tb_document_status").withColumn("_known", F.col("updated_at").isNotNull()).withColumn("_at", F.coalesce("updated_at", "created_at"))
    return s.groupBy("service_code", "document_id").agg(F.max_by("status_code", F.struct("_known", "_at", "id")).alias("status_code"))


@query("SELECT c.id FROM tb_document_chunks c WHERE NOT EXISTS (SELECT 1 FROM tb_document_contents t WHERE t.chunk_id = c.id)")
def unembedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the serving table lacks."""
    chunks, contents = table(spark, d, "tb_document_chunks"), table(spark, d, "tb_document_contents")
    return chunks.select("id").join(contents.select(F.col("chunk_id").alias("id")), "id", "left_anti")


@query("""WITH t AS (SELECT dt, line_no, list_transform(list_filter(retrieval.rerank_scores, lambda x: x IS NOT NULL), lambda x: round(x, 4)) AS s FROM trace_record)
  SELECT dt, line_no, list_min(s) AS least, list_max(s) AS most, round(list_sum(s) / len(s), 4) AS mean FROM t WHERE len(s) > 0""")
def trace_rerank_stats(spark: SparkSession, d: str) -> DataFrame:
    """Least, greatest and mean rerank score of each request."""
    return traces.rerank_stats(table(spark, d, "trace_record"))


@query("SELECT count(*) AS answers, round(avg(verification.claims_count), 2) AS mean_claims, NULL::double AS coverage FROM trace_record WHERE verification.claims_count > 0")
def trace_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of verified answers."""
    return traces.claim_coverage(table(spark, d, "trace_record"))


def _sql_long(section: str, key: str, name: str, *metrics: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {name} AS name, '{m}' AS metric, {m}::double AS value FROM ({ORACLE_SQL[key]})" for m in metrics)


@query(" UNION ALL ".join([
    _sql_long("volume", "trace_volume", "endpoint", "requests", "errors"), _sql_long("route", "trace_route", "name", "n") + " WHERE dimension = 'strategy'", _sql_long("query_type", "trace_route", "name", "n") + " WHERE dimension = 'query_type'",
    _sql_long("decomposition", "trace_decomposition", "method", "n"), _sql_long("rerank", "trace_rerank_percentiles", "''", "n", *[f"p{p}" for p in traces.PERCENTS]), _sql_long("retry", "trace_retry", "''", "answers", "triggered", "improved", "mean_change", "still_below"),
    _sql_long("verification", "trace_verification", "risk_level", "n", "claims", "groundedness"), _sql_long("claims", "trace_claims", "''", "answers", "mean_claims"), _sql_long("latency", "trace_latency", "span", "n", "p50", "p95"), _sql_long("errors", "trace_errors", "type", "n"),
    f"SELECT 'critic', failure_type, 'n', sum(n)::double FROM ({ORACLE_SQL['trace_critic']}) GROUP BY failure_type", _sql_long("input_guard", "trace_input_guard", "kind", "n"), _sql_long("output_guard", "trace_output_guard", "kind", "n"),
]))
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    """All sections of the trace report in one table."""
    return traces.summary(table(spark, d, "trace_record"))


@query("""SELECT coalesce(document_id, 'unknown') AS document_id, count(*) AS n, round(100.0::double * count(*) / sum(count(*)) OVER (), 4) AS percent FROM tb_document_contents GROUP BY 1""")
def doc_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Contents per document and their share."""
    return health.document_distribution(table(spark, d, "tb_document_contents"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
  p AS (SELECT list_dot_product(a.e, b.e) AS c FROM u a JOIN u b ON a.vec_id < b.vec_id)
  SELECT (SELECT count(*) FROM u) AS vectors, count(*) AS pairs, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS stddev, CASE WHEN avg(c) >= 0.85 THEN 'warning' ELSE 'ok' END AS status FROM p""")
def index_dispersion(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of all pairs of vectors."""
    return health.dispersion(table(spark, d, "embeddings"))


_NEAR = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
  p AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, q.label AS asked, r.label AS got, round(list_dot_product(q.e, r.e), 9) AS score FROM u q JOIN u r ON q.vec_id % 50 = 0)"""


@query(_NEAR + " SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::int AS rank FROM p QUALIFY rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of every vector whose id is divisible by 50, among all."""
    v = table(spark, d, "embeddings")
    return retrieval.dense_topk(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 10)


@query(_NEAR + """, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS k FROM p WHERE query_id <> row_id QUALIFY k <= 5)
  SELECT count(*) AS results, count(*) FILTER (asked <> got) AS wrong, round(count(*) FILTER (asked <> got) / count(*)::double, 4) AS rate, CASE WHEN count(*) FILTER (asked <> got) / count(*)::double >= 0.15 THEN 'warning' ELSE 'ok' END AS status FROM t""")
def index_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours with another label."""
    v = table(spark, d, "embeddings")
    return health.confusion(v.where("vec_id % 50 = 0"), v)


def _title_queries(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the documents whose id is divisible by 50, as queries."""
    return table(spark, d, "documents").where("doc_id % 50 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


_BM25 = r"""WITH w AS (SELECT doc_id AS row_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
  s AS (SELECT count(*) AS docs, greatest(avg(len(t)), 1e-9) AS mean FROM w), e AS (SELECT row_id, len(t) AS n, unnest(t) AS term FROM w), i AS (SELECT term, row_id, n, count(*) AS tf FROM e GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM i GROUP BY term),
  q AS (SELECT doc_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS term FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
  b AS (SELECT query_id, row_id, round(sum(ln((docs - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n / mean))), 6) AS score FROM q JOIN i USING (term) JOIN f USING (term), s GROUP BY 1, 2)"""


@query(_BM25 + " SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::int AS rank FROM b QUALIFY rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Documents that fit a title's words best."""
    return retrieval.bm25_topk(_title_queries(spark, d), _texts(spark, d), 10, "doc_id", "text")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_DENSE30 = """, v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
  dn AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS row_id, round(list_dot_product(q.e, r.e), 9) AS score FROM u q JOIN u r ON q.vec_id % 50 = 0) QUALIFY rank <= 30),
  bm AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM b QUALIFY rank <= 30),
  rr AS (SELECT query_id, row_id, round(sum(1.0::double / (60 + rank)), 9) AS score FROM (SELECT * FROM dn UNION ALL SELECT * FROM bm) GROUP BY 1, 2)"""


@query(_BM25 + _DENSE30 + " SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::int AS rank FROM rr QUALIFY rank <= 10")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Vector and word lists of the same ids fused by reciprocal ranks."""
    dense = retrieval.dense_topk(_vector_queries(spark, d), table(spark, d, "embeddings"), 30)
    sparse = retrieval.bm25_topk(_title_queries(spark, d), _texts(spark, d), 30, "doc_id", "text")
    return retrieval.fuse([dense, sparse], 10)


_RERANKED = """, fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS place FROM (SELECT query_id, row_id, round(sum(1.0::double / (60 + rank)), 9) AS score FROM (
    SELECT query_id, row_id, rank FROM dn WHERE rank <= 24 UNION ALL SELECT query_id, row_id, rank FROM bm WHERE rank <= 24) GROUP BY 1, 2) QUALIFY place <= 24),
  t AS (SELECT query_id, list(term) AS q FROM q GROUP BY 1),
  o AS (SELECT fused.query_id, fused.row_id, place, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, list_distinct(w.t))) / len(q)::double END, 6) AS score FROM fused JOIN t USING (query_id) JOIN w ON w.row_id = fused.row_id)
  SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place)::int AS rank FROM o QUALIFY rank <= 8"""


@query(_BM25 + _DENSE30 + _RERANKED)
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Fused lists reranked by word overlap: the whole way from a query to its hits."""
    documents = _texts(spark, d)
    dense = retrieval.dense_topk(_vector_queries(spark, d), table(spark, d, "embeddings"), 24)
    sparse = retrieval.bm25_topk(_title_queries(spark, d), documents, 24, "doc_id", "text")
    return retrieval.rerank(retrieval.fuse([dense, sparse], 24), _title_queries(spark, d), documents, 8, "doc_id", "text")


@query("""WITH h AS (SELECT id AS query_id, * FROM tb_document_chunks),
  m AS (SELECT query_id, service_code, document_id, heading_path, coalesce(part_index, 1) AS p, coalesce(part_total, 1) AS t FROM h WHERE coalesce(heading_path, '') <> '' AND coalesce(part_total, 1) > 1),
  f AS (SELECT m.query_id, c.id AS chunk_id FROM m JOIN tb_document_chunks c USING (service_code, document_id, heading_path) WHERE c.part_index BETWEEN greatest(1, p - 2) AND least(t, p + 2))
  SELECT DISTINCT query_id, chunk_id FROM (SELECT * FROM f UNION ALL SELECT query_id, id FROM h WHERE coalesce(heading_path, '') = '' OR coalesce(part_total, 1) <= 1)""")
def sibling_window(spark: SparkSession, d: str) -> DataFrame:
    """Parts around every chunk."""
    chunks = table(spark, d, "tb_document_chunks")
    hits = chunks.select(F.col("id").alias("query_id"), F.col("id").alias("chunk_id"), F.lit(1).alias("rank"), "service_code", "document_id", "heading_path", "part_index", "part_total", "content")
    return context.sibling_window(hits, chunks).select("query_id", "chunk_id")


_SIBLINGS = """WITH h AS (SELECT id AS query_id, * FROM tb_document_chunks),
  m AS (SELECT query_id, service_code, document_id, heading_path, coalesce(part_index, 1) AS p, coalesce(part_total, 1) AS t FROM h WHERE coalesce(heading_path, '') <> '' AND coalesce(part_total, 1) > 1),
  f AS (SELECT m.query_id, c.id AS chunk_id, heading_path, c.part_index, c.content FROM m JOIN tb_document_chunks c USING (service_code, document_id, heading_path) WHERE c.part_index BETWEEN greatest(1, p - 2) AND least(t, p + 2)),
  w AS (SELECT DISTINCT * FROM (SELECT * FROM f UNION ALL SELECT query_id, id, heading_path, coalesce(part_index, 1), content FROM h WHERE coalesce(heading_path, '') = '' OR coalesce(part_total, 1) <= 1))"""


@query(_SIBLINGS + """, s AS (SELECT query_id, coalesce(heading_path, '') AS path, string_agg(content, chr(10) || chr(10) ORDER BY part_index, chunk_id) AS body FROM w GROUP BY 1, 2),
  x AS (SELECT query_id, CASE WHEN path = '' THEN coalesce(body, '') ELSE path || chr(10) || chr(10) || coalesce(body, '') END AS t FROM s)
  SELECT query_id, CASE WHEN floor(length(t) / 2) <= 600 THEN t ELSE left(t, floor(600 / (floor(length(t) / 2) / length(t)))::int) END AS context, floor(length(t) / 2) > 600 AS truncated FROM x""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Grouped sections of those parts, cut to a budget of 600 tokens."""
    chunks = table(spark, d, "tb_document_chunks")
    hits = chunks.select(F.col("id").alias("query_id"), F.col("id").alias("chunk_id"), F.lit(1).alias("rank"), "service_code", "document_id", "heading_path", "part_index", "part_total", "content")
    grouped = context.group_sections(context.sibling_window(hits, chunks))
    cut = context.fit_budget(F.col("context"), context.token_count(F.col("context")), F.lit(600))
    return grouped.select("query_id", cut.alias("c")).select("query_id", F.col("c.text").alias("context"), "c.truncated")


@query("SELECT id FROM tb_document_contents WHERE start_page >= 2 AND end_page <= 6 AND contains(content, '한다') AND NOT contains(content, '통지서')")
def filter_build(spark: SparkSession, d: str) -> DataFrame:
    """Contents on pages 2 to 6 with one word and without another."""
    return table(spark, d, "tb_document_contents").where(retrieval.build_filter(start_page=2, end_page=6, include=["한다"], exclude=["통지서"])).select("id")


# --- text, lines and chunks ---------------------------------------------------------------------------------------

_MD = "SELECT id, raw_markdown AS t FROM tb_document_extract WHERE raw_markdown IS NOT NULL"
_LINES = f"l AS (SELECT id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM ({_MD}))"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _extracts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "tb_document_extract").select("id", "raw_markdown"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.split_lines(_extracts(spark, d), "id", "raw_markdown")


@query(r"""WITH p AS (SELECT id, list_concat([1], list_transform(regexp_extract_all(t, '<!--\s*page:(\d+)\s*-->', 1), lambda x: x::int)) AS n, string_split_regex(t, '<!--\s*page:(\d+)\s*-->') AS c FROM (""" + _MD + r""")),
  e AS (SELECT id, unnest(n) AS page, trim(unnest(c), ' ' || chr(10) || chr(9) || chr(13)) AS content FROM p) SELECT id, page, content FROM e WHERE content <> ''""")
def markdown_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of extracted texts."""
    return lines.pages(table(spark, d, "tb_document_extract"), "id", "raw_markdown").select("id", "page", "content")


_IS_NOISE = " OR ".join([*[f"regexp_matches(s, '(?{flags or 's'}){p}')" for p, flags in layout.NOISE], *[f"contains(s, '{x}')" for x in layout.LEADERS], "(length(s) <= 2 AND NOT regexp_matches(s, '[가-힣a-zA-Z0-9]'))"])


@query("WITH " + _LINES + f", h AS (SELECT *, trim(line) AS s FROM l) SELECT id, pos FROM h WHERE s <> '' AND ({_IS_NOISE})")
def noise_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that cleaning drops."""
    return _lines(spark, d).where(layout.is_noise_line(F.col("line"))).select("id", "pos")


@query(r"WITH " + _LINES + r""", a AS (SELECT *, starts_with(trim(line), '|') AND ends_with(trim(line), '|') AS is_table FROM l),
  b AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY pos) AS block FROM (SELECT *, CASE WHEN is_table = lag(is_table) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM a))
  SELECT id, block, count(*) AS rows, NOT max(NOT regexp_matches(trim(trim(line), '|'), '^[\s\-:]+$') AND contains(trim(trim(line), '|'), '|')) AS is_junk FROM b WHERE is_table GROUP BY id, block""")
def table_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Tables of extracted texts and whether they have one column only."""
    return lines.table_blocks(_lines(spark, d), "id").where("is_table").groupBy("id", "block").agg(F.count("*").alias("rows"), F.max("is_junk").alias("is_junk"))


_H = ", ".join(f"max(CASE WHEN level = {k} THEN pos END) OVER w AS p{k}" for k in range(1, 7))
_PATH = ", ".join(
    f"CASE WHEN p{k} > greatest({', '.join([f'coalesce(p{j}, -1)' for j in range(1, k)] + ['-1'])}) THEN p{k} END" for k in range(1, 7)
)


@query(r"WITH " + _LINES + rf""", a AS (SELECT *, nullif(length(regexp_extract(trim(line), '^(#{{1,6}})\s+(.+)$', 1)), 0) AS level FROM l),
  b AS (SELECT *, {_H} FROM a WINDOW w AS (PARTITION BY id ORDER BY pos))
  SELECT id, pos, list_transform(list_filter([{_PATH}], lambda x: x IS NOT NULL), lambda x: x::int) AS path FROM b WHERE level IS NOT NULL""")
def heading_positions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the headings above each heading, itself included."""
    rows = lines.heading_paths(_lines(spark, d).withColumn("line", F.regexp_replace("line", r"(?U)^(\s*#{1,6}\s+).+$", F.concat(F.lit("$1"), F.col("pos").cast("string")))), "id")
    return rows.where("level is not null").select("id", "pos", F.col("heading_path").cast("array<int>").alias("path"))


_T = ", ".join(f"arg_max(title, pos) FILTER (level = {k}) OVER w AS t{k}" for k in range(1, 7))
_TITLES = ", ".join(f"CASE WHEN p{k} > greatest({', '.join([f'coalesce(p{j}, -1)' for j in range(1, k)] + ['-1'])}) THEN t{k} END" for k in range(1, 7))


@query(r"WITH " + _LINES + rf""", a AS (SELECT *, nullif(length(regexp_extract(trim(line), '^(#{{1,6}})\s+(.+)$', 1)), 0) AS level, nullif(trim(regexp_extract(trim(line), '^(#{{1,6}})\s+(.+)$', 2)), '') AS title,
    nullif(regexp_extract(line, '^\s*<!--\s*page:(\d+)\s*-->\s*$', 1), '')::int AS mark FROM l),
  b AS (SELECT *, {_H}, {_T}, last_value(mark IGNORE NULLS) OVER w AS page FROM a WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING))
  SELECT id, pos, level::int AS level, list_filter([{_TITLES}], lambda x: x IS NOT NULL) AS heading_path, page FROM b""")
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    """Heading path and page of every line."""
    return lines.heading_paths(_lines(spark, d), "id").select("id", "pos", "level", "heading_path", "page")


@query()
def normalize(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the form that is indexed."""
    return _texts(spark, d).where("text is not null").select("doc_id", layout.normalize_text(F.col("text")).alias("text"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_IS_TOC = rf"""regexp_matches(title, '(?i){layout.TOC_TITLE}') OR ((regexp_matches(title, '[·…]{{3,}}') OR regexp_matches(title, '\s+\d+\s*$'))
  AND (length(title) - length(replace(title, '·', '')) >= 3 OR length(title) - length(replace(title, '…', '')) >= 2))"""


@query(rf"""WITH {_LINES}, a AS (SELECT *, nullif(length(regexp_extract(trim(line), '{layout.HEADING}', 1)), 0) AS level, trim(regexp_extract(trim(line), '{layout.HEADING}', 2)) AS title FROM l),
  t AS (SELECT *, level IS NOT NULL AND ({_IS_TOC}) AS toc FROM a),
  b AS (SELECT *, last_value(CASE WHEN toc THEN pos END IGNORE NULLS) OVER w AS place, last_value(CASE WHEN toc THEN level END IGNORE NULLS) OVER w AS depth FROM t WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT *, max(CASE WHEN level <= depth AND NOT toc THEN 1 END) OVER (PARTITION BY id, place ORDER BY pos ROWS UNBOUNDED PRECEDING) AS closed FROM b)
  SELECT id, {_STRIP.format("string_agg(line, chr(10) ORDER BY pos)")} AS text FROM c WHERE place IS NULL OR closed = 1 GROUP BY id""")
def remove_toc(spark: SparkSession, d: str) -> DataFrame:
    """Extracted texts without tables of contents."""
    return lines.join_lines(lines.without_contents(_lines(spark, d), "id"), "id")


@query(rf"""WITH {_LINES}, a AS (SELECT *, trim(line) AS s, starts_with(trim(line), '|') AND ends_with(trim(line), '|') AS is_table FROM l),
  b AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY pos) AS block FROM (SELECT *, CASE WHEN is_table = lag(is_table) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM a)),
  j AS (SELECT *, is_table AND NOT max(NOT regexp_matches(trim(s, '|'), '^[\s\-:]+$') AND contains(trim(s, '|'), '|')) OVER (PARTITION BY id, block) AS is_junk FROM b)
  SELECT id, {_STRIP.format("string_agg(regexp_replace(line, '^#{{7,}}\\s+', ''), chr(10) ORDER BY pos)")} AS text
  FROM j WHERE NOT is_junk AND NOT regexp_matches(line, '{layout.PAGE_MARK}') AND NOT (s <> '' AND ({_IS_NOISE})) GROUP BY id""".replace("{{7,}}", "{7,}"))
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Extracted texts without noise lines, page marks and one-column tables."""
    return chunking.cleaned_texts(_extracts(spark, d), "id", "raw_markdown")


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE text IS NOT NULL),
  step AS (SELECT doc_id, 0 AS st, CASE WHEN n <= 800 THEN n ELSE CASE WHEN length(regexp_extract(substr(t, 1, 800), '(?s)^.*[\n .]')) - 1 > 400 THEN length(regexp_extract(substr(t, 1, 800), '(?s)^.*[\n .]')) ELSE 800 END END AS en FROM d
    UNION ALL SELECT doc_id, s, CASE WHEN s + 800 < n AND length(regexp_extract(substr(t, s + 1, 800), '(?s)^.*[\n .]')) - 1 > 400 THEN s + length(regexp_extract(substr(t, s + 1, 800), '(?s)^.*[\n .]')) ELSE s + 800 END
      FROM (SELECT doc_id, t, n, en - 150 AS s FROM step JOIN d USING (doc_id) WHERE n > 800 AND en - 150 < n)),
  c AS (SELECT doc_id, st, regexp_replace(substr(t, st + 1, en - st), '^[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+|[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+$', '', 'g') AS content FROM step JOIN d USING (doc_id))
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st)::int AS part_index, st::int AS start, content FROM c WHERE content <> ''""")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Windows over every document."""
    return chunking.fixed_chunks(_texts(spark, d), "doc_id", "text").select("doc_id", "part_index", "start", "content")


@query()
def chunk_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of extracted texts by heading."""
    rows = _extracts(spark, d).select("id", layout.normalize_text(F.col("raw_markdown")).alias("text"))
    return chunking.adaptive_chunks(rows, "id", "text")


@query("""SELECT id, CASE WHEN coalesce(heading_path, '') = '' THEN 1 ELSE row_number() OVER (PARTITION BY service_code, document_id, heading_path ORDER BY seq, id) END::int AS part_index,
  CASE WHEN coalesce(heading_path, '') = '' THEN 1 ELSE count(*) OVER (PARTITION BY service_code, document_id, heading_path) END::int AS part_total FROM tb_document_chunks""")
def rechunk_indices(spark: SparkSession, d: str) -> DataFrame:
    """Part numbers of chunks anew within their heading path."""
    return chunking.renumber_parts(table(spark, d, "tb_document_chunks"), ["service_code", "document_id"], ["seq", "id"]).select("id", "part_index", "part_total")


@query(r"""WITH t AS (SELECT service_code, document_id, unnest(image_ocr_texts) AS x FROM tb_document_chunks), s AS (SELECT *, regexp_replace(coalesce(x, ''), '^\s+|\s+$', '', 'g') AS s FROM t),
  v AS (SELECT *, regexp_replace(s, '[ \n]', '', 'g') AS solid FROM s)
  SELECT service_code, document_id, CASE WHEN s = '' THEN 'empty' WHEN length(s) < 10 THEN 'too_short' WHEN regexp_matches(s, '""" + layout.OCR_SPECIAL + r"""') THEN 'special_only'
    WHEN regexp_matches(s, '""" + layout.OCR_MATH + r"""') THEN 'math_noise' WHEN length(regexp_replace(solid, '[^가-힣a-zA-Z]', '', 'g')) < 0.3::double * length(solid) THEN 'low_lang_ratio' ELSE 'passed' END AS verdict,
    count(*) AS n, sum(length(coalesce(x, '')))::bigint AS chars FROM v GROUP BY ALL""")
def ocr_quality(spark: SparkSession, d: str) -> DataFrame:
    """Recognised texts per document and verdict."""
    return health.recognised_texts(table(spark, d, "tb_document_chunks"))


# --- facts and verification ---------------------------------------------------------------------------------------


_ART = facts.ARTICLE.replace(r"\d", r"\p{Nd}").replace(r"\s", r"[\s\p{Z}]")  # SQL's \d knows ASCII digits only
_AMT = facts.AMOUNT.replace(r"\d", r"\p{Nd}").replace(r"\s", r"[\s\p{Z}]")
_DAY = facts.DATE.replace(r"\d", r"\p{Nd}")


def _digits(sql: str) -> str:
    return f"translate({sql}, '０１２３４５６７８９', '0123456789')"


@query(rf"""WITH m AS (SELECT doc_id, {_digits("unnest(regexp_extract_all(text, '" + _ART + "'))")} AS m FROM documents)
  SELECT doc_id, regexp_extract(m, '{_ART}', 1)::int AS article, nullif(regexp_extract(m, '{_ART}', 2), '')::int AS paragraph, count(*) AS n FROM m GROUP BY ALL""")
def fact_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles that documents refer to."""
    rows = _texts(spark, d).select("doc_id", F.explode(facts.article_refs(F.col("text"))).alias("r"))
    return rows.groupBy("doc_id", F.col("r.article").alias("article"), F.col("r.paragraph").alias("paragraph")).agg(F.count("*").alias("n"))


@query(rf"""WITH m AS (SELECT doc_id, {_digits("unnest(regexp_extract_all(text, '" + _AMT + "'))")} AS m FROM documents),
  u AS (SELECT doc_id, replace(regexp_extract(m, '{_AMT}', 1), ',', '')::double AS a, regexp_replace(regexp_extract(m, '{_AMT}', 2), '\s', '', 'g') AS u FROM m)
  SELECT doc_id, CASE WHEN u IN ('만원', '억원', '원') THEN 'KRW' WHEN u IN ('%', '퍼센트') THEN 'PERCENT' WHEN u IN ('일', '개월') THEN 'DAYS' WHEN u = '년' THEN 'YEARS' WHEN u IN ('세', '살') THEN 'AGE' ELSE 'COUNT' END AS unit,
    count(*) AS n, sum(a * CASE u WHEN '만원' THEN 1e4 WHEN '억원' THEN 1e8 WHEN '개월' THEN 30 ELSE 1 END)::double AS total FROM u GROUP BY ALL
  UNION ALL SELECT doc_id, 'DATE', count(*), 0.0 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_DAY}')) AS m FROM documents) GROUP BY doc_id""")
def fact_numeric(spark: SparkSession, d: str) -> DataFrame:
    """Amounts that documents state, by unit."""
    rows = _texts(spark, d).select("doc_id", F.explode(facts.numeric_facts(F.col("text"))).alias("f"))
    return rows.groupBy("doc_id", F.col("f.unit").alias("unit")).agg(F.count("*").alias("n"), F.sum("f.value").alias("total"))


@query(r"""WITH c AS (SELECT id, unnest(string_split(regexp_replace(regexp_replace(content, '([.!?다요음])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS c, generate_subscripts(string_split(regexp_replace(regexp_replace(content, '([.!?다요음])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), 1) AS pos FROM tb_document_contents WHERE content IS NOT NULL)
  SELECT id, list(trim(c, ' ' || chr(10) || chr(9)) ORDER BY pos) AS claims FROM c WHERE trim(c, ' ' || chr(10) || chr(9)) <> '' GROUP BY id""")
def claims_split(spark: SparkSession, d: str) -> DataFrame:
    """Statements of every content."""
    return table(spark, d, "tb_document_contents").select("id", facts.claims(F.col("content")).alias("claims")).where("size(claims) > 0")


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Serving contents as answers, and the other chunks of their documents as sources."""
    answers = table(spark, d, "tb_document_contents").select("id", F.col("chunk_id").alias("own"), "service_code", "document_id", "content")
    return answers, table(spark, d, "tb_document_chunks").select("id", "service_code", "document_id", "content")


def _unsupported(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    answers, sources = _answers(spark, d)
    return answers, sources, verify.unsupported(answers, sources, ["service_code", "document_id"], "id", "id", own="own")


_NAMES = _digits(f"unnest(regexp_extract_all(content, '{_ART}'))")
_CANON = (
    rf"'제' || regexp_extract(m, '{_ART}', 1)::int || '조' || CASE WHEN regexp_extract(m, '{_ART}', 2) IN ('', '0') THEN '' ELSE ' 제' || regexp_extract(m, '{_ART}', 2)::int || '항' END"
    rf" || CASE WHEN regexp_extract(m, '{_ART}', 3) IN ('', '0') THEN '' ELSE ' 제' || regexp_extract(m, '{_ART}', 3)::int || '호' END"
)


@query(f"""WITH a AS (SELECT id, chunk_id, service_code, document_id, {_NAMES} AS m FROM tb_document_contents), s AS (SELECT id, service_code, document_id, {_NAMES} AS m FROM tb_document_chunks),
  an AS (SELECT DISTINCT id, chunk_id, service_code, document_id, {_CANON} AS name FROM a), sn AS (SELECT DISTINCT id, service_code, document_id, {_CANON} AS name FROM s)
  SELECT id AS answer_id, name FROM an WHERE NOT EXISTS (SELECT 1 FROM sn WHERE sn.service_code = an.service_code AND sn.document_id = an.document_id AND sn.name = an.name AND sn.id IS DISTINCT FROM an.chunk_id)""")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Articles named in a content that no other chunk of its document names."""
    return _unsupported(spark, d)[2].where("kind = 'reference' and name like '제%조%'").select("answer_id", "name")


_APPX = facts.APPENDIX.replace(r"\d", r"\p{Nd}").replace(r"\s", r"[\s\p{Z}]")
_APPX_NO = "coalesce(" + ", ".join(f"nullif(regexp_extract(m, '{_APPX}', {g}), '')" for g in (1, 2, 3, 4)) + ")"
_APPX_NAME = f"CASE WHEN {_APPX_NO} IS NULL THEN left(m, 2) WHEN left(m, 2) = '부칙' THEN '부칙 제' || {_APPX_NO}::int || '조' ELSE left(m, 2) || ' ' || {_APPX_NO}::int END"
_CANON4 = _CANON + rf" || CASE WHEN regexp_extract(m, '{_ART}', 4) IN ('', '0') THEN '' ELSE ' 제' || regexp_extract(m, '{_ART}', 4)::int || '목' END"
_UNIT = "CASE WHEN u IN ('만원', '억원', '원') THEN 'KRW' WHEN u IN ('%', '퍼센트') THEN 'PERCENT' WHEN u IN ('일', '개월') THEN 'DAYS' WHEN u = '년' THEN 'YEARS' WHEN u IN ('세', '살') THEN 'AGE' ELSE 'COUNT' END"


def _sql_refs(keys: str, text: str, source: str) -> str:
    """SELECT of the distinct references (name, article, paragraph) of a text."""
    part = lambda pattern: f"SELECT {keys}, {_digits(f'unnest(regexp_extract_all({text}, {chr(39)}{pattern}{chr(39)}))')} AS m FROM {source}"
    number = lambda g: f"nullif(regexp_extract(m, '{_ART}', {g}), '')::int"
    return f"SELECT DISTINCT {keys}, {_CANON4} AS name, {number(1)} AS article, {number(2)} AS paragraph FROM ({part(_ART)}) UNION SELECT DISTINCT {keys}, {_APPX_NAME}, NULL, NULL FROM ({part(_APPX)})"


def _sql_nums(keys: str, text: str, source: str) -> str:
    """SELECT of all amounts and dates (value, unit) of a text, with repeats."""
    amounts = f"SELECT {keys}, {_digits(f'unnest(regexp_extract_all({text}, {chr(39)}{_AMT}{chr(39)}))')} AS m FROM {source}"
    read = f"SELECT {keys}, replace(regexp_extract(m, '{_AMT}', 1), ',', '')::double AS a, regexp_replace(regexp_extract(m, '{_AMT}', 2), '\\s', '', 'g') AS u FROM ({amounts})"
    dates = f"SELECT {keys}, 0.0::double, 'DATE' FROM (SELECT {keys}, unnest(regexp_extract_all({text}, '{_DAY}')) AS m FROM {source})"
    return f"SELECT {keys}, a * CASE u WHEN '만원' THEN 1e4 WHEN '억원' THEN 1e8 WHEN '개월' THEN 30 ELSE 1 END AS value, {_UNIT} AS unit FROM ({read}) UNION ALL {dates}"


_SAME = "k.service_code = f.service_code AND k.document_id = f.document_id AND k.id IS DISTINCT FROM f.chunk_id"
_RISKS = f"""WITH aref AS ({_sql_refs("id, chunk_id, service_code, document_id", "content", "tb_document_contents")}), sref AS ({_sql_refs("id, service_code, document_id", "content", "tb_document_chunks")}),
  anum AS ({_sql_nums("id, chunk_id, service_code, document_id", "content", "tb_document_contents")}), snum AS (SELECT DISTINCT * FROM ({_sql_nums("id, service_code, document_id", "content", "tb_document_chunks")})),
  mref AS (SELECT * FROM aref f WHERE NOT EXISTS (SELECT 1 FROM sref k WHERE {_SAME} AND k.name = f.name)),
  mnum AS (SELECT * FROM anum f WHERE NOT EXISTS (SELECT 1 FROM snum k WHERE {_SAME} AND k.value = f.value AND k.unit = f.unit)),
  verdict AS (SELECT c.id AS answer_id, coalesce(r.n, 0)::int AS missing, coalesce(w.n, 0)::int AS wrong, CASE WHEN r.n > 0 THEN 'hard_fail' WHEN w.critical THEN 'soft_fail' WHEN w.n > 0 THEN 'warn' ELSE 'pass' END AS risk_level
    FROM tb_document_contents c LEFT JOIN (SELECT id, count(*) AS n FROM mref GROUP BY id) r USING (id) LEFT JOIN (SELECT id, count(*) AS n, bool_or(unit IN {facts.CRITICAL_UNITS}) AS critical FROM mnum GROUP BY id) w USING (id))"""


@query(_RISKS + " SELECT * FROM verdict")
def risk_level(spark: SparkSession, d: str) -> DataFrame:
    """Risk of every content, were it an answer from the other chunks of its document."""
    answers, _, wrong = _unsupported(spark, d)
    return verify.verdicts(answers, wrong, "id").select("answer_id", F.size("missing_references").alias("missing"), F.size("wrong_numbers").alias("wrong"), "risk_level")


_BESIDE = "(abs(k.article - f.article) = 1 OR (k.article = f.article AND (abs(k.paragraph - f.paragraph) <= 1 OR (k.paragraph IS NULL) <> (f.paragraph IS NULL))))"


@query(_RISKS + f""" SELECT answer_id, risk_level, CASE WHEN missing > 0 THEN CASE WHEN EXISTS (SELECT 1 FROM mref f JOIN sref k ON {_SAME} AND {_BESIDE} WHERE f.id = answer_id) THEN 'generation_error' ELSE 'retrieval_gap' END
    WHEN EXISTS (SELECT 1 FROM mnum f JOIN snum k ON {_SAME} AND k.unit = f.unit AND abs(k.value - f.value) < 0.5 * greatest(abs(k.value), abs(f.value)) WHERE f.id = answer_id AND f.unit IN {facts.CRITICAL_UNITS} AND f.value <> 0) THEN 'unit_error' ELSE 'minor' END AS failure_type
  FROM verdict WHERE risk_level IN ('hard_fail', 'soft_fail')""")
def failure_class(spark: SparkSession, d: str) -> DataFrame:
    """What kind of failure each unsupported content is, against all other chunks of its document."""
    answers, sources, wrong = _unsupported(spark, d)
    group = ["service_code", "document_id"]
    bad = verify.verdicts(answers, wrong, "id").where("risk_level in ('hard_fail', 'soft_fail')")
    rows = bad.join(verify.near_facts(answers, wrong, sources, group, "id", "id", own="own"), "answer_id")
    return rows.select("answer_id", "risk_level", verify.failure_of(F.size("missing_references"), F.col("near_reference"), F.col("near_number")).alias("failure_type"))


_CLAIMS = r"""string_split(regexp_replace(regexp_replace(content, '([.!?다요음])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))"""


@query(f"""WITH sref AS ({_sql_refs("id, service_code, document_id", "content", "tb_document_chunks")}), c AS (SELECT id, service_code, document_id, unnest({_CLAIMS}) AS claim, generate_subscripts({_CLAIMS}, 1) AS pos FROM tb_document_contents),
  cl AS (SELECT id, service_code, document_id, trim(claim, ' ' || chr(10) || chr(9)) AS claim, (row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::int AS claim_no FROM c WHERE trim(claim, ' ' || chr(10) || chr(9)) <> ''),
  cr AS ({_sql_refs("id, claim_no, claim, service_code, document_id", "claim", "cl")})
  SELECT f.id AS answer_id, claim_no, claim, count(DISTINCT f.name)::int AS n_references, coalesce(list_sort(list(DISTINCT k.id) FILTER (k.id IS NOT NULL)), []) AS source_ids
  FROM cr f LEFT JOIN sref k ON k.service_code = f.service_code AND k.document_id = f.document_id AND k.name = f.name GROUP BY ALL""")
def claim_records(spark: SparkSession, d: str) -> DataFrame:
    """Statements with references and the chunks that have one of them."""
    answers, sources = _answers(spark, d)
    return verify.claim_records(answers, sources, ["service_code", "document_id"], "id", "id")


@query(_RISKS + f""", c AS (SELECT id, service_code, document_id, unnest({_CLAIMS}) AS claim, generate_subscripts({_CLAIMS}, 1) AS pos FROM tb_document_contents), cl AS (SELECT * FROM c WHERE trim(claim, ' ' || chr(10) || chr(9)) <> ''),
  cr AS ({_sql_refs("id, pos, service_code, document_id", "claim", "cl")}), cn AS ({_sql_nums("id, pos", "claim", "cl")}),
  backed AS (SELECT DISTINCT id, pos FROM cr f WHERE EXISTS (SELECT 1 FROM sref k WHERE k.service_code = f.service_code AND k.document_id = f.document_id AND k.name = f.name)),
  told AS (SELECT DISTINCT id, pos FROM (SELECT id, pos FROM cr UNION ALL SELECT id, pos FROM cn)),
  n AS (SELECT cl.id, count(*) AS claims, count(told.id) AS verifiable, count(backed.id) AS supported FROM cl LEFT JOIN told ON told.id = cl.id AND told.pos = cl.pos LEFT JOIN backed ON backed.id = cl.id AND backed.pos = cl.pos GROUP BY cl.id)
  SELECT answer_id, risk_level, coalesce(claims, 0)::int AS claims_count, coalesce(verifiable, 0)::int AS verifiable_claims_count, coalesce(supported, 0)::int AS supported_claims_count, missing AS missing_refs_count, wrong AS numeric_mismatch_count,
    round(supported / nullif(verifiable, 0)::double, 3) AS groundedness FROM verdict LEFT JOIN n ON n.id = answer_id""")
def answer_records(spark: SparkSession, d: str) -> DataFrame:
    """Verification record of every content, were it an answer from its document's other chunks."""
    answers, sources, wrong = _unsupported(spark, d)
    return verify.records(answers, wrong, sources, ["service_code", "document_id"], "id", "id").drop("warnings")


# --- requests, merging, whole plans ---------------------------------------------------------------------------------


@query("""SELECT dt, line_no, CASE WHEN length(coalesce(request.query, '')) NOT BETWEEN 1 AND 2000 THEN 'query' WHEN request.top_k NOT BETWEEN 1 AND CASE WHEN endpoint = 'answer' THEN 20 ELSE 100 END THEN 'top_k'
  WHEN request.start_page NOT BETWEEN 1 AND 99999 OR request.end_page NOT BETWEEN 1 AND 99999 THEN 'pages' WHEN len(request.include_keywords) > 20 OR len(request.exclude_keywords) > 20 THEN 'keywords' ELSE 'ok' END AS fault FROM trace_record""")
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    """The limit that each request breaks."""
    return table(spark, d, "trace_record").select("dt", "line_no", requests.request_fault(F.col("request"), F.col("endpoint")).alias("fault"))


@query(r"""WITH o AS (SELECT id, heading, unnest(image_ocr_texts) AS t, unnest(range(len(image_ocr_texts)))::int AS pos FROM tb_document_chunks),
  s AS (SELECT id, pos, regexp_replace(coalesce(heading, ''), '\s', '', 'g') AS a, regexp_replace(coalesce(t, ''), '\s', '', 'g') AS b FROM o),
  g AS (SELECT id, pos, CASE WHEN length(a) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) END AS a, CASE WHEN length(b) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) END AS b FROM s)
  SELECT id, pos, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double END, 6) AS likeness FROM g""")
def jaccard_heading(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of recognised texts to their chunk's heading."""
    texts = table(spark, d, "tb_document_chunks").select("id", "heading", F.posexplode("image_ocr_texts").alias("pos", "t"))
    return texts.select("id", "pos", F.round(requests.bigram_jaccard(F.col("heading"), F.col("t")), 6).alias("likeness"))


_BIGRAMS = "CASE WHEN length({0}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) END"


@query(rf"""WITH o AS (SELECT id, service_code, document_id, unnest(image_ocr_texts) AS x FROM tb_document_chunks), s AS (SELECT *, {_STRIP.format("coalesce(x, '')")} AS s FROM o), v AS (SELECT *, regexp_replace(lower(s), '\s', '', 'g') AS solid, regexp_replace(s, '[ \n]', '', 'g') AS dense FROM s),
  h AS (SELECT DISTINCT service_code, document_id, regexp_replace(lower(heading), '\s', '', 'g') AS h FROM tb_document_chunks WHERE heading IS NOT NULL), hg AS (SELECT service_code, document_id, {_BIGRAMS.format("h")} AS b FROM h), hs AS (SELECT service_code, document_id, list(b) AS bs FROM hg GROUP BY 1, 2),
  g AS (SELECT v.*, {_BIGRAMS.format("solid")} AS b, coalesce(bs, []) AS bs FROM v LEFT JOIN hs USING (service_code, document_id)),
  d AS (SELECT *, CASE WHEN s = '' THEN 'empty' WHEN length(s) < 10 OR regexp_matches(s, '{layout.OCR_SPECIAL}') OR regexp_matches(s, '{layout.OCR_MATH}') OR length(regexp_replace(dense, '[^가-힣a-zA-Z]', '', 'g')) < 0.3::double * length(dense) THEN 'noise'
    WHEN len(list_filter(bs, lambda y: len(list_distinct(list_concat(y, b))) > 0 AND len(list_intersect(y, b)) / len(list_distinct(list_concat(y, b)))::double > 0.7)) > 0 THEN 'duplicate' ELSE 'kept' END AS o FROM g)
  SELECT service_code, document_id, count(*) AS total, count(*) FILTER (o = 'kept') AS kept, count(*) FILTER (o = 'noise') AS noise, count(*) FILTER (o = 'duplicate') AS duplicate, count(*) FILTER (o = 'empty') AS empty, 0::bigint AS drop_only, 0::bigint AS tables_only FROM d GROUP BY 1, 2""")
def image_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the recognised texts of every document."""
    chunks = table(spark, d, "tb_document_chunks")
    images = chunks.select("service_code", "document_id", F.explode("image_ocr_texts").alias("text"))
    keys = ["service_code", "document_id"]
    return recognition.outcome_counts(recognition.judged_images(images, chunks.select(*keys, "heading"), keys), keys)


@query()
def fixed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Fixed windows of extracted texts, with the heading and pages in force."""
    return chunking.fixed_document_chunks(_extracts(spark, d), "id", "raw_markdown")


@query("""WITH b AS (SELECT service_code, document_id, id, seq, nullif(heading_path, '') AS h, start_page AS p FROM tb_document_chunks WHERE chunk_type <> 'image'),
  i AS (SELECT service_code, document_id, id, seq, nullif(heading_path, '') AS h, start_page AS p FROM tb_document_chunks WHERE chunk_type = 'image'),
  a AS (SELECT i.*, (SELECT max(seq) FROM b WHERE b.service_code = i.service_code AND b.document_id = i.document_id AND b.h = i.h) AS same, (SELECT min(seq) FROM b WHERE b.service_code = i.service_code AND b.document_id = i.document_id AND i.h IS NULL AND b.p > i.p) AS later FROM i),
  u AS (SELECT service_code, document_id, id, seq, seq AS anchor, 0 AS side FROM b UNION ALL SELECT service_code, document_id, id, seq, coalesce(same, later, 2147483647), CASE WHEN same IS NOT NULL OR later IS NULL THEN 1 ELSE -1 END FROM a)
  SELECT service_code, document_id, id, row_number() OVER (PARTITION BY service_code, document_id ORDER BY anchor, side, seq, id)::int AS seq FROM u""")
def ocr_merge(spark: SparkSession, d: str) -> DataFrame:
    """Image chunks put in their places among the other chunks."""
    c = table(spark, d, "tb_document_chunks")
    return merge.merge_images(c.where("chunk_type <> 'image'"), c.where("chunk_type = 'image'"), ["service_code", "document_id"])


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose line number is divisible by 50, guarded and routed, under a number made of day and line."""
    rows = table(spark, d, "trace_record").where("line_no % 50 = 0 and request.query <> ''").dropDuplicates(["dt", "line_no"])
    day = F.datediff(F.to_date("dt"), F.lit("1970-01-01").cast("date")).cast("long")
    return answer.prepare(rows.select((F.shiftleft(day, 40) + F.col("line_no")).alias("query_id"), "request"))


@query()
def comparison_union(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of comparisons (requests whose line number is divisible by 50) searched apart, united and reranked."""
    asked = _asked(spark, d).where(routing.decompose(F.col("query")).isNotNull()).drop("filter")
    return answer.compare(asked, table(spark, d, "tb_document_contents"), 10)


@query("""SELECT id AS chunk_id, id AS qdrant_point_id, CASE WHEN chunk_strategy = 'adaptive' AND coalesce(heading_path, '') <> '' THEN heading_path || chr(10) || chr(10) || content ELSE content END AS content,
  length(CASE WHEN chunk_strategy = 'adaptive' AND coalesce(heading_path, '') <> '' THEN heading_path || chr(10) || chr(10) || content ELSE content END)::int AS char_count FROM tb_document_chunks""")
def serving_table(spark: SparkSession, d: str) -> DataFrame:
    """Serving rows of the stored chunks."""
    return ingest.serving_table(table(spark, d, "tb_document_chunks")).select("chunk_id", "qdrant_point_id", "content", "char_count")


@query("""SELECT service_code, status_code, count(*) AS documents, round(avg(epoch_us(updated_at) - epoch_us(created_at)) / 1e6, 3) AS mean_seconds FROM tb_document_status GROUP BY ALL""")
def status_ages(spark: SparkSession, d: str) -> DataFrame:
    """Documents per service and status, and the mean time from their creation to their last change."""
    s = table(spark, d, "tb_document_status")
    seconds = F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return s.groupBy("service_code", "status_code").agg(F.count("*").alias("documents"), F.round(F.avg(seconds) / 1e6, 3).alias("mean_seconds"))


@query()
def serving_rows(spark: SparkSession, d: str) -> DataFrame:
    """Serving rows of all extracted texts."""
    return ingest.serving_rows(_extracts(spark, d))


@query()
def answer_plan(spark: SparkSession, d: str) -> DataFrame:
    """Requests (line number divisible by 50) guarded, routed, searched, given a context, answered by its first section and checked."""
    ready = _asked(spark, d)
    chunks = table(spark, d, "tb_document_chunks")
    given = answer.contexts(answer.search(ready, chunks, k=3), chunks, 600)
    return answer.answer(ready, given, lambda q, c: F.concat_ws("\n", q, F.substring_index(c, context.GLUE, 1)))


# --- streams ------------------------------------------------------------------------------------------------------


def _run(spark: SparkSession, df: DataFrame, name: str, mode: str = "update", keys: tuple[str, ...] = ()) -> DataFrame:
    return windows.run_available(df, work_folder(spark, name), work_folder(spark, f"{name}-progress"), mode, list(keys))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type, as a stream."""
    out = _run(spark, windows.tumbling(windows.read_stream(spark, d, "events"), "ts", "1 hour", ["event_type"], "value"), "tumbling", keys=("window", "event_type"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "least", "most")


@query("""WITH w AS (SELECT unnest([time_bucket(INTERVAL '15 minutes', ts), time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes', time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '30 minutes', time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '45 minutes']) AS start, event_type FROM events)
  SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour that begins every quarter, as a stream."""
    out = _run(spark, windows.sliding(windows.read_stream(spark, d, "events"), "ts", "1 hour", "15 minutes", ["event_type"]), "sliding", keys=("window", "event_type"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS c FROM events),
  b AS (SELECT user_id, ts, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with a gap of half an hour, as a stream."""
    out = _run(spark, windows.sessions(windows.read_stream(spark, d, "events"), "ts", "30 minutes", ["user_id"]), "sessions", "complete")
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT DISTINCT event_id FROM events")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Events once each, as a stream."""
    return _run(spark, windows.once(windows.read_stream(spark, d, "events").select("event_id", "ts"), "ts", ["event_id"], "40 days"), "once", "append").select("event_id")


@query("""SELECT time_bucket(INTERVAL '1 day', trace_ts) AS day, coalesce(endpoint, '?') AS endpoint, count(*) AS requests, count(error) AS errors FROM trace_record WHERE trace_ts IS NOT NULL GROUP BY 1, 2""")
def stream_traces(spark: SparkSession, d: str) -> DataFrame:
    """Requests and errors per day and endpoint, as a stream of trace files."""
    stream = windows.read_stream(spark, d, "trace_record").select(F.col("trace_ts").cast("timestamp").alias("at"), F.coalesce("endpoint", F.lit("?")).alias("endpoint"), "error")
    w = stream.withWatermark("at", windows.WATERMARK).groupBy(F.window("at", "1 day"), "endpoint").agg(F.count("*").alias("requests"), F.count("error").alias("errors"))
    return _run(spark, w, "traces", keys=("window", "endpoint")).select(F.col("window.start").alias("day"), "endpoint", "requests", "errors")
