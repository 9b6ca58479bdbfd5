"""Queries of the training-data operators and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, leakage, ocr_repair, packing, pii, quantiles, subjects
from paperloom.session import table


def p1_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Context of every serving content."""
    return packing.pack_contents(table(spark, d, "tb_document_contents"))


def p1_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the contexts are."""
    return packing.fill_report(packing.pack_contents(table(spark, d, "tb_document_contents")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of personal data in each record and field."""
    return pii.find_personal_data(table(spark, d, "trace_record"), table(spark, d, "tb_query_feedback"))


def p2_masked_requests(spark: SparkSession, d: str) -> DataFrame:
    """trace_record.request with typed, format-preserving placeholders."""
    traces, feedback = table(spark, d, "trace_record"), table(spark, d, "tb_query_feedback")
    syllables = pii.learn_syllables(pii.user_texts(traces, feedback))
    return pii.mask_traces(traces.select("dt", "line_no", "trace_id", "request"), syllables)


def p2_masked_feedback(spark: SparkSession, d: str) -> DataFrame:
    """tb_query_feedback.free_text with typed, format-preserving placeholders."""
    traces, feedback = table(spark, d, "trace_record"), table(spark, d, "tb_query_feedback")
    syllables = pii.learn_syllables(pii.user_texts(traces, feedback))
    return pii.mask_feedback(feedback, syllables)


def p3_daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Bucket counts of every day, endpoint and span."""
    return quantiles.daily_sketches(table(spark, d, "trace_record"))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Latency percentiles per endpoint and span, from the days' sketches, to nine digits, as two engines agree on no more."""
    found = quantiles.latency_percentiles(table(spark, d, "trace_record"))
    return found.withColumns({c: F.format_string("%.8e", c).cast("double") for c in found.columns if c[0] == "p"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Noisy lines of scanned texts and the kinds of their noise."""
    return ocr_repair.find_noise(table(spark, d, "tb_document_extract"), table(spark, d, "tb_document_chunks"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Scanned texts repaired into continuous paragraphs."""
    return ocr_repair.repair(table(spark, d, "tb_document_extract"), table(spark, d, "tb_document_chunks"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """byte_bpe_50k ids of every document."""
    return bpe.encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold evaluation items, whole or half."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items and documents per suite and language."""
    return leakage.leak_report(p7_found(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of every document."""
    return subjects.assign_subjects(table(spark, d, "documents"), table(spark, d, "doc_subject_labels"), table(spark, d, "subject_areas"))


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """The mined rules after pruning."""
    chosen = subjects.chosen_labels(table(spark, d, "doc_subject_labels")).where("not held")
    return subjects.mine_rules(subjects.labelled_sentences(table(spark, d, "documents"), chosen))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Corpus by subject and language."""
    return subjects.composition(table(spark, d, "documents"), p8_found(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_contexts": p1_contexts,
    "p1_fill": p1_fill,
    "p2_found": p2_found,
    "p2_masked_requests": p2_masked_requests,
    "p2_masked_feedback": p2_masked_feedback,
    "p3_daily_sketches": p3_daily_sketches,
    "p3_percentiles": p3_percentiles,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_rules": p8_rules,
    "p8_composition": p8_composition,
}

_SPANS = """
spans AS (
  SELECT day, endpoint, unnest(map_keys(timing_ms)) AS span, unnest(map_values(timing_ms)) AS ms FROM (
    SELECT coalesce(trace_ts::date, dt::date) AS day, timing_ms,
      CASE WHEN endpoint IS NULL OR trim(lower(endpoint), ' /') = '' THEN 'unknown' ELSE trim(lower(endpoint), ' /') END AS endpoint
    FROM trace_record
    QUALIFY trace_id IS NULL OR row_number() OVER (PARTITION BY trace_id ORDER BY dt, line_no) = 1)),
buckets AS (
  SELECT day, endpoint, span, CASE WHEN abs(ms) < 1e-9 THEN 0
    ELSE sign(ms)::int * (ceil(ln(abs(ms)) / ln(1.01::double / 0.99::double))::int + 1000000) END AS bucket
  FROM spans WHERE ms IS NOT NULL AND isfinite(ms))"""

_PICK = ", ".join(
    f"printf('%.8e', min(CASE WHEN upto > floor({p / 100} * (total - 1)) THEN CASE WHEN bucket = 0 THEN 0.0 ELSE sign(bucket) * (2 / (1.01::double / 0.99::double + 1)) * pow(1.01::double / 0.99::double, abs(bucket) - 1000000) END END))::double AS p{p}"
    for p in (50, 75, 90, 95, 99)
)

ORACLE_SQL: dict[str, str] = {
    "p3_daily_sketches": f"WITH {_SPANS} SELECT day AS trace_day, endpoint, span, bucket, count(*) AS n FROM buckets GROUP BY ALL",
    "p3_percentiles": f"""WITH {_SPANS}, counts AS (SELECT endpoint, span, bucket, count(*) AS n FROM buckets GROUP BY ALL),
      run AS (SELECT *, sum(n) OVER (PARTITION BY endpoint, span ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY endpoint, span) AS total FROM counts)
      SELECT endpoint, span, sum(n)::bigint AS n, {_PICK}, 0.01::double AS relative_error, 1e-9::double AS zero_below FROM run GROUP BY endpoint, span""",
}
