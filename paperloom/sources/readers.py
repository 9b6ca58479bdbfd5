"""Readers of traces, markdown files and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.layout import IMAGE_TAG

TRACE_SCHEMA = (
    "trace_id string, timestamp timestamp, endpoint string, "
    "request struct<query:string,service_code:string,document_id:string,start_page:int,end_page:int,include_keywords:array<string>,exclude_keywords:array<string>,top_k:int>, "
    "input_guard struct<pii_found:array<string>,pii_count:int>, route struct<strategy:string,query_type:string>, decomposition struct<method:string>, "
    "crag struct<retries:int,score_before:double,score_after:double>, retrieval struct<result_count:int,chunk_ids:array<string>,rerank_scores:array<double>>, "
    "sibling struct<expanded_section_count:int,total_chars:int>, context struct<budget_tokens:int,truncated:boolean>, "
    "verification struct<risk_level:string,claims_count:int,groundedness:double>, critic struct<invoked:boolean,failure_type:string,action_taken:string>, "
    "answer struct<length_chars:int,is_refusal:boolean>, output_guard struct<threats:array<string>>, timing_ms map<string,double>, error struct<type:string,message:string>"
)


def read_traces(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None, endpoint: str | None = None, service_code: str | None = None) -> DataFrame:
    """Trace lines of JSON directories dt=<day>; broken lines have all fields null but ``_corrupt_record``.

    The days are partitions, so others are not opened. Filters on endpoint and
    service keep broken lines out.
    """
    df = spark.read.schema(TRACE_SCHEMA + ", _corrupt_record string, dt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    if first_day:
        df = df.where(F.col("dt") >= first_day)
    if last_day:
        df = df.where(F.col("dt") <= last_day)
    if endpoint:
        df = df.where(F.col("endpoint") == endpoint)
    if service_code:
        df = df.where(F.col("request.service_code") == service_code)
    return df


def read_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Whole text files below a folder: path, text."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def first_text(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def pdf_pages(content: Column, unknown: int = 200) -> Column:
    """Pages of a PDF file's bytes: the largest /Count in it; ``unknown`` where there is none."""
    counts = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"/Count\s+(\d+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(counts, lambda n: n.try_cast("int"))), F.lit(unknown))


def image_tags(markdown: Column) -> Column:
    """Paths of the image tags of a markdown text, in order."""
    return F.regexp_extract_all(markdown, F.lit(IMAGE_TAG), F.lit(1))


def converted_well(json: Column) -> Column:
    """Whether a converter's JSON has headings and no bare text chunks, which it leaves where the layout failed."""
    return F.coalesce(json.contains('"type": "heading"') & ~json.contains('"type": "text chunk"'), F.lit(False))


def natural_key(name: Column) -> Column:
    """Array by which names sort with their numbers as numbers: page2 before page10."""
    parts = F.split(F.lower(name), r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 40, "0")).otherwise(p))


def recognition_files(spark: SparkSession, path: str) -> DataFrame:
    """Results of text recognition below a folder of ``<document>_images`` folders: document, image, data (the JSON as text), in natural order by ``image_key``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_ocr.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("data"))
    named = files.select(F.regexp_extract("p", "([^/]+)_images/[^/]+$", 1).alias("document"), F.regexp_extract("p", "([^/]+)_ocr[.]json$", 1).alias("image"), "data").where("document <> ''")
    return named.withColumn("image_key", natural_key(F.col("image")))


def of_document(df: DataFrame, service_code: str, document_id: str, order: str) -> DataFrame:
    """Rows of one document in order (chunks by seq, contents by id)."""
    return df.where((F.col("service_code") == service_code) & (F.col("document_id") == document_id)).orderBy(order)


def by_point(contents: DataFrame, point_id: int) -> DataFrame:
    """Contents behind a point of the vector index."""
    return contents.where(F.col("qdrant_point_id") == point_id)


def markdown_of(extracts: DataFrame, service_code: str, document_id: str) -> DataFrame:
    """Text of a document's newest extract, one row or none."""
    return of_document(extracts, service_code, document_id, "id").select("id", "raw_markdown").orderBy(F.desc("id")).limit(1)


def since(df: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``now``, newest first."""
    return df.where(F.col(at) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAY")).orderBy(F.desc(at))
