"""Writers: append-only traces, replacement of whole documents, checked feedback."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.traces import SIGNALS
from paperloom.session import cut


def append_traces(df: DataFrame, path: str, at: str = "timestamp") -> None:
    """Trace rows as JSON lines below the UTC day of their time."""
    df.withColumn("dt", F.date_format(at, "yyyy-MM-dd")).write.mode("append").partitionBy("dt").json(path)


BUCKETS = 256  # directories of a table of documents


def replace_documents(df: DataFrame, path: str, keys: tuple[str, ...] = ("service_code", "document_id"), buckets: int = BUCKETS) -> None:
    """Write rows so that each document that ``df`` has replaces all of its earlier rows; others stay.

    Documents lie in buckets by the hash of their key; only the buckets that
    ``df`` touches are read and written anew. They are put beside the table
    first, so that nothing is read from what is overwritten.
    """
    spark = df.sparkSession
    new = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.parquet(path)
    except AnalysisException:  # no table yet
        old = None
    if old is not None:
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        kept = old.where(F.col("bucket").isin(touched)).join(new.select(*keys).distinct(), list(keys), "left_anti")
        new = cut(new.unionByName(kept.select(*new.columns)))
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Old and new rows with the newest of each key."""
    both = old.unionByName(new)
    body = F.struct(*[c for c in both.columns if c not in keys])
    return both.groupBy(*keys).agg(F.max_by(body, at).alias("_b")).select(*keys, "_b.*").select(*both.columns)


def valid_feedback(df: DataFrame) -> DataFrame:
    """Feedback with a known signal; the trace it names is not checked."""
    return df.where(F.col("signal").isin(*SIGNALS))


def without_nul(text: Column) -> Column:
    """Text without NUL characters and their JSON escapes, which databases refuse."""
    return F.regexp_replace(F.regexp_replace(text, "\x00", ""), r"\\u0000", "")


def is_plain_name(name: Column) -> Column:
    """Whether a file name is a bare name: not blank, no folders."""
    return F.coalesce((F.trim(name) != "") & ~name.rlike(r"[/\\]") & ~name.isin(".", ".."), F.lit(False))
