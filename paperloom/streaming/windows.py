"""Streaming aggregates: windows with a watermark, sessions, first-seen rows, running traces."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "10 minutes"


def read_stream(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A parquet table as a stream of its files; times without zone are taken as UTC, as watermarks need an instant."""
    schema = spark.read.parquet(f"{path}/{table}.parquet").schema
    files = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    rows = files.parquet(path).where(F.col("_metadata.file_path").contains(f"/{table}.parquet"))
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def tumbling(stream: DataFrame, at: str, length: str, keys: list[str], value: str, watermark: str = WATERMARK) -> DataFrame:
    """Rows, sum and extremes per window and key; rows later than the watermark are dropped by the stream."""
    w = stream.withWatermark(at, watermark).groupBy(F.window(at, length), *keys)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def sliding(stream: DataFrame, at: str, length: str, slide: str, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """Rows per overlapping window and key."""
    return stream.withWatermark(at, watermark).groupBy(F.window(at, length, slide), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """Rows per session of a key: a session ends where ``gap`` passes without a row."""
    return stream.withWatermark(at, watermark).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))


def once(stream: DataFrame, at: str, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a streaming query over what is there now and return the table it wrote.

    Progress is kept in ``checkpoint``, so a run that was cut off goes on where
    it stopped. In mode append, windows that the watermark has not closed stay
    in the state. In mode update, every batch writes the windows that it changed
    to a folder of its own, and the newest row of each of ``keys`` counts; closed
    windows leave the state. Mode complete keeps all windows in the state and
    writes all of them in every batch: for sessions, which have no update mode,
    and comparisons only.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(target if mode == "complete" else f"{target}/batch={number}")

    stream = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (stream.format("parquet").option("path", target) if mode == "append" else stream.foreachBatch(write)).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.parquet(target)
    try:
        rows = spark.read.parquet(target)
    except AnalysisException:  # nothing has come yet
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        return rows
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_b")).select(*keys, "_b.*").select(*df.columns)
