"""From extracted markdown to serving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.layout import normalize_text
from paperloom.operators import chunking


def serving_rows(extracts: DataFrame, key: str = "id", text: str = "raw_markdown") -> DataFrame:
    """Chunks with the text that is embedded: key, section, part_index, heading_path, chunk_type, pages, content, embed_text, char_count."""
    rows = extracts.select(key, normalize_text(F.col(text)).alias("text"))
    chunks = chunking.adaptive_chunks(rows, key, "text").withColumn("heading_path", F.array_join("heading_path", " > "))
    body = chunking.embed_text(F.col("heading_path"), F.col("content"), F.lit("adaptive"))
    return chunks.withColumn("embed_text", body).withColumn("char_count", F.length("content"))


def serving_table(chunks: DataFrame) -> DataFrame:
    """Rows of the serving table from stored chunks: the text that is embedded as content, the chunk's id as chunk_id and point id."""
    body = chunking.embed_text(F.col("heading_path"), F.col("content"), F.col("chunk_strategy"))
    return chunks.withColumn("content", body).withColumn("char_count", F.length("content")).withColumn("chunk_id", F.col("id")).withColumn("qdrant_point_id", F.col("id")).drop("id", "seq")
