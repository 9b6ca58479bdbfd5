"""Context of hits: sibling parts of their sections, and packing under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIBLINGS = 2  # parts kept on each side of a hit
GLUE = "\n\n---\n\n"


def sibling_window(hits: DataFrame, chunks: DataFrame, around: int = SIBLINGS, across_documents: bool = False) -> DataFrame:
    """Parts around each hit in its section, each once: query_id, chunk_id, part_index, heading_path, content.

    ``hits`` has query_id, rank and the hit's chunk columns. The first hit of a
    section counts. Hits without heading path or with one part are kept as they
    are. Sections are told apart by document, too, unless ``across_documents``.
    """
    columns = ["service_code", "document_id", "heading_path", "part_index", "part_total", "content"]
    h = hits.withColumn("_part", F.coalesce("part_index", F.lit(1))).withColumn("_total", F.coalesce("part_total", F.lit(1)))
    alone = h.where((F.coalesce("heading_path", F.lit("")) == "") | (F.col("_total") <= 1))
    many = h.where((F.coalesce("heading_path", F.lit("")) != "") & (F.col("_total") > 1))
    section = ["query_id", "heading_path"] + ([] if across_documents else ["service_code", "document_id"])
    first = many.groupBy(*section).agg(F.min_by(F.struct("_part", "_total"), F.struct("rank", "chunk_id")).alias("_hit"))
    first = first.withColumn("_low", F.greatest(F.lit(1), F.col("_hit._part") - around)).withColumn("_high", F.least(F.col("_hit._total"), F.col("_hit._part") + around))
    parts = chunks.select(F.col("id").alias("chunk_id"), *columns)
    on = [c for c in section if c != "query_id"]
    found = parts.join(first, on).where("part_index between _low and _high").select("query_id", "chunk_id", "heading_path", "part_index", "content")
    kept = alone.select("query_id", "chunk_id", "heading_path", F.col("_part").alias("part_index"), "content")
    return found.unionByName(kept).dropDuplicates(["query_id", "chunk_id"])


def group_sections(parts: DataFrame) -> DataFrame:
    """One text per query: sections by path, parts in order, the path above each section."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part_index", "chunk_id", "content"))), lambda p: p["content"])
    body = F.array_join(ordered, "\n\n")
    path = F.coalesce("heading_path", F.lit(""))
    sections = parts.groupBy("query_id", path.alias("path")).agg(body.alias("body"))
    text = F.when(F.col("path") == "", F.col("body")).otherwise(F.concat("path", F.lit("\n\n"), "body"))
    rows = sections.select("query_id", F.struct("path", text.alias("text")).alias("s"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), GLUE).alias("context"))


def token_count(text: Column) -> Column:
    """Default token count where no tokenizer is given: half the characters."""
    return F.floor(F.length(text) / 2)


def budget(prompt: Column | int, window: int = 8192, answer: int = 2048, safety: int = 256) -> Column:
    """Tokens left for the context."""
    prompt = F.lit(prompt) if isinstance(prompt, int) else prompt
    return F.lit(window - answer - safety) - prompt


def fit_budget(context: Column, tokens: Column, most: Column) -> Column:
    """struct(text, truncated): sections in order as long as they fit, larger ones left out; none fits: a cut text.

    A section's tokens are its share of the context's.
    """
    rate = tokens / F.greatest(F.length(context), F.lit(1))
    sections = F.split(context, "\\Q" + GLUE + "\\E")
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        need = F.greatest(F.lit(1), F.floor(F.length(s) * rate)).cast("long")
        more = F.struct((acc["used"] + need).alias("used"), F.concat(acc["kept"], F.array(s)).alias("kept"))
        return F.when(acc["used"] + need <= most, more).otherwise(acc)

    kept = F.aggregate(sections, state, step)["kept"]
    cut = F.substring(context, 1, F.greatest(F.floor(most / F.greatest(rate, F.lit(1e-9))), F.lit(0)).cast("int"))
    whole = F.struct(context.alias("text"), F.lit(False).alias("truncated"))
    short = F.struct(F.when(F.size(kept) > 0, F.array_join(kept, GLUE)).otherwise(cut).alias("text"), F.lit(True).alias("truncated"))
    return F.when(tokens <= most, whole).otherwise(short)
