"""Health of a vector index and of recognised texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.layout import ocr_verdict
from paperloom.operators.retrieval import dense_topk

DISPERSION_WARNING, CONFUSION_WARNING, LARGE = 0.85, 0.15, 100_000


def dispersion(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean and standard deviation of the cosine of all pairs, in one pass: vectors, pairs, mean, stddev, status.

    With unit rows V the pairs' cosines add up to (|sum V|^2 - n) / 2 and their
    squares to (|V'V|^2 - n) / 2, so a task sends a d x d matrix and no pair is
    made. Zero vectors count as they are, with cosine 0. Fewer than ten vectors
    are too few for a verdict.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram, n, own, own2 = None, None, 0, 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.array(batch.column(0).to_pylist(), dtype=np.float64)
            norm = np.linalg.norm(m, axis=1)
            m = m / np.where(norm == 0, 1, norm)[:, None]
            if total is None:
                total, gram = np.zeros(m.shape[1]), np.zeros((m.shape[1], m.shape[1]))
            total += m.sum(axis=0)
            gram += m.T @ m
            n += len(m)
            s = (m * m).sum(axis=1)
            own += s.sum()
            own2 += (s * s).sum()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([own]), pa.array([own2]), pa.array([total.tolist()]), pa.array([gram.ravel().tolist()])], names=["n", "own", "own2", "total", "gram"])

    parts = rows.mapInArrow(run, "n long, own double, own2 double, total array<double>, gram array<double>")
    sums = parts.select("n", "own", "own2", F.posexplode(F.concat("total", "gram")).alias("i", "x"), F.size("total").alias("d"))
    cells = sums.groupBy("i", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("own").alias("own"), F.sum("own2").alias("own2"))
    square = lambda of: F.sum(F.when(of, F.col("x") * F.col("x")).otherwise(0.0))
    s = cells.agg(F.max("n").alias("n"), F.max("own").alias("own"), F.max("own2").alias("own2"), square(F.col("i") < F.col("d")).alias("a"), square(F.col("i") >= F.col("d")).alias("b"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    s = s.withColumn("pairs", pairs.cast("long")).withColumn("mean", (F.col("a") - F.col("own")) / 2 / pairs)
    s = s.withColumn("stddev", F.sqrt(F.greatest((F.col("b") - F.col("own2")) / 2 / pairs - F.col("mean") * F.col("mean"), F.lit(0.0))))
    status = F.when(F.col("n") < 10, "insufficient").when(F.col("mean") >= DISPERSION_WARNING, "warning").otherwise("ok")
    return s.select(F.col("n").alias("vectors"), "pairs", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), status.alias("status"))


def confusion(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """Share of the top ``k`` neighbours with another label than the query's: results, wrong, rate, status.

    ``queries`` and ``vectors`` have vec_id, embedding and label; a query's own row does not count.
    """
    hits = dense_topk(queries.select(F.col("vec_id").alias("query_id"), "embedding"), vectors, k + 1)
    hits = hits.where("row_id <> query_id")
    top = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k)
    labels = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label")
    j = top.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")), "query_id").join(labels.select(F.col("vec_id").alias("row_id"), F.col("label").alias("got")), "row_id")
    s = j.agg(F.count("*").alias("results"), F.count_if(F.col("asked") != F.col("got")).alias("wrong"))
    r = F.round(F.col("wrong") / F.nullif(F.col("results"), F.lit(0)), 4)
    return s.withColumn("rate", r).withColumn("status", F.when(r >= CONFUSION_WARNING, "warning").otherwise("ok"))


def document_distribution(points: DataFrame) -> DataFrame:
    """Rows per document and their share of all in percent; rows without document are "unknown"."""
    per = points.groupBy(F.coalesce("document_id", F.lit("unknown")).alias("document_id")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("document_id", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 4).alias("percent"))


def recognised_texts(chunks: DataFrame) -> DataFrame:
    """Recognised texts of every document by verdict: service_code, document_id, verdict, n, chars."""
    texts = chunks.select("service_code", "document_id", F.explode("image_ocr_texts").alias("text"))
    return texts.groupBy("service_code", "document_id", ocr_verdict(F.col("text")).alias("verdict")).agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
