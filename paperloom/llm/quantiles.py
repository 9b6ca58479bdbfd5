"""Percentiles of very large numeric columns with a guaranteed relative error.

Method: every value is counted in a signed logarithmic bucket whose bounds grow
by the factor gamma = (1 + a) / (1 - a). The middle of a bucket (in the relative
sense) is within ``a`` of every value in it, so any percentile read from the
counts is within ``a`` of a value of exactly that rank. Sketches of different
days or shares are combined by adding the counts of equal buckets; that is a
plain ``sum``, so partial aggregation makes it cheap and no order matters.

A sketch is a table: group columns, ``bucket`` (signed: sign and log index),
``n``. Its size is bounded by the range of the values, not by their number: at
a = 1 % some 1,500 buckets span 1e-6 .. 1e7 for each sign.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import cut

#: Magnitudes below this are counted as zero, so the index stays bounded.
SMALLEST = 1e-9
OFFSET = 1_000_000
LINES_A_DAY = 1 << 40
BROADCAST_IDS = 200_000  # trace ids with several lines that may be broadcast; more are joined by shuffle


def gamma(alpha: float) -> float:
    """Ratio of a bucket's bounds for a relative error ``alpha``."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def bucket_of(value: Column, alpha: float) -> Column:
    """Signed bucket: 0 for zero, +-(OFFSET + index) otherwise; order follows the values."""
    index = F.ceil(F.log(F.abs(value)) / F.lit(math.log(gamma(alpha)))).cast("int") + F.lit(OFFSET)
    return F.when(F.abs(value) < F.lit(SMALLEST), F.lit(0)).when(value > 0, index).otherwise(-index)


def value_of(bucket: Column, alpha: float) -> Column:
    """The value that represents a bucket, within ``alpha`` of all that it holds."""
    g = gamma(alpha)
    size = F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.abs(bucket) - F.lit(OFFSET))
    return F.when(bucket == 0, F.lit(0.0)).when(bucket > 0, size).otherwise(-size)


def build_sketch(df: DataFrame, groups: list[str], value: str, alpha: float = 0.01) -> DataFrame:
    """Bucket counts of ``value`` per group. Null, NaN and infinite values are not counted; null groups are groups."""
    v = F.col(value).cast("double")
    kept = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return kept.groupBy(*groups, bucket_of(v, alpha).alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: list[DataFrame], groups: list[str]) -> DataFrame:
    """One sketch from several of the same ``alpha``: counts of matching buckets are added."""
    return reduce(DataFrame.unionByName, sketches).groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))


def read_percentiles(sketch: DataFrame, groups: list[str], percents: list[float], alpha: float = 0.01) -> DataFrame:
    """Percentiles of a sketch: group columns, ``n``, a column ``p<percent>`` each, and the bounds of the error.

    A percentile is within ``relative_error`` of a value of that rank; values
    smaller than ``zero_below`` are counted as zero.

    The rank read is floor(p / 100 * (n - 1)), counted from 0. An empty sketch
    gives no rows. The running count spans the buckets of a group only, whose
    number the value range bounds.
    """
    running = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    rows = sketch.withColumn("_upto", F.sum("n").over(running)).withColumn("_all", F.sum("n").over(whole))
    picks = []
    for p in percents:
        rank = F.floor(F.lit(p / 100.0) * (F.col("_all") - 1))
        picks.append(F.min(F.when(F.col("_upto") > rank, value_of(F.col("bucket"), alpha))).alias(f"p{p:g}".replace(".", "_")))
    return rows.groupBy(*groups).agg(F.sum("n").alias("n"), *picks).withColumn("relative_error", F.lit(alpha)).withColumn("zero_below", F.lit(SMALLEST))


def endpoint_name(column: Column) -> Column:
    """Endpoint without case, blanks and slashes around it; null or blank is 'unknown'."""
    name = F.lower(F.regexp_replace(column, r"(?U)^[\s/]+|[\s/]+$", ""))
    return F.when(column.isNull() | (name == ""), F.lit("unknown")).otherwise(name)


def line_order(traces: DataFrame) -> Column:
    """Place of a line by (dt, line_no) as one number; lines without a day or number come last."""
    day = F.coalesce(F.datediff(F.expr("try_to_date(dt)"), F.lit("1970-01-01").cast("date")), F.lit(100_000)).cast("long")
    return day * F.lit(LINES_A_DAY) + F.coalesce(F.col("line_no"), F.lit(LINES_A_DAY - 1))


def span_values(traces: DataFrame) -> DataFrame:
    """One row per trace and span: trace_day, endpoint, span, ms.

    A trace_id counts once: of its lines, the first by (dt, line_no). Lines
    without trace_id are all kept, since nothing says that they are copies. The
    day is that of the trace's own time, else the directory day. A line that is
    repeated whole counts once; of two lines with one id and place, the larger
    value of a span counts.

    Only ids and places are shuffled to find the ids with several lines; the
    timings of other lines stay where they are.
    """
    rows = traces.select(
        "trace_id", line_order(traces).alias("_line"), F.coalesce(F.to_date("trace_ts"), F.expr("try_to_date(dt)")).alias("trace_day"), endpoint_name(F.col("endpoint")).alias("endpoint"), "timing_ms",
    )
    several = rows.where("trace_id is not null").groupBy("trace_id").agg(F.min("_line").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("trace_id", "_first")
    several = cut(several)
    if several.count() <= BROADCAST_IDS:
        several = F.broadcast(several)
    spans = ["trace_day", "endpoint", F.explode("timing_ms").alias("span", "ms")]
    once = rows.join(several, "trace_id", "left_anti").select(*spans)
    first = rows.join(several, "trace_id").where("_line = _first").select("trace_id", *spans)
    first = first.groupBy("trace_id", "trace_day", "endpoint", "span").agg(F.max("ms").alias("ms")).drop("trace_id")
    return once.unionByName(first)


def daily_sketches(traces: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Sketch per day, endpoint and span: what is kept of each day and combined later.

    ``traces`` are the lines of all days at once: a sketch of one day's lines
    alone would count a trace that another day repeats.
    """
    return build_sketch(span_values(traces), ["trace_day", "endpoint", "span"], "ms", alpha)


def latency_percentiles(traces: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Percentiles per endpoint and span over all days, from the days' sketches."""
    groups = ["endpoint", "span"]
    return read_percentiles(merge_sketches([daily_sketches(traces, alpha)], groups), groups, [50, 75, 90, 95, 99], alpha)
