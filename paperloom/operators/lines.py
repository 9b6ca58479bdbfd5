"""Documents as lines: pages, headings, table blocks, contents lists.

Windows run within one document, so their size is that of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.layout import heading_level, heading_text, is_noise_line, is_table_line, is_toc_title, page_of_mark
from paperloom.functions.rx import has, rx, strip


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), line; null texts have no lines."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))


def pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pages of a text by its page marks: key, page, content; text before the first mark is page 1, blank pages are dropped."""
    mark = r"<!--\s*page:(\d+)\s*-->"
    parts = F.split(F.col(text), rx(mark), -1)
    numbers = F.concat(F.array(F.lit("1")), F.regexp_extract_all(F.col(text), F.lit(rx(mark)), F.lit(1)))
    each = F.explode(F.arrays_zip(numbers.alias("page"), parts.alias("content")))
    rows = df.where(F.col(text).isNotNull()).select(key, each.alias("p"))
    return rows.select(key, F.col("p.page").cast("int").alias("page"), strip(F.col("p.content")).alias("content")).where("content <> ''")


def heading_paths(lines: DataFrame, key: str) -> DataFrame:
    """Adds level, heading_path (array) and page to lines.

    The heading of level k in force at a line is on its path if it comes after
    every heading in force of a lower level number.
    """
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("level", heading_level(F.col("line"))).withColumn("_title", heading_text(F.col("line")))
    df = df.withColumn("page", F.last(page_of_mark(F.col("line")), ignorenulls=True).over(so_far))
    for k in range(1, 7):
        df = df.withColumn(f"_h{k}", F.max(F.when(F.col("level") == k, F.struct("pos", "_title"))).over(so_far))
    path = []
    for k in range(1, 7):
        above = [F.coalesce(F.col(f"_h{j}.pos"), F.lit(-1)) for j in range(1, k)]
        on = F.col(f"_h{k}").isNotNull() & (F.col(f"_h{k}.pos") > (F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1)))
        path.append(F.when(on, F.col(f"_h{k}._title")))
    df = df.withColumn("heading_path", F.array_compact(F.array(*path)))
    return df.drop("_title", *[f"_h{k}" for k in range(1, 7)])


def table_blocks(lines: DataFrame, key: str) -> DataFrame:
    """Adds is_table, block (number of the run of table or other lines) and is_junk (a table of one column)."""
    w = Window.partitionBy(key).orderBy("pos")
    df = lines.withColumn("is_table", is_table_line(F.col("line")))
    change = F.when(F.col("is_table") == F.lag("is_table").over(w), 0).otherwise(1)
    df = df.withColumn("_change", change).withColumn("block", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")
    inner = F.regexp_replace(strip(F.col("line")), r"^\|+|\|+$", "")
    wide = ~has(inner, r"^[\s\-:]+$") & inner.contains("|")
    return df.withColumn("is_junk", F.col("is_table") & ~F.max(wide).over(Window.partitionBy(key, "block")))


def without_contents(lines: DataFrame, key: str) -> DataFrame:
    """Lines without the sections of a table of contents: from its heading to the next heading of its level or above."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("_level", heading_level(F.col("line")))
    df = df.withColumn("_toc", F.when(is_toc_title(heading_text(F.col("line"))), F.col("_level")))
    df = df.withColumn("_at", F.max(F.when(F.col("_toc").isNotNull(), F.struct("pos", "_toc"))).over(so_far))
    after = Window.partitionBy(key, F.col("_at.pos")).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    closes = F.col("_level").isNotNull() & (F.col("_level") <= F.col("_at._toc")) & F.col("_toc").isNull()
    df = df.withColumn("_closed", F.max(F.when(closes, F.lit(True))).over(after))
    return df.where(F.col("_at").isNull() | F.coalesce(F.col("_closed"), F.lit(False))).drop("_level", "_toc", "_at", "_closed")


def clean_lines(lines: DataFrame, key: str) -> DataFrame:
    """Lines without one-column tables, page marks and noise; over-deep heading marks are taken off."""
    df = table_blocks(lines, key)
    kept = df.where(~F.col("is_junk") & page_of_mark(F.col("line")).isNull() & ~is_noise_line(F.col("line")))
    return kept.withColumn("line", F.regexp_replace("line", r"(?U)^#{7,}\s+", "")).drop("is_table", "block", "is_junk")


def join_lines(lines: DataFrame, key: str, name: str = "text") -> DataFrame:
    """One text per key, its lines in order, trimmed."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return lines.groupBy(key).agg(strip(F.array_join(ordered, "\n")).alias(name))
