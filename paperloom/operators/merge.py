"""Places of recognised image chunks among the chunks of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_images(base: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """All chunks in one order: keys, id, seq (from 1).

    An image with a heading path follows the last base chunk of that path; one
    without stands before the first base chunk of a later page; where there is
    none, images go to the end. Images of one place keep their own order. Both
    tables have id, seq, heading_path and start_page.
    """
    columns = [*keys, "id", "seq", F.nullif("heading_path", F.lit("")).alias("heading_path"), "start_page"]
    both = base.select(*columns, F.lit(0).alias("_image")).unionAll(images.select(*columns, F.lit(1).alias("_image")))
    own = F.when(F.col("_image") == 0, F.col("seq"))
    same_path = F.max(own).over(Window.partitionBy(*keys, "heading_path"))
    later = F.min(own).over(Window.partitionBy(*keys).orderBy(F.desc("start_page")).rangeBetween(Window.unboundedPreceding, -1))
    after = F.when(F.col("heading_path").isNotNull(), same_path)
    before = F.when(F.col("heading_path").isNull() & F.col("start_page").isNotNull(), later)
    anchor = F.when(F.col("_image") == 0, F.col("seq")).otherwise(F.coalesce(after, before, F.lit(2**31 - 1)))
    side = F.when(F.col("_image") == 0, 0).when(after.isNotNull() | before.isNull(), 1).otherwise(-1)
    placed = both.withColumn("_anchor", anchor).withColumn("_side", side)
    order = Window.partitionBy(*keys).orderBy("_anchor", "_side", "seq", "id")
    return placed.select(*keys, "id", F.row_number().over(order).alias("seq"))
