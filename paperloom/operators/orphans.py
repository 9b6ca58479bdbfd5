"""References to records that do not exist.

Method: the keys of parents and children are put in one long table, tagged by
the parent table they belong to; it is grouped by parent table and key, and the
groups without a parent flag are the missing targets. Counts by period are sums
over those groups.

Rows are pre-aggregated before every shuffle, so a key that a third of all rows
name costs one row per map task. Where the referring rows themselves are wanted,
they meet the missing keys in a salted join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def clean_key(column: Column) -> Column:
    """Key text without surrounding white space (of any script), in lower case; blank becomes null."""
    return F.nullif(F.lower(F.regexp_replace(column.cast("string"), r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))


def parent_keys(df: DataFrame, parent: str, key: Column) -> DataFrame:
    """Distinct keys that exist, tagged with the name of the parent table."""
    return df.select(F.lit(parent).alias("_parent"), key.cast("string").alias("_key")).where("_key is not null").distinct()


def child_keys(df: DataFrame, parent: str, table_name: str, field_name: str, key: Column, row_id: Column, at: Column) -> DataFrame:
    """Referring rows in long form; rows whose reference is null are no references and are left out."""
    return df.select(
        F.lit(parent).alias("_parent"), key.cast("string").alias("_key"), F.lit(table_name).alias("table_name"),
        F.lit(field_name).alias("field_name"), row_id.cast("long").alias("row_id"), F.to_date(at).alias("day"),
    ).where("_key is not null")


def present_points(ops: DataFrame) -> DataFrame:
    """Points of a collection that remain after all of its operations.

    Operations count in the order of (op_at, op_id); op_kind in any letter case.
    A delete without point_id removes all points its document has at that time.
    So a point remains if its last own operation is an upsert, and its document
    (of that upsert) has no later whole-document delete. Operations with a null
    time come first; an upsert without point_id makes no point. Returns
    ``point_id``, one row each.
    """
    order = F.struct("op_at", "op_id").alias("_order")
    ops = ops.select(F.lower(F.trim("op_kind")).alias("_kind"), "point_id", "service_code", "document_id", order)
    last = (
        ops.where("point_id is not null and _kind in ('upsert', 'delete')")
        .groupBy("point_id")
        .agg(F.max(F.struct("_order", "_kind", "service_code", "document_id")).alias("_last"))
        .where("_last._kind = 'upsert'")
        .select("point_id", "_last._order", "_last.service_code", "_last.document_id")
    )
    wiped = ops.where("point_id is null and _kind = 'delete'").groupBy("service_code", "document_id").agg(F.max("_order").alias("_wiped"))
    salted = wiped.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = last.withColumn("_salt", F.pmod(F.xxhash64("point_id"), F.lit(SALTS)).cast("int"))
    same = (
        (left["_salt"] == salted["_salt"])
        & left["service_code"].eqNullSafe(salted["service_code"])
        & left["document_id"].eqNullSafe(salted["document_id"])
        & (salted["_wiped"] > left["_order"])
    )
    return left.join(salted, same, "left_anti").select("point_id")


def missing_keys(parents: list[DataFrame], children: list[DataFrame]) -> DataFrame:
    """(_parent, _key) of every key that is referred to and has no parent row."""
    tagged = [p.select("_parent", "_key", F.lit(1).alias("_is_parent")) for p in parents]
    tagged += [c.select("_parent", "_key", F.lit(0).alias("_is_parent")) for c in children]
    return (
        reduce(DataFrame.unionAll, tagged).groupBy("_parent", "_key").agg(F.max("_is_parent").alias("_found"))
        .where("_found = 0").select("_parent", "_key")
    )


def orphan_rows(parents: list[DataFrame], children: list[DataFrame]) -> DataFrame:
    """One row (table_name, field_name, row_id) per reference without a target.

    Repeated referring rows are given once each; empty tables give no rows.
    """
    gone = missing_keys(parents, children).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = reduce(DataFrame.unionAll, children).withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    return rows.join(gone, ["_parent", "_key", "_salt"], "left_semi").select("table_name", "field_name", "row_id")


def orphan_report(parents: list[DataFrame], children: list[DataFrame]) -> DataFrame:
    """Orphan references per table, field and day: n_references and n_keys."""
    tagged = [p.select("_parent", "_key", F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("date").alias("day"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("_is_parent")) for p in parents]
    tagged += [c.groupBy("_parent", "_key", "table_name", "field_name", "day").agg(F.count("*").alias("n")).withColumn("_is_parent", F.lit(0)) for c in children]
    one = F.struct("table_name", "field_name", "day", "n")
    grouped = (
        reduce(DataFrame.unionAll, tagged).groupBy("_parent", "_key")
        .agg(F.max("_is_parent").alias("_found"), F.collect_list(F.when(F.col("_is_parent") == 0, one)).alias("_uses"))
        .where("_found = 0")
    )
    return (
        grouped.select(F.inline("_uses")).groupBy("table_name", "field_name", "day")
        .agg(F.sum("n").alias("n_references"), F.count("*").alias("n_keys"))
    )


def reference_sides(feedback: DataFrame, contents: DataFrame, traces: DataFrame, chunks: DataFrame, points: DataFrame):
    """Parents and children of the three references that the project's tables hold."""
    parents = [
        parent_keys(traces, "trace_record", clean_key(F.col("trace_id"))),
        parent_keys(chunks, "tb_document_chunks", F.col("id")),
        parent_keys(present_points(points), "vector_points", F.col("point_id")),
    ]
    children = [
        child_keys(feedback, "trace_record", "tb_query_feedback", "trace_id", clean_key(F.col("trace_id")), F.col("id"), F.col("created_at")),
        child_keys(contents, "tb_document_chunks", "tb_document_contents", "chunk_id", F.col("chunk_id"), F.col("id"), F.col("created_at")),
        child_keys(contents, "vector_points", "tb_document_contents", "qdrant_point_id", F.col("qdrant_point_id"), F.col("id"), F.col("created_at")),
    ]
    return parents, children
