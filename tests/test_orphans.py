"""Orphan references against small tables with known answers."""

from paperloom.operators import orphans

CONTENTS = "id long, chunk_id long, qdrant_point_id long, created_at timestamp_ntz, name string"
POINTS = "op_id long, point_id long, op_kind string, service_code string, document_id string, op_at timestamp_ntz"


def at(minute):
    import datetime as dt

    return dt.datetime(2025, 3, 1, 0, minute)


def sides(spark, feedback=(), contents=(), traces=(), chunks=(), points=()):
    return orphans.reference_sides(
        spark.createDataFrame(list(feedback), "id long, trace_id string, created_at timestamp_ntz, key string"),
        spark.createDataFrame(list(contents), CONTENTS),
        spark.createDataFrame(list(traces), "trace_id string, id long"),
        spark.createDataFrame(list(chunks), "id long, _key string"),
        spark.createDataFrame(list(points), POINTS),
    )


def found(spark, **tables):
    return sorted(map(tuple, orphans.orphan_rows(*sides(spark, **tables)).collect()))


def test_keys_ignore_case_and_blanks_and_null_references_are_none(spark):
    rows = found(
        spark,
        feedback=[(1, " AB ", at(0), "x"), (2, "　ab\t", at(0), "x"), (3, "  ", at(0), None), (4, None, at(0), None), (5, "gone", None, None), (5, "gone", None, None)],
        traces=[("ab", 1), (None, 2), ("ab", 3)],
    )
    assert ("tb_query_feedback", "trace_id", 5) in rows and {r[2] for r in rows} == {5}


def test_empty_tables(spark):
    assert found(spark) == []
    assert orphans.orphan_report(*sides(spark)).count() == 0


def test_points_after_all_operations(spark):
    points = [
        (5, 1, "UPSERT", "A", "d", at(1)), (4, None, "delete", "A", "d", at(2)), (3, 2, "upsert", "A", "d", at(3)),
        (2, 3, "upsert", "A", "e", at(1)), (1, 3, "Delete", "A", "e", at(4)), (6, 4, "upsert", None, None, at(1)), (7, None, "DELETE", None, None, at(1)),
        (8, 5, "upsert", "A", "d", at(2)),
    ]
    left = orphans.present_points(spark.createDataFrame(points, POINTS))
    # 1 went with its document, 3 was deleted, 4 went at the same time by a later op_id, 5 came at the time of the delete with a later op_id
    assert {r[0] for r in left.collect()} == {2, 5}


def test_report_adds_up_and_hot_key_is_whole(spark):
    contents = [(i, 7, None, at(0), "a") for i in range(900)] + [(1000 + i, 8, 9, at(1), "b") for i in range(50)]
    parts = sides(spark, contents=contents, chunks=[(8, "k")])
    rows = orphans.orphan_rows(*parts)
    assert rows.count() == 950
    report = {(r["field_name"]): (r["n_references"], r["n_keys"]) for r in orphans.orphan_report(*parts).collect()}
    assert report == {"chunk_id": (900, 1), "qdrant_point_id": (50, 1)}
