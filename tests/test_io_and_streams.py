"""Readers, writers and streams round trip; every registered query has a stable schema."""

import datetime as dt
import json

import __spark_entry__ as entry
from paperloom.session import cut
from paperloom.sources import readers, writers
from paperloom.streaming import windows
from pyspark.sql import functions as F


def test_traces_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2025, 3, 1, 23, 59), "answer"), ("b", dt.datetime(2025, 3, 2, 0, 1), None)], "trace_id string, timestamp timestamp, endpoint string")
    writers.append_traces(df, str(tmp_path / "t"))
    (tmp_path / "t" / "dt=2025-03-02" / "broken.json").write_text('{"trace_id": \n' + json.dumps({"trace_id": "c", "endpoint": "answer", "timing_ms": {"total": 1.5}}) + "\n")
    got = readers.read_traces(spark, str(tmp_path / "t"))
    assert {r["trace_id"] for r in got.collect()} == {"a", "b", "c", None}
    assert {r["trace_id"] for r in readers.read_traces(spark, str(tmp_path / "t"), first_day="2025-03-02", endpoint="answer").collect()} == {"c"}


def test_documents_are_replaced_whole(spark, tmp_path):
    schema = "service_code string, document_id string, seq int"
    writers.replace_documents(spark.createDataFrame([("A", "x", 1), ("A", "x", 2), ("A", "y", 1)], schema), str(tmp_path / "c"))
    writers.replace_documents(spark.createDataFrame([("A", "x", 9)], schema), str(tmp_path / "c"))
    assert sorted((r["document_id"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [("x", 9), ("y", 1)]


def test_upsert_and_feedback(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "c", 2)], "k int, v string, at int")
    assert {(r["k"], r["v"]) for r in writers.upsert(old, new, ["k"], "at").collect()} == {(1, "c"), (2, "b")}
    f = spark.createDataFrame([("up",), ("no",), (None,)], "signal string")
    assert writers.valid_feedback(f).count() == 1


def test_small_helpers(spark):
    df = spark.createDataFrame([("a\x00b\\u0000c", "../x", "![image 1](p/q.png) ![image 2](r.png)", bytearray(b"/Count 3 /Count 12"))], "t string, n string, m string, b binary")
    row = df.select(writers.without_nul(F.col("t")).alias("t"), writers.is_plain_name(F.col("n")).alias("n"), readers.image_tags(F.col("m")).alias("m"), readers.pdf_pages(F.col("b")).alias("p"), readers.first_text(F.lit(""), F.lit("x")).alias("f")).first()
    assert tuple(row) == ("abc", False, ["p/q.png", "r.png"], 12, "x")


def test_rows_of_a_document(spark):
    df = spark.createDataFrame([(2, "A", "x", 1, 7), (1, "A", "x", 2, 8), (3, "B", "x", 1, None), (4, None, None, None, 7)], "id int, service_code string, document_id string, seq int, qdrant_point_id long")
    assert [r["id"] for r in readers.of_document(df, "A", "x", "seq").collect()] == [2, 1] and readers.of_document(df, "A", "y", "seq").count() == 0
    assert sorted(r["id"] for r in readers.by_point(df, 7).collect()) == [2, 4]
    texts = spark.createDataFrame([(1, "A", "x", "old"), (5, "A", "x", "new"), (9, "B", "x", None)], "id int, service_code string, document_id string, raw_markdown string")
    assert [r["raw_markdown"] for r in readers.markdown_of(texts, "A", "x").collect()] == ["new"] and readers.markdown_of(texts, "C", "x").count() == 0


def test_texts_and_days(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x\ny")
    assert [r["text"] for r in readers.read_texts(spark, str(tmp_path)).collect()] == ["# x\ny"]
    df = spark.createDataFrame([(dt.datetime(2025, 3, d),) for d in (1, 5, 9)], "at timestamp_ntz")
    assert [r["at"].day for r in readers.since(df, "at", "2025-03-10 00:00:00", 6).collect()] == [9, 5]


def test_update_mode_keeps_the_newest_row_of_a_window(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "p"))
    schema = "k string, ts timestamp, v int"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: {(r["window"]["start"].hour, r["k"]): r["total"] for r in windows.run_available(windows.tumbling(spark.readStream.schema(schema).parquet(source), "ts", "1 hour", ["k"], "v"), target, progress, "update", ["window", "k"]).collect()}
    t = lambda h, m=0: dt.datetime(2025, 3, 1, h, m)
    write([("a", t(1), 1), ("b", t(1, 30), 2)])
    first = run()
    write([("a", t(1, 40), 4), (None, t(5), 8)])
    second = run()
    assert sorted(first.values()) == [1, 2] and sorted(second.values()) == [2, 5, 8] and run() == second


def test_late_rows_and_restart(spark, tmp_path):
    source = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, "k string, ts timestamp, v int").coalesce(1).write.mode("append").parquet(source)
    t = lambda h, m=0: dt.datetime(2025, 3, 1, h, m)
    write([("a", t(1), 1), ("a", t(1, 30), 2)])
    stream = lambda: windows.tumbling(spark.readStream.schema("k string, ts timestamp, v int").parquet(source), "ts", "1 hour", ["k"], "v")
    target, progress = str(tmp_path / "out"), str(tmp_path / "p")
    windows.run_available(stream(), target, progress)
    write([("a", t(5), 4)])
    windows.run_available(stream(), target, progress)
    write([("a", t(1, 10), 100)])  # hours behind the watermark
    got = windows.run_available(stream(), target, progress)
    assert [(r["n"], r["total"]) for r in got.collect()] == [(2, 3)]


def test_checkpoint_folder_is_the_named_one(spark):
    assert cut(spark.range(3)).count() == 3


def test_entry_and_schemas(spark, sf):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in ("p5_found", "chunk_adaptive", "risk_level", "hybrid_retrieve"):
        assert entry.queries()[name](spark, sf).columns
