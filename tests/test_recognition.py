"""Blocks, kept parts, places, outcomes and quality of recognised images; fixed chunks with heading and page."""

from paperloom.operators import chunking, lines, recognition
from paperloom.sources import readers, writers
from pyspark.sql import functions as F


def test_blocks_and_collation(spark):
    block = "array<struct<label:string,text:string,html:string>>"
    rows = [
        (1, [("Header", "x", None), ("table", "", "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></table>"), ("table", "", ""), ("title", " T ", None), (None, "body", None), ("text", " ", None)], ["raw"], []),
        (2, [], ["a", " ", "b"], [("t", "cells", None), ("t", None, None)]), (3, None, None, None), (4, [], [], [(None, None, "<p>no rows</p>")]),
    ]
    df = spark.createDataFrame(rows, f"id int, parsed {block}, lines array<string>, tables {block}")
    got = df.select("id", recognition.classify_blocks(F.col("parsed"), F.col("lines"), F.col("tables")).alias("b")).withColumn("c", recognition.collate(F.col("b")))
    by = {r["id"]: r for r in got.collect()}
    assert [b["type"] for b in by[1]["b"]] == ["drop", "table", "text", "text"] and by[1]["c"]["text"] == "T\n\nbody" and by[1]["c"]["dropped"] == ["header"]
    assert by[1]["c"]["tables"] == ["| a | b |\n| --- | --- |\n| 1 |  |"]
    assert by[2]["c"]["text"] == "a\nb" and by[2]["c"]["tables"] == ["cells"] and by[4]["c"]["tables"] == ["<p>no rows</p>"] and (by[3]["c"]["text"], by[3]["c"]["tables"]) == ("", [])


def test_score_cut(spark):
    df = spark.createDataFrame([(1, [("a", 0.5), ("b", 0.49)], ["x", " ", "y"], [0.9, 0.9, 0.1]), (2, [("a", 0.1)], ["x"], [0.2]), (3, [], [], [])], "id int, boxes array<struct<label:string,score:double>>, t array<string>, s array<double>")
    by = {r["id"]: r["k"] for r in df.select("id", recognition.sure_parts(F.col("boxes"), F.col("t"), F.col("s")).alias("k")).collect()}
    assert [b["label"] for b in by[1]["boxes"]] == ["a"] and [x["text"] for x in by[1]["lines"]] == ["x"] and by[2] is None and by[3] is None


def test_image_places_and_tags(spark):
    text = "![image 1](a.png)\n<!-- page:2 -->\n# A\nx ![image 2](b.jpg) ![image 3](c.png)\n## B\n![image 4](d.txt)\n<!-- page:3 -->\n![image 5](e.tiff)"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    got = [tuple(r) for r in recognition.image_places(lines.split_lines(df, "id", "t"), "id").orderBy("image_no").collect()]
    assert got == [(1, 1, "a.png", None, None), (1, 2, "b.jpg", "A", 2), (1, 3, "c.png", "A", 2), (1, 4, "e.tiff", "B", 3)]
    assert df.where("id = 1").select(recognition.without_image_tags(F.col("t"))).first()[0].count("![image") == 1


def test_outcomes_and_chunks(spark):
    rows = [("d", "보험금 지급 기준과 절차 안내", [], []), ("d", "보험금의 청구에 필요한 서류는 다음과 같습니다", ["| 열 글자 이상의 표 |", "짧다"], []), ("d", "", [], ["header"]), ("d", None, None, None), ("d", "x_{1}^{2} (3) 4", [], []), ("d", " ", ["| 표만 있는 그림 하나 |"], []), ("e", "충분히 길고 뜻이 있는 문장입니다", None, None)]
    images = spark.createDataFrame(rows, "doc string, text string, tables array<string>, dropped array<string>")
    headings = spark.createDataFrame([("d", "보험금 지급 기준과 절차 안내"), ("d", None), ("x", "y")], "doc string, heading string")
    judged = recognition.judged_images(images, headings, ["doc"])
    counts = {r["doc"]: r.asDict() for r in recognition.outcome_counts(judged, ["doc"]).collect()}
    assert counts["d"] == {"doc": "d", "total": 6, "kept": 1, "noise": 1, "duplicate": 1, "empty": 1, "drop_only": 1, "tables_only": 1} and counts["e"]["kept"] == 1
    chunks = recognition.image_chunks(judged).collect()
    assert sorted(r["chunk_type"] for r in chunks) == ["image", "image", "table", "table"] and all(r["char_count"] == len(r["content"]) and r["image_ocr_texts"] == [r["content"]] for r in chunks)


def test_pruned_and_edges(spark):
    rows = [("d", True, 5000, 4000, 400, 50.0), ("d", True, 5000, 3999, 400, 50.0), ("d", True, 5000, 400, 4000, 50.0), ("d", False, None, None, None, None), ("e", True, 5000, 800, 600, 0.0)]
    got = {(r["doc"], r["verdict"]): r["n"] for r in recognition.pruned(spark.createDataFrame(rows, "doc string, exists boolean, size int, width int, height int, stddev double"), ["doc"]).collect()}
    assert got == {("d", "aspect_h"): 1, ("d", "ok"): 1, ("d", "aspect_v"): 1, ("d", "not_exists"): 1, ("e", "ok"): 1}


def test_quality(spark):
    good = "충분히 길고 뜻이 있는 문장입니다"
    rows = [("a", f"i{n}", good, [0.3 + n / 20, 0.95]) for n in range(1, 9)] + [("a", "i10", good, []), ("a", "i11", "짧다", [0.85]), ("a", "i12", None, None), ("b", "x", None, None)]
    by = {r["document"]: r for r in recognition.quality(spark.createDataFrame(rows, "document string, image string, text string, scores array<double>")).collect()}
    a = by["a"]
    assert (a["images"], a["processed"], a["skipped"], a["passed"], a["dropped"], a["too_short"]) == (11, 10, 1, 9, 1, 1)
    assert [x["image"] for x in a["lowest"]] == ["i1", "i2", "i3", "i4", "i5"] and (a["0.9+"], a["0.8-0.9"], a["0.5-0.8"], a["<0.5"]) == (8, 1, 5, 3)
    assert (by["b"]["processed"], by["b"]["confidence"], by["b"]["lowest"]) == (0, 0.0, [])


def test_natural_order_and_converters(spark, tmp_path):
    names = ["p10.png", "p2.png", "P1.png", "p02x.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(readers.natural_key(F.col("n"))).collect()] == ["P1.png", "p2.png", "p02x.png", "p10.png"]
    (tmp_path / "doc_images").mkdir()
    (tmp_path / "doc_images" / "i1_ocr.json").write_text('{"rec_scores": [0.5]}')
    (tmp_path / "doc_images" / "i1.json").write_text("{}")
    assert [(r["document"], r["image"]) for r in readers.recognition_files(spark, str(tmp_path)).collect()] == [("doc", "i1")]
    ok = spark.createDataFrame([('{"type": "heading"}',), ('{"type": "heading"} {"type": "text chunk"}',), ("{}",), (None,)], "j string")
    assert [r[0] for r in ok.select(readers.converted_well(F.col("j"))).collect()] == [True, False, False, False]


def test_fixed_chunks_with_heading_and_page(spark):
    part = lambda c: "\n".join(c * 60 for _ in range(20))
    text = f"<!-- page:1 -->\n# 목차\n제1장 3\n# 가\n{part('가')}\n<!-- page:2 -->\n## 나\n{part('나')}\n# 다\n<!-- page:3 -->\n{part('다')}"
    rows = chunking.fixed_document_chunks(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "짧은 글")], "id int, t string"), "id", "t").orderBy("id", "part_index").collect()
    one = [r for r in rows if r["id"] == 1]
    assert [r["part_index"] for r in one] == list(range(1, len(one) + 1)) and "목차" not in "".join(r["content"] for r in one)
    assert one[0]["heading"] is None and one[1]["heading"] == "가" and one[-1]["heading"] == "다" and any(r["heading_path"] == ["가", "나"] for r in one)
    assert one[0]["start_page"] == 1 and one[-1]["end_page"] == 3 and [r["start_page"] for r in one] == sorted(r["start_page"] for r in one)
    last = [r for r in rows if r["id"] == 4]
    assert len(last) == 1 and last[0]["heading"] is None and last[0]["start_page"] is None and last[0]["heading_path"] == [] and not [r for r in rows if r["id"] in (2, 3)]


def test_recognised_chunks_survive_new_cutting(spark):
    schema = "d string, chunk_type string, content string"
    old = spark.createDataFrame([("a", "text", "1"), ("a", "image", "2"), ("a", "table", "3"), ("b", "image", "4")], schema)
    new = spark.createDataFrame([("a", "text", "5"), ("a", "text", "6")], schema)
    assert sorted(r["content"] for r in chunking.keep_recognised(old, new, ["d"]).collect()) == ["2", "3", "5", "6"]


def test_replacing_touches_few_directories(spark, tmp_path):
    path = str(tmp_path / "docs")
    schema = "service_code string, document_id string, seq int"
    writers.replace_documents(spark.createDataFrame([("A", f"d{i}", s) for i in range(50) for s in (1, 2)], schema), path, buckets=8)
    writers.replace_documents(spark.createDataFrame([("A", "d7", 9), (None, "n", 1)], schema), path, buckets=8)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 49 * 2 + 2 and [r["seq"] for r in rows if r["document_id"] == "d7"] == [9] and len({r["bucket"] for r in rows}) <= 8
