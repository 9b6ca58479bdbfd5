"""Chunks of documents: fixed windows and heading-wise parts.

Both are folds over arrays in column expressions; no text leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.layout import normalize_text, page_of_mark
from paperloom.functions.rx import strip
from paperloom.operators.lines import clean_lines, heading_paths, join_lines, split_lines, table_blocks, without_contents

# Sizes in characters.
WINDOW, OVERLAP = 800, 150
TEXT_MAX, TABLE_MAX, TEXT_MIN = 1200, 2400, 300


def window_spans(text: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """array<struct(st, en)> of the windows over a text, positions from 0, ends not clipped.

    A window ends after the last line end, blank or point in it, if that lies
    beyond its middle and the text goes on; the next begins ``overlap``
    characters before that end.
    """
    n = F.length(text)
    steps = F.ceil(n / F.lit(float(window // 2 + 1 - overlap))).cast("int") + 1
    state = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<st:int,en:int>>").alias("spans"))

    def end(pos: Column) -> Column:
        seen = F.length(F.regexp_extract(F.substring(text, pos + 1, F.lit(window)), r"(?s)^.*[\n .]", 0))
        return F.when((pos + window < n) & (seen - 1 > window // 2), pos + seen).otherwise(pos + window)

    def step(acc: Column, _: Column) -> Column:
        def move(__: Column, e: Column) -> Column:
            forth = F.when(e - acc["pos"] - overlap <= 0, window // 2).otherwise(e - acc["pos"] - overlap)
            return F.struct((acc["pos"] + forth).alias("pos"), F.concat(acc["spans"], F.array(F.struct(acc["pos"].alias("st"), e.alias("en")))).alias("spans"))

        return F.when(acc["pos"] >= n, acc).otherwise(F.aggregate(F.array(end(acc["pos"])), acc, move))

    many = F.aggregate(F.sequence(F.lit(1), steps), state, step)["spans"]
    return F.when(n <= window, F.array(F.struct(F.lit(0).alias("st"), n.alias("en")))).otherwise(many)


def fixed_chunks(df: DataFrame, key: str, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Windows of every text: key, part_index (from 1), start, content; blank windows are dropped, null texts have none."""
    spans = F.posexplode(window_spans(F.col(text), window, overlap)).alias("i", "span")
    rows = df.where(F.col(text).isNotNull()).select(key, text, spans)
    cut = strip(F.substring(F.col(text), F.col("span.st") + 1, F.col("span.en") - F.col("span.st")))
    rows = rows.select(key, F.col("i"), F.col("span.st").alias("start"), cut.alias("content")).where("content <> ''")
    order = Window.partitionBy(key).orderBy("i")
    return rows.select(key, F.row_number().over(order).alias("part_index"), "start", "content")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pack(pieces: Column, most: int, glue: str) -> Column:
    """Pieces put together in order as long as they fit ``most`` characters; a longer piece stands alone."""
    none = F.array().cast("array<string>")
    state = F.struct(none.alias("done"), F.lit("").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        fresh = F.struct(acc["done"].alias("done"), p.alias("now"))
        longer = F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit(glue), p).alias("now"))
        closed = F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), p.alias("now"))
        return F.when(acc["now"] == "", fresh).when(F.length(acc["now"]) + F.length(p) + len(glue) <= most, longer).otherwise(closed)

    return F.aggregate(pieces, state, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def _solid(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def text_parts(text: Column, most: int = TEXT_MAX, least: int = TEXT_MIN) -> Column:
    """Parts of a running text: whole if it fits; else paragraphs, long ones by sentence, put together up to ``most``.

    A last part under ``least`` characters joins the one before it, even beyond ``most``.
    """
    paragraphs = _solid(F.split(text, r"(?U)\n\s*\n"))
    sentences = lambda p: _pack(_solid(F.split(p, r"(?U)(?<=\.)\s+")), most, " ")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > most, sentences(p)).otherwise(F.array(p))))

    def with_tail(packed: Column) -> Column:
        n = F.size(packed)
        tail = F.concat(F.slice(packed, 1, F.greatest(n - 2, F.lit(0))), F.array(F.concat_ws("\n\n", F.get(packed, n - 2), F.get(packed, n - 1))))
        return F.when((n > 1) & (F.length(F.get(packed, n - 1)) < least), tail).otherwise(packed)

    return F.when(F.length(text) <= most, F.array(text)).otherwise(_once(_pack(pieces, most, "\n\n"), with_tail))


def table_parts(table: Column, most: int = TABLE_MAX) -> Column:
    """Parts of a markdown table: whole if it fits; else rows up to ``most`` characters, the head repeated in each."""
    none = F.array().cast("array<string>")

    def by_row(rows: Column) -> Column:
        ruled = strip(F.get(rows, F.lit(1))).rlike(r"^\|[\s\-:|]+\|$")
        heads = F.when(ruled, 2).otherwise(1)
        data = F.slice(rows, heads + 1, F.greatest(F.size(rows) - heads, F.lit(0)))
        split = _once(F.array_join(F.slice(rows, 1, heads), "\n"), lambda head: under(head, data))
        return F.when((F.size(rows) <= 2) | (F.size(data) == 0), F.array(table)).otherwise(split)

    def under(head: Column, data: Column) -> Column:
        part = lambda now: F.array(F.concat(head, F.lit("\n"), now))

        def step(acc: Column, row: Column) -> Column:
            fits = (acc["now"] == "") | (F.length(head) + 1 + F.length(acc["now"]) + 1 + F.length(row) + 1 <= most)
            more = F.struct(acc["done"].alias("done"), F.when(acc["now"] == "", row).otherwise(F.concat(acc["now"], F.lit("\n"), row)).alias("now"))
            return F.when(fits, more).otherwise(F.struct(F.concat(acc["done"], part(acc["now"])).alias("done"), row.alias("now")))

        return F.aggregate(data, F.struct(none.alias("done"), F.lit("").alias("now")), step, lambda a: F.concat(a["done"], part(a["now"])))

    return F.when(F.length(table) <= most, F.array(table)).otherwise(_once(F.split(table, "\n"), by_row))


def adaptive_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks by heading: key, section, heading_path, chunk_type, part_index, part_total, start_page, end_page, content.

    A section is what stands between two headings; its text and tables are cut
    apart, texts and tables into parts of their own sizes. Pages are those in
    force at the first and last line of a block. Lines are expected normalised.
    """
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    lines = heading_paths(lines, key)
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.coalesce(F.max(F.when(F.col("level").isNotNull(), F.col("pos"))).over(so_far), F.lit(-1)))
    body = clean_lines(lines.where("level is null"), key)
    blocks = table_blocks(body, key).groupBy(key, "section", "block", "is_table").agg(
        F.first("heading_path").alias("heading_path"), F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.min("pos").alias("pos"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("body"),
    ).where("body <> ''")
    parts = F.when(F.col("is_table"), table_parts(F.col("body"))).otherwise(text_parts(F.col("body")))
    rows = blocks.select(key, "section", "heading_path", F.when(F.col("is_table"), "table").otherwise("text").alias("chunk_type"), "start_page", "end_page", "pos", F.posexplode(parts).alias("i", "content"))
    order = Window.partitionBy(key, "section").orderBy("pos", "i")
    whole = Window.partitionBy(key, "section")
    return rows.select(key, "section", "heading_path", "chunk_type", F.row_number().over(order).alias("part_index"), F.count("*").over(whole).cast("int").alias("part_total"), "start_page", "end_page", "content")


def _in_force(index: str, at: Column, field: str) -> Column:
    """Field of the last entry of an index array at or before an offset."""
    return F.try_element_at(F.filter(F.col(index), lambda x: x["off"] <= at), F.lit(-1))[field]


def fixed_document_chunks(df: DataFrame, key: str, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Fixed windows of whole documents: key, part_index, start, content, heading, heading_path, start_page, end_page.

    The text is normalised, tables of contents and noise are taken out. Heading
    and pages are those in force at the window's place in the text before that,
    which is estimated by the ratio of the lengths; null where none is yet.
    """
    raw = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_raw"), normalize_text(F.col(text)).alias("_text"))
    offset = F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.length("line") - 1

    def index(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("off", *columns))).alias(name))

    marks = split_lines(raw, key, "_raw").withColumn("off", offset).withColumn("page", page_of_mark(F.col("line"))).where("page is not null")
    body = without_contents(split_lines(raw, key, "_text"), key).withColumn("off", offset)
    heads = heading_paths(body, key).where("level is not null").withColumn("heading", F.element_at("heading_path", -1))
    sizes = body.groupBy(key).agg((F.sum(F.length("line") + 1) - 1).alias("_long"))
    clean = join_lines(clean_lines(body, key), key, "_clean").where("_clean <> ''")
    spans = clean.select(key, "_clean", F.posexplode(window_spans(F.col("_clean"), window, overlap)).alias("i", "span"))
    for part in (sizes, index(marks, "_marks", "page"), index(heads, "_heads", "heading", "heading_path")):
        spans = spans.join(part, key, "left")
    ratio = F.col("_long") / F.length("_clean")
    start, end = (F.floor(F.col(f"span.{s}") * ratio) for s in ("st", "en"))
    cut = strip(F.substring(F.col("_clean"), F.col("span.st") + 1, F.col("span.en") - F.col("span.st")))
    rows = spans.select(
        key, "i", F.col("span.st").alias("start"), cut.alias("content"), _in_force("_heads", start, "heading").alias("heading"),
        F.coalesce(_in_force("_heads", start, "heading_path"), F.array().cast("array<string>")).alias("heading_path"), _in_force("_marks", start, "page").alias("start_page"), _in_force("_marks", end, "page").alias("end_page"),
    ).where("content <> ''")
    return rows.withColumn("part_index", F.row_number().over(Window.partitionBy(key).orderBy("i"))).drop("i")


def keep_recognised(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of documents that were cut anew: the new ones, and of the old ones those that came from images and tables."""
    kept = old.where("chunk_type in ('image', 'table')").join(new.select(*keys).distinct(), keys, "left_semi")
    return new.unionByName(kept, allowMissingColumns=True)


def renumber_parts(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """part_index and part_total anew within each heading path of a document; chunks without a path are alone."""
    named = F.coalesce(F.col("heading_path"), F.lit("")) != ""
    w = Window.partitionBy(*keys, "heading_path").orderBy(*order)
    index = F.when(named, F.row_number().over(w)).otherwise(1)
    total = F.when(named, F.count("*").over(Window.partitionBy(*keys, "heading_path"))).otherwise(1)
    return chunks.withColumn("part_index", index.cast("int")).withColumn("part_total", total.cast("int"))


def cleaned_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Texts without noise lines: key, text."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    return join_lines(clean_lines(lines, key), key)


def embed_text(path: Column, content: Column, strategy: Column) -> Column:
    """What is embedded: the heading path above the content of adaptive chunks, the content alone of others."""
    return F.when((strategy == "adaptive") & (F.coalesce(path, F.lit("")) != ""), F.concat(path, F.lit("\n\n"), content)).otherwise(content)


