"""Recognised text of images: blocks by label, what is kept of them, their place in the document, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.layout import IMAGE_TAG, heading_text, image_verdict, ocr_verdict, page_of_mark
from paperloom.functions.requests import bigram_jaccard, html_table
from paperloom.functions.rx import rx, strip
from paperloom.sources.readers import natural_key

# Labels of blocks, least scores and likeness, bins of confidence.
DROPPED = ("header", "footer", "page_header", "page_footer", "page_number", "page_no", "running_title", "seal", "stamp", "watermark")
TABLES = ("table", "tableau")
LEAST_SCORE, LIKE_HEADING, LEAST_TABLE = 0.5, 0.7, 10
BINS = (("0.9+", 0.9, 1.01), ("0.8-0.9", 0.8, 0.9), ("0.5-0.8", 0.5, 0.8), ("<0.5", 0.0, 0.5))
LOWEST = 5

BLOCK = "struct<type:string,text:string,html:string,label:string>"


def _has(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def classify_blocks(parsed: Column, lines: Column, tables: Column) -> Column:
    """array of ``BLOCK``: what a page's layout, or else its bare lines and tables, gives.

    ``parsed`` and ``tables`` are array<struct<label,text,html>>, ``lines``
    array<string>. A dropped label gives a block of type drop, a table with
    content one of type table, other blocks with text one of type text; empty
    ones give none. Lines and tables count only where nothing was parsed.
    """
    none = F.array().cast(f"array<{BLOCK}>")

    def block(kind: Column | str, text: Column, html: Column, label: Column | str) -> Column:
        column = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(column(kind).alias("type"), text.alias("text"), F.coalesce(html, F.lit("")).alias("html"), column(label).alias("label")).cast(BLOCK)

    def one(b: Column) -> Column:
        label = F.lower(strip(F.coalesce(F.nullif(b["label"], F.lit("")), F.lit("unknown"))))
        text = strip(F.coalesce(b["text"], F.lit("")))
        kind = F.when(label.isin(*DROPPED), "drop").when(label.isin(*TABLES), F.when((text != "") | _has(b["html"]), "table")).when(text != "", "text")
        return F.when(kind.isNotNull(), block(kind, text, F.when(label.isin(*TABLES), b["html"]), label))

    body = F.array_join(F.filter(lines, lambda t: strip(t) != ""), "\n")
    bare = F.when(F.coalesce(body, F.lit("")) != "", F.array(block("text", body, F.lit(""), "fallback_ocr"))).otherwise(none)
    held = F.filter(F.coalesce(tables, F.array().cast("array<struct<label:string,text:string,html:string>>")), lambda t: _has(t["text"]) | _has(t["html"]))
    alone = F.transform(held, lambda t: block("table", F.coalesce(t["text"], F.lit("")), t["html"], "table"))
    return F.when(F.size(parsed) > 0, F.array_compact(F.transform(parsed, one))).otherwise(F.concat(bare, alone))


def collate(blocks: Column) -> Column:
    """struct(text, tables, dropped): texts of an image joined, its tables as markdown, the labels left out."""
    of = lambda kind: F.filter(blocks, lambda b: b["type"] == kind)
    texts = F.filter(F.transform(of("text"), lambda b: strip(b["text"])), lambda t: t != "")
    tables = F.filter(F.transform(of("table"), lambda b: strip(F.when(_has(b["html"]), html_table(b["html"])).otherwise(b["text"]))), lambda t: t != "")
    dropped = F.filter(F.transform(of("drop"), lambda b: b["label"]), _has)
    return F.struct(F.array_join(texts, "\n\n").alias("text"), tables.alias("tables"), dropped.alias("dropped"))


def sure_parts(boxes: Column, texts: Column, scores: Column, least: float = LEAST_SCORE) -> Column:
    """struct(boxes, lines) of at least a score, blank lines left out; null where nothing is left, so that nothing is written."""
    lines = F.filter(F.arrays_zip(texts.alias("text"), scores.alias("score")), lambda x: (x["score"] >= least) & (strip(x["text"]) != ""))
    kept = F.struct(F.filter(boxes, lambda b: b["score"] >= least).alias("boxes"), lines.alias("lines"))
    return F.when((F.size(kept["boxes"]) > 0) | (F.size(kept["lines"]) > 0), kept)


def image_places(lines: DataFrame, key: str) -> DataFrame:
    """Image tags of documents in lines: key, image_no (from 1), path, heading and page in force."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.select(key, "pos", F.last(heading_text(F.col("line")), ignorenulls=True).over(so_far).alias("heading"), F.last(page_of_mark(F.col("line")), ignorenulls=True).over(so_far).alias("page"), "line")
    tags = df.select(key, "pos", "heading", "page", F.posexplode(F.regexp_extract_all("line", F.lit(rx(IMAGE_TAG)), F.lit(1))).alias("i", "path"))
    return tags.select(key, F.row_number().over(Window.partitionBy(key).orderBy("pos", "i")).alias("image_no"), "path", "heading", "page")


def without_image_tags(markdown: Column) -> Column:
    """The text without its image tags."""
    return F.regexp_replace(markdown, rx(IMAGE_TAG), "")


def judged_images(images: DataFrame, headings: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Adds ``outcome`` to recognised images: drop_only, empty, noise, duplicate (of a heading), tables_only or kept.

    ``images`` has the keys, the text and optionally ``tables`` and ``dropped``
    (arrays); ``headings`` has the keys and ``heading``.
    """
    per = headings.where("heading is not null").groupBy(*keys).agg(F.collect_set(F.lower("heading")).alias("_headings"))
    none = F.array().cast("array<string>")
    of = lambda c: F.coalesce(F.col(c), none) if c in images.columns else none
    t = strip(F.coalesce(F.col(text), F.lit("")))
    like = F.exists(F.coalesce(F.col("_headings"), none), lambda h: bigram_jaccard(F.lower(t), h) > LIKE_HEADING)
    bare = F.when(F.size(of("tables")) > 0, "tables_only").when(F.size(of("dropped")) > 0, "drop_only").otherwise("empty")
    outcome = F.when(t == "", bare).when(ocr_verdict(t) != "passed", "noise").when(like, "duplicate").otherwise("kept")
    return images.join(per, keys, "left").withColumn("outcome", outcome).drop("_headings")


def image_chunks(judged: DataFrame, text: str = "text") -> DataFrame:
    """Chunks of judged images: all their columns with chunk_type, content, char_count, image_ocr_texts.

    Kept texts give a chunk of type image, every table of ``LEAST_TABLE``
    characters one of type table.
    """
    rest = [c for c in judged.columns if c not in (text, "tables", "dropped", "outcome")]
    texts = judged.where("outcome = 'kept'").select(*rest, F.lit("image").alias("chunk_type"), strip(F.col(text)).alias("content"))
    if "tables" in judged.columns:
        tables = judged.select(*rest, F.lit("table").alias("chunk_type"), F.explode("tables").alias("t")).withColumn("content", strip(F.col("t"))).drop("t")
        texts = texts.unionByName(tables.where(F.length("content") >= LEAST_TABLE))
    return texts.withColumn("char_count", F.length("content")).withColumn("image_ocr_texts", F.array("content"))


def outcome_counts(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Images per document: total, and how many were kept, noise, duplicates, empty or dropped."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return judged.groupBy(*keys).agg(F.count("*").alias("total"), *[count(o) for o in ("kept", "noise", "duplicate", "empty", "drop_only", "tables_only")])


def pruned(images: DataFrame, keys: list[str]) -> DataFrame:
    """Images per document and the gate that they fail ("ok" for those that stay): keys, verdict, n."""
    gates = ("exists", "size", "width", "height", "stddev")
    return images.groupBy(*keys, image_verdict(*[F.col(c) for c in gates]).alias("verdict")).agg(F.count("*").alias("n"))


def quality(images: DataFrame, document: str = "document", name: str = "image") -> DataFrame:
    """Recognition of each document: images, processed, passed, dropped by reason, mean confidence, its bins, lowest passing ones.

    ``images`` has one row per image with ``text`` and ``scores``, both null
    where it was not processed.
    """
    done = F.col("text").isNotNull() | F.col("scores").isNotNull()
    rows = images.select(F.col(document).alias("document"), F.col(name).alias("image"), "text", F.coalesce("scores", F.array().cast("array<double>")).alias("scores"), done.alias("done"))
    rows = rows.withColumn("verdict", F.when(F.col("done"), ocr_verdict(F.col("text"))))
    sums = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s)
    rows = rows.withColumn("confidence", F.when(F.size("scores") > 0, sums / F.size("scores")))
    passed = F.col("verdict") == "passed"
    place = F.row_number().over(Window.partitionBy("document", passed & F.col("confidence").isNotNull()).orderBy("confidence", natural_key(F.col("image")), "image"))
    rows = rows.withColumn("_low", F.when(passed & F.col("confidence").isNotNull(), place))
    reasons = [F.count_if(F.col("verdict") == r).alias(r) for r in ("empty", "too_short", "special_only", "math_noise", "low_lang_ratio")]
    lowest = F.array_sort(F.collect_list(F.when(F.col("_low") <= LOWEST, F.struct("_low", "image", F.round("confidence", 2).alias("confidence"), F.substring("text", 1, 80).alias("text")))))
    return rows.groupBy("document").agg(
        F.count("*").alias("images"), F.count_if("done").alias("processed"), F.count_if(~F.col("done")).alias("skipped"), F.count_if(passed).alias("passed"), F.count_if(F.col("done") & ~passed).alias("dropped"), *reasons,
        F.coalesce(F.sum(sums) / F.nullif(F.sum(F.size("scores")), F.lit(0)), F.lit(0.0)).alias("confidence"), *[F.sum(_within(low, high)).alias(n) for n, low, high in BINS], lowest.alias("lowest"),
    )


def _within(low: float, high: float) -> Column:
    return F.size(F.filter("scores", lambda s: (s >= low) & (s < high)))
