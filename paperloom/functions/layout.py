"""Lines of extracted markdown: normal forms, marks, headings, noise, images and OCR gates."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.rx import has, rx, strip

# Characters that normalisation treats alike, table of contents titles, image and text gates.
QUOTES = "「」『』“”„‟«»"
APOSTROPHES = "‘’‚‛"
DASHES = "‐‑‒–—―−﹘﹣－"
INVISIBLE = "​‌‍﻿"
PAGE_MARK = r"^\s*<!--\s*page:(\d+)\s*-->\s*$"
HEADING = r"^(#{1,6})\s+(.+)$"
TOC_TITLE = r"^(목\s*차|차\s*례|table\s+of\s+contents|contents)$"
NOISE = (
    (r"^!\[image\s+\d+\]", ""), (r"^[-–—]\s*\d+\s*[-–—]$", ""), (r"^\d+\s*[-–—]$", ""),
    (r"^(page\s+)?\d+\s*/\s*\d+$", "i"), (r"^page\s+\d+\s+of\s+\d+$", "i"),
)
LEADERS = ("·" * 5, "…" * 3)
OCR_SPECIAL = r"^[\s\-–—_·…=|/\\:;,.!?@#$%^&*(){}\[\]<>]+$"
OCR_MATH = r"^[x_{}()\-\d\s\^]+$"
IMAGE_TAG = r"!\[image\s+\d+\]\((.+?\.(?:png|jpg|jpeg|gif|bmp|tiff))\)"
MIN_BYTES, MIN_EDGE, MIN_WIDTH, MIN_HEIGHT, MAX_RATIO, MAX_EDGE, FLAT_STDDEV = 100, 10, 400, 300, 10, 7000, 10
OCR_MIN_CHARS, OCR_MIN_LETTERS = 10, 0.3


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, for which Spark has no built-in."""
    for texts in batches:
        yield texts.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else t)


def normalize_spaces(text: Column) -> Column:
    """The part of normalisation that follows NFKC: quotes, dashes, blanks and empty lines."""
    text = F.translate(text, " 　" + INVISIBLE, "  ")
    text = F.translate(text, QUOTES + APOSTROPHES + DASHES, '"' * len(QUOTES) + "'" * len(APOSTROPHES) + "-" * len(DASHES))
    text = F.regexp_replace(text, "\t", "    ")
    text = F.regexp_replace(text, "·{3,}", " ")
    text = F.regexp_replace(text, "…{2,}", " ")
    text = F.regexp_replace(text, "[ \t]+\n", "\n")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return F.regexp_replace(text, " {2,}", " ")


def normalize_text(text: Column) -> Column:
    """Text in the form that is indexed."""
    return normalize_spaces(nfkc(text))


def page_of_mark(line: Column) -> Column:
    """Page number of a page mark line, else null."""
    return F.nullif(F.regexp_extract(line, rx(PAGE_MARK), 1), F.lit("")).try_cast("int")


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else null."""
    marks = F.regexp_extract(strip(line), rx(HEADING), 1)
    return F.when(marks != "", F.length(marks))


def heading_text(line: Column) -> Column:
    """Text of a heading line, else null."""
    return F.nullif(strip(F.regexp_extract(strip(line), rx(HEADING), 2)), F.lit(""))


def is_table_line(line: Column) -> Column:
    """Whether a line starts and ends with a bar."""
    s = strip(line)
    return s.startswith("|") & s.endswith("|")


def is_noise_line(line: Column) -> Column:
    """Image residue, dotted leaders, page numbers and lone symbols; blank lines are no noise."""
    s = strip(F.coalesce(line, F.lit("")))
    lone = (F.length(s) <= 2) & ~s.rlike("[가-힣a-zA-Z0-9]")
    found = [has(s, p, flags) for p, flags in NOISE] + [s.contains(x) for x in LEADERS]
    return (s != "") & reduce(lambda a, b: a | b, found, lone)


def is_toc_title(title: Column) -> Column:
    """Whether a heading's text is that of a table of contents, or an entry of one with dotted leaders or a page."""
    t = strip(F.coalesce(title, F.lit("")))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    dotted = (has(t, r"[·…]{3,}") | has(t, r"\s+\d+\s*$")) & ((count("·") >= 3) | (count("…") >= 2))
    return has(t, TOC_TITLE, "i") | dotted


def image_verdict(exists: Column, size: Column, width: Column, height: Column, stddev: Column) -> Column:
    """First gate that an image fails, or "ok"; the order of the gates counts."""
    return (
        F.when(~F.coalesce(exists, F.lit(False)), "not_exists").when(size < MIN_BYTES, "file_size")
        .when((width < MIN_EDGE) | (height < MIN_EDGE), "too_small").when((width < MIN_WIDTH) | (height < MIN_HEIGHT), "icon_size")
        .when(width >= MAX_RATIO * height, "aspect_h").when(height >= MAX_RATIO * width, "aspect_v")
        .when((width > MAX_EDGE) | (height > MAX_EDGE), "too_large").when((stddev > 0) & (stddev < FLAT_STDDEV), "flat_color").otherwise("ok")
    )


def ocr_verdict(text: Column) -> Column:
    """Why a recognised text is dropped (empty, too_short, special_only, math_noise, low_lang_ratio), or "passed"."""
    s = strip(F.coalesce(text, F.lit("")))
    solid = F.regexp_replace(s, "[ \n]", "")
    letters = F.length(F.regexp_replace(solid, "[^가-힣a-zA-Z]", ""))
    return (
        F.when(s == "", "empty").when(F.length(s) < OCR_MIN_CHARS, "too_short").when(has(s, OCR_SPECIAL), "special_only")
        .when(has(s, OCR_MATH), "math_noise").when(letters < OCR_MIN_LETTERS * F.length(solid), "low_lang_ratio").otherwise("passed")
    )
