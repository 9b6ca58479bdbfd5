"""Checks of requests, likeness of short texts, tables in HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.rx import rx, strip

# The limits of a request, and entities of HTML in the order in which they are read.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
QUERY_CHARS, MAX_PAGE, MAX_KEYWORDS, ANSWER_TOP, RETRIEVE_TOP = 2000, 99_999, 20, 20, 100


def request_fault(request: Column, endpoint: Column) -> Column:
    """The first limit that a request breaks (query, top_k, pages, keywords), or "ok"; unset fields are fine but the query."""
    most = F.when(endpoint == "answer", ANSWER_TOP).otherwise(RETRIEVE_TOP)
    page = lambda p: p.isNull() | p.between(1, MAX_PAGE)
    few = lambda k: k.isNull() | (F.size(k) <= MAX_KEYWORDS)
    length = F.coalesce(F.length(request["query"]), F.lit(0))
    return (
        F.when((length < 1) | (length > QUERY_CHARS), "query").when(request["top_k"].isNotNull() & ~request["top_k"].between(1, most), "top_k")
        .when(~page(request["start_page"]) | ~page(request["end_page"]), "pages")
        .when(~few(request["include_keywords"]) | ~few(request["exclude_keywords"]), "keywords").otherwise("ok")
    )


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of a text without blanks."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(solid) - 1, F.lit(1))), lambda i: F.substring(solid, i, F.lit(2)))
    return F.when(F.length(solid) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Share of bigrams that two texts have in common; 0 where neither has any."""
    both = F.struct(bigrams(a).alias("a"), bigrams(b).alias("b"))

    def share(x: Column) -> Column:
        union = F.size(F.array_union(x["a"], x["b"]))
        return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / union)

    return F.get(F.transform(F.array(both), share), F.lit(0))


def html_table(html: Column) -> Column:
    """Markdown of a plain HTML table: rows by tr, cells by td and th, short rows filled up; other HTML is left as it is."""
    cell = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"
    rows = F.filter(F.transform(F.split(html, r"(?i)</tr\s*>"), lambda r: F.transform(F.regexp_extract_all(r, F.lit(cell), F.lit(1)), _cell_text)), lambda r: F.size(r) > 0)

    def table(rows: Column) -> Column:
        wide = F.array_max(F.transform(rows, F.size))
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
        lines = F.transform(rows, line)
        return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n")

    return F.get(F.transform(F.array(rows), lambda r: F.when(F.size(r) == 0, html).otherwise(table(r))), F.lit(0))


def _cell_text(cell: Column) -> Column:
    text = F.regexp_replace(cell, r"(?s)<[^>]+>", "")
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return strip(F.regexp_replace(text, rx(r"\s+"), " "))


def score_signal(score: Column) -> Column:
    """up from 0.7, reformulated from 0.4, else down."""
    return F.when(score >= 0.7, "up").when(score >= 0.4, "reformulated").otherwise("down")
