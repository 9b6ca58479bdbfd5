"""Facts in texts: references to articles and appendices, amounts with units, claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.rx import find_all, rx

# Reference patterns, units with their factor and common code, and the ends of claims.
ARTICLE = r"제\s*(\d+)\s*조(?:\s*제\s*(\d+)\s*항)?(?:\s*제\s*(\d+)\s*호)?(?:\s*제\s*(\d+)\s*목)?"
APPENDIX = r"별표\s*(\d+)|부칙(?:\s*제\s*(\d+)\s*조)?|서식\s*(\d+)|양식\s*(\d+)"
AMOUNT = r"(\d{1,3}(?:,\d{3})+|\d+)\s*(만\s*원|억\s*원|원|퍼센트|%|개월|일|년|세|살|회)"
DATE = r"\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}"
UNITS = {
    "만원": (1e4, "KRW"), "억원": (1e8, "KRW"), "원": (1.0, "KRW"), "%": (1.0, "PERCENT"), "퍼센트": (1.0, "PERCENT"), "일": (1.0, "DAYS"),
    "개월": (30.0, "DAYS"), "년": (1.0, "YEARS"), "세": (1.0, "AGE"), "살": (1.0, "AGE"), "회": (1.0, "COUNT"),
}
CRITICAL_UNITS = ("KRW", "DAYS", "YEARS", "PERCENT")
CLAIM_END = r"(?<=[.!?다요음])\s+|\n+"


def _ascii_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def _number(match: Column, pattern: str, group: int) -> Column:
    return _ascii_digits(F.nullif(F.regexp_extract(match, rx(pattern), group), F.lit(""))).try_cast("int")


def article_refs(text: Column) -> Column:
    """array<struct(article, paragraph, subparagraph, item, canonical)> in the order of the text."""

    def one(m: Column) -> Column:
        article, paragraph, sub, item = (_number(m, ARTICLE, g) for g in (1, 2, 3, 4))
        name = F.concat(
            F.lit("제"), article.cast("string"), F.lit("조"),
            *[F.when(n > 0, F.concat(F.lit(" 제"), n.cast("string"), F.lit(u))).otherwise("") for n, u in ((paragraph, "항"), (sub, "호"), (item, "목"))],
        )
        return F.struct(article.alias("article"), paragraph.alias("paragraph"), sub.alias("subparagraph"), item.alias("item"), name.alias("canonical"))

    return F.transform(find_all(text, ARTICLE), one)


def appendix_refs(text: Column) -> Column:
    """array<struct(kind, number, canonical)> in the order of the text."""

    def one(m: Column) -> Column:
        kind = F.substring(m, 1, 2)
        number = F.coalesce(*[_number(m, APPENDIX, g) for g in (1, 2, 3, 4)])
        name = F.when(number.isNull(), kind).when(kind == "부칙", F.concat(F.lit("부칙 제"), number.cast("string"), F.lit("조"))).otherwise(F.concat(kind, F.lit(" "), number.cast("string")))
        return F.struct(kind.alias("kind"), number.alias("number"), name.alias("canonical"))

    return F.transform(find_all(text, APPENDIX), one)


def reference_names(text: Column) -> Column:
    """Distinct canonical names of all references of a text."""
    return F.array_distinct(F.concat(F.transform(article_refs(text), lambda r: r["canonical"]), F.transform(appendix_refs(text), lambda r: r["canonical"])))


def numeric_facts(text: Column, strict_dates: bool = False) -> Column:
    """array<struct(value, unit, original, canonical)>: amounts with a unit, then dates.

    All dates are the one fact "0:DATE" unless ``strict_dates``, which keeps the date in the canonical form.
    """
    factor = F.create_map(*[x for u, (k, _) in UNITS.items() for x in (F.lit(u), F.lit(k))])
    code = F.create_map(*[x for u, (_, c) in UNITS.items() for x in (F.lit(u), F.lit(c))])

    def amount(m: Column) -> Column:
        raw = _ascii_digits(F.regexp_replace(F.regexp_extract(m, rx(AMOUNT), 1), ",", "")).try_cast("double")
        unit = F.regexp_replace(F.regexp_extract(m, rx(AMOUNT), 2), r"(?U)\s", "")
        value, name = raw * F.try_element_at(factor, unit), F.try_element_at(code, unit)
        return F.struct(value.alias("value"), name.alias("unit"), m.alias("original"), F.concat(value.cast("string"), F.lit(":"), name).alias("canonical"))

    def date(m: Column) -> Column:
        day = F.regexp_replace(m, r"[./]", "-")
        name = F.concat(day, F.lit(":DATE")) if strict_dates else F.lit("0:DATE")
        return F.struct(F.lit(0.0).alias("value"), F.lit("DATE").alias("unit"), day.alias("original"), name.alias("canonical"))

    return F.concat(F.transform(find_all(text, AMOUNT), amount), F.transform(find_all(text, DATE), date))


def claims(text: Column) -> Column:
    """Statements of an answer: split at sentence ends and lines, trimmed, blanks dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), rx(CLAIM_END))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
