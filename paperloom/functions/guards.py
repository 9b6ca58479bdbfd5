"""Input and output guards over text columns: masks, injection labels, leak removal.

All are plain column expressions. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.rx import has, sub

# Patterns in the order in which they are applied, and their labels.
PII_PATTERNS = (
    ("RRN", r"\b\d{6}[-\s]?[1-8]\d{6}\b"),
    ("CARD", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{1,7}\b"),
    ("ACCOUNT", r"\b\d{3}[-\s]\d{2,6}[-\s]\d{6,}\b"),
    ("PHONE", r"\b01[016-9][-\s]?\d{3,4}[-\s]?\d{4}\b"),
    ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
)
INJECTION_PATTERNS = (
    (r"이전\s*(지시|지침|명령|프롬프트)(\s+\S+){0,3}\s*(무시|잊|ignore)", "i"),
    (r"(ignore|disregard|forget)(\s+\S+){0,3}\s+(instructions?|prompts?|rules?)", "i"),
    (r"^\s*(system|assistant|user)\s*:\s*", "im"),
    (r"<\|im_(start|end)\|>", ""),
    (r"\[INST\]|\[/INST\]", ""),
    (r"<\|endoftext\|>", ""),
    (r"</?(context|system|instructions?|admin)>", "i"),
)
LEAK_PATTERNS = (
    (r"<\|im_(start|end)\|>", ""),
    (r"\[INST\]|\[/INST\]", ""),
    (r"<\|endoftext\|>", ""),
    (r"^\s*(system|assistant)\s*:\s*", "im"),
)
PROFANITY = r"(시발|씨발|개새끼|병신|좆|fuck|shit)"
ZERO_WIDTH = "[​‌‍﻿⁠᠎]"
LABEL_CHARS = {"injection": 40, "output_leak": 30, "profanity": 30}


def _labels(found: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in found]))


def mask_pii(text: Column) -> Column:
    """struct(masked, kinds): each pattern is applied to what the ones before it left; kinds are sorted."""
    masked, found = F.coalesce(text, F.lit("")), []
    for kind, pattern in PII_PATTERNS:
        found.append((has(masked, pattern), kind))
        masked = sub(masked, pattern, f"[{kind}_MASKED]")
    return F.struct(masked.alias("masked"), F.array_sort(_labels(found)).alias("kinds"))


def mask_pii_list(texts: Column) -> Column:
    """struct(masked, kinds) of a list: every element masked, the kinds of all together."""
    each = F.transform(F.coalesce(texts, F.array().cast("array<string>")), mask_pii)
    kinds = F.array_sort(F.array_distinct(F.flatten(F.transform(each, lambda m: m["kinds"]))))
    return F.struct(F.transform(each, lambda m: m["masked"]).alias("masked"), kinds.alias("kinds"))


def sanitize_input(query: Column) -> Column:
    """struct(cleaned, threats): invisible characters are removed, injection patterns only labelled."""
    query = F.coalesce(query, F.lit(""))
    found = [(has(query, p, flags), f"injection:{p[: LABEL_CHARS['injection']]}") for p, flags in INJECTION_PATTERNS]
    found.append((query.rlike(ZERO_WIDTH), "zero_width_chars"))
    return F.struct(F.regexp_replace(query, ZERO_WIDTH, "").alias("cleaned"), _labels(found).alias("threats"))


def sanitize_output(answer: Column) -> Column:
    """struct(cleaned, threats): role tokens are removed and labelled, profanity only labelled."""
    cleaned, found = F.coalesce(answer, F.lit("")), []
    for pattern, flags in LEAK_PATTERNS:
        found.append((has(cleaned, pattern, flags), f"output_leak:{pattern[: LABEL_CHARS['output_leak']]}"))
        cleaned = sub(cleaned, pattern, "", flags)
    found.append((has(cleaned, PROFANITY, "i"), f"profanity:{PROFANITY[: LABEL_CHARS['profanity']]}"))
    return F.struct(cleaned.alias("cleaned"), _labels(found).alias("threats"))


def guard_request(query: Column, include: Column, exclude: Column) -> Column:
    """All input guards of a request: query, include, exclude, kinds and threats."""
    q, i, e = mask_pii(query), mask_pii_list(include), mask_pii_list(exclude)
    safe = sanitize_input(q["masked"])
    kinds = F.array_sort(F.array_distinct(F.concat(q["kinds"], i["kinds"], e["kinds"])))
    return F.struct(
        safe["cleaned"].alias("query"), i["masked"].alias("include_keywords"), e["masked"].alias("exclude_keywords"),
        kinds.alias("pii_kinds"), safe["threats"].alias("threats"),
    )


def strip_think(text: Column) -> Column:
    """Without the model's <think> sections, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
