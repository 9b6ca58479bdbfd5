"""Rule routing of queries: strategy, query type and the sizes of the two candidate lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.rx import has, rx

# What marks each type of query.
STRUCTURED = (
    r"제\s*\d+\s*조|제\s*\d+\s*[장절편항호]|부칙|별표\s*\d+|\d+\.\d+[\.\d]*\s*[장절항호]?"
    r"|서식\s*\d+|양식\s*\d+|표\s*\d+|그림\s*\d+|[Ss]ection\s*\d+|[Cc]hapter\s*\d+"
)
PROCEDURE = (
    r"어떻게|방법|절차|신청|청구|접수|제출|가입|하려면|하려고|해야\s*하나|순서|과정|단계"
    r"|how\s+to|steps?|process|procedure"
)
COMPARISON = r"비교|차이|다른\s*점|구별|구분|vs|versus|다른가|뭐가\s*달라|differ|compare|distinction"
INTERPRETATION = (
    r"해석|의미|뜻|판단|적용|해당|간주|해석상|경우에|경우는|때는|하면"
    r"|되나요|가능한가요|가능합니까|할\s*수\s*있나|허용되나|인정되나|포함되나|대상인가"
    r"|what\s+does|mean|apply|eligible|qualify"
    r"|보장되나|보장이\s*되나|나오나요|받을\s*수\s*있나|면책|지급되나"
)
SUFFIXES = "형 종 안 판 급 타입 모드 방식 유형 단계 레벨 버전 수준".split()

_WORD = "[가-힣A-Za-z0-9]+"
_SAME = rf"({_WORD}(?:{'|'.join(SUFFIXES)}))\s*[과와이랑하고]\s*({_WORD}(?:{'|'.join(SUFFIXES)}))"
_VERSUS = rf"({_WORD})\s*(?:vs\.?|versus|대)\s*({_WORD})"
PAIR = f"{_SAME}|{_VERSUS}"


def classify(query: Column) -> Column:
    """struct(strategy, query_type, dense_factor, bm25_factor); null queries count as empty."""
    ref, procedure, comparison, meaning = (has(query, p) for p in (STRUCTURED, PROCEDURE, COMPARISON, INTERPRETATION))

    def route(strategy: str, kind: Column, dense: int, bm25: int) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), kind.alias("query_type"), F.lit(dense).alias("dense_factor"), F.lit(bm25).alias("bm25_factor"))

    mixed = F.when(procedure, "procedure").when(comparison, "comparison").otherwise("interpretation")
    asked = F.when(comparison, "comparison").when(procedure, "procedure").otherwise("interpretation")
    semantic = procedure | comparison | meaning
    return (
        F.when(ref & ~semantic, route("bm25_heavy", F.lit("structured_lookup"), 3, 8))
        .when(ref, route("hybrid", mixed, 6, 6))
        .when(semantic, route("dense_heavy", asked, 8, 3))
        .otherwise(route("hybrid", F.lit("simple_fact"), 6, 6))
    )


def decompose(query: Column) -> Column:
    """Two subqueries of a comparison, or null where no pair is named."""
    pattern = rx(PAIR)
    left = F.greatest(F.regexp_extract(query, pattern, 1), F.regexp_extract(query, pattern, 3))
    right = F.greatest(F.regexp_extract(query, pattern, 2), F.regexp_extract(query, pattern, 4))
    rest = F.trim(F.regexp_replace(F.regexp_replace(query, rx(COMPARISON), ""), pattern, ""))
    rest = F.regexp_replace(rest, r"(?U)^[의가은는이를을에서]\s*", "")
    rest = F.regexp_replace(rest, r"(?U)\s*[가이은는을를의에서?？]+$", "")
    return F.when((left != "") & (right != ""), F.array(F.trim(F.concat_ws(" ", left, rest)), F.trim(F.concat_ws(" ", right, rest))))
