"""Personal data in free text: detection and format-preserving pseudonyms.

Found kinds are EMAIL, PHONE, ID_NUMBER, ADDRESS and NAME. Each is replaced by a
placeholder of its type that carries a pseudonym, ``[PHONE 010-4821-7730]``.

Method: a keyed Feistel network permutes the digits of validated numbers within
their format, and birth dates within the dates of their century. A telephone
number is country, area and subscriber; only the subscriber's digits change, to
others that a subscriber may have. Length, separators, letters of a passport
number and the region of a licence stay. What a format forbids is left by
walking the cycle of the permutation until the class of the value is met again,
which keeps it one to one. The digits are taken without separators and country
prefix, so one number written in several ways gets one pseudonym, and equal
values stay linked across documents and tables. A permutation has no collisions
and needs no lookup table, so tasks work alone. E-mail addresses, street
addresses and names have no number format; they carry a keyed tag of 128 bits of
their canonical spelling instead, linked in the same way.

Numbers are validated (dates, lengths, prefixes, no preceding word for a ticket
or document) before they count. Names without a title or phrase beside them
are recognised by the syllables of names that stand beside one elsewhere in the
corpus; ``learn_syllables`` counts those in Spark over all texts.
"""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import spread

AROUND = 200  # characters on each side of a bracketed phrase that may hold the halves of a broken value
LEAST_NAMES, LEAST_LIFT = 3, 2.0  # names that must have a syllable, and how many times more usual it must be there than in all text
KINDS = ("EMAIL", "ID_NUMBER", "PHONE", "ADDRESS", "NAME")
DEFAULT_KEY = "rotate-me"

# Frequent Korean surnames, and words that follow or precede a person's name.
SURNAMES = "남궁|선우|황보|제갈|사공|독고|김|이|박|최|정|강|조|윤|장|임|한|오|서|신|권|황|안|송|전|홍|유|고|문|양|손|배|백|허|남|심|노|하|곽|성|차|주|우|구|민|류|나|진|지|엄|채|원|천|방|공|현|함|변|염|여|추|도|소|석|선|설|마|길|연|위|표|명|기|반|왕|금|옥|육|인|맹|제|모|탁|국|어|은|편|용"
BEFORE = r"제 이름은 |저는 |성명:? ?|이름은? ?:? ?|예금주는? |신청인 |담당자 |수취인 |받는 ?사람:? ?|작성자:? ?"
AFTER = r" ?씨(?![가-힣]{2})| ?씨[가는의를께에]| ?님(?![가-힣]{2})|님 | 과장| 부장| 대리[가는님]| 팀장| 차장| 주임| 선생| 올림| 드림|입니다"
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof"
ORGANISATION = r"Laboratory|Institute|Council|Bureau|Centre|Center|Taskforce|Programme|Program|Team|Unit|Office|Agency|Committee|Department|Ministry|University|Company|Foundation|Tower|Building|Hall"
KO_ORGANISATION = r"추진단|관리처|지원팀|연구소|센터|검사실|사업단|협의체|위원회|학교|병원|회사|재단|빌딩|타워"
ROADS = r"Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Terrace|Way|Close|Square|Place|Boulevard|Blvd|Crescent|Row|Walk|Grove|Hill|Parade"
NO_PERSON = r"(?:문서 ?번호|접수 ?번호|티켓|주문 ?번호|ticket|ref(?:erence)?|order|invoice|receipt|case|document)(?: ?(?:no\.?|number|#|:))? ?$"

_D = "[-.·/]"
EMAIL = re.compile(
    r"(?<![A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9_])?(?: ?@ ?| ?[(\[] ?at ?[)\]] ?| ?골뱅이 ?)"
    r"[A-Za-z0-9\-]{1,63}(?:(?:\.| ?[(\[] ?dot ?[)\]] ?| ?점 ?)[A-Za-z0-9\-]{1,63})+",
    re.I,
)
RESIDENT = re.compile(r"(?<![\d-])(\d{6})( ?- ?| )?([0-9]\d{6})(?![\d-])")
IDS = (
    re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{7}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[MSRODG]\d{8}(?![A-Za-z0-9])"),
    re.compile(r"(?<![\d-])\d{2}-\d{2}-\d{6}-\d{2}(?![\d-])"),
    re.compile(r"(?<=면허번호)(?:는|은|:)? ?(\d{12})(?!\d)"),
    re.compile(r"(?:licen[cs]e|licen[cs]e no\.?|licen[cs]e number) (\d{12})(?!\d)", re.I),
)
PHONES = (
    re.compile(r"(?<![\d-])(?:\+ ?82[-. ]{0,2}\(?0?\)?1[016789]|\(?01[016789]\)?)(?: ?[-.] ?| )?\d{3,4}(?: ?[-.] ?| )?\d{4}(?![\d-])"),
    re.compile(r"(?<![\d-])(?:\+ ?82[-. ]{0,2}|0)(?:2|[3-6][1-5]|70|50\d)\)?(?: ?[-.] ?| )\d{3,4}(?: ?[-.] ?| )\d{4}(?![\d-])"),
    re.compile(r"(?<![\d-])(?:\+?1[-. ])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[-. ])\d{3}[-. ]\d{4}(?![\d-])"),
    re.compile(r"(?<![\d.,-])1?[2-9]\d{2}[2-9]\d{6}(?![\d-])"),
    re.compile(r"(?<![\d-])(?:\+ ?44[-. ]?(?:\(0\))?\d{2,4}|02\d|0[17]\d{2,3})[-. ]\d{3,4}[-. ]\d{3,4}(?![\d-])"),
    re.compile(r"(?<![가-힣])[공영일이삼사오육륙칠팔구]{2,4}(?: ?- ?| )[공영일이삼사오육륙칠팔구]{3,4}(?: ?- ?| )[공영일이삼사오육륙칠팔구]{4}(?![공영일이삼사오육륙칠팔구])"),
)
_DETAIL = r"(?:,? ?\d+동 ?\d+호|,? ?\d+층(?: ?\d+호)?|,? ?\d+호)?"
_CITY = r"(?:\(\d{5}\)\s?)?(?:[가-힣]{1,6}(?:특별시|광역시|도|시)\s?)?(?:[가-힣]{1,5}[구군]\s?)?"
ADDRESSES = (
    re.compile(r"(?:\(\d{5}\)\s?)?(?:[가-힣]{1,6}(?:시|도)\s?[가-힣]{1,6}[구군읍면]|[가-힣]{1,6}[시구군읍면])\s?[가-힣0-9]{1,10}?(?:로|길)\s?\d+(?:번길\s?\d+)?(?:-\d+)?" + _DETAIL),
    re.compile(r"(?<![가-힣])[가-힣]{2,8}(?:로|길)\s?\d+(?:번길\s?\d+(?:-\d+)?(?:,? ?\d+동 ?\d+호|,? ?\d+층)?|(?:-\d+)?(?:,? ?\d+동 ?\d+호|,? ?\d+층|,? ?\d+호))"),
    re.compile(_CITY + r"[가-힣]{1,6}\d{0,2}[동리가]\s?(?:산 ?)?\d+(?:-\d+)?번지" + _DETAIL),
    re.compile(r"(?:(?:Flat|Apt|Unit|Apartment|Suite|Room)\.? \w+,?\s)?(?<![\w.,])\d{1,5}[A-Z]?\s(?:[A-Za-z][A-Za-z'\-]*\s){1,3}(?:" + ROADS + r")\b(?! (?:policy|rules?|form|manual|guide|handbook|plan|project)\b)(?:,?\s(?!and\b|or\b|if\b|in\b|is\b|to\b|for\b)(?-i:[A-Z][A-Za-z\-]{2,}))?(?:,?\s\d{5}(?!\d))?", re.I),
    re.compile(r"(?:\d+(?:-\d+)?,?\s)?[A-Za-z][A-Za-z]+-(?:daero|ro|gil)(?:\s\d+(?:beon)?-gil)?(?:\s\d+)?(?:,\s[A-Za-z]+-(?:dong|eup|myeon|gu|gun|si|do))+", re.I),
)
_EN = r"(?-i:[A-Z][a-z]{1,30}(?:-[A-Z][a-z]{1,30})?|[A-Z]{2,30}(?:-[A-Z]{2,30})?)"
_EN_NAME = rf"(?:{_EN}, ?{_EN}|(?-i:[A-Z])\. ?{_EN}|{_EN} {_EN})"
EN_CONTEXT = re.compile(rf"(?:\bmy name is |\bname: ?|\b(?:regards|sincerely|thanks),? |\bsigned |\battn:? |\bholder,? |\bclaim of |(?:^|[\s(])- |\bthis is |\b(?:{TITLES})\.? )(?:(?:{TITLES})\.? )?({_EN_NAME})", re.I)
EN_TITLE = re.compile(rf"\b(?:{TITLES})\.? ({_EN_NAME}|{_EN})")
EN_SPEAKING = re.compile(rf"({_EN_NAME})(?: speaking| here\b| wrote\b| called\b)")
EN_OBJECT = re.compile(rf"\b(?:[Aa]sk|[Cc]ontact|[Tt]ell|[Mm]eet|[Nn]otify) ({_EN_NAME})")
EN_ALONE = re.compile(rf"(?:^|[,.;:/\n(] ?)({_EN} {_EN}|[A-Z]\. ?{_EN}|{_EN}, {_EN})(?= ?(?:$|[,.;/\n)]))")
EN_NOT = re.compile(rf"\b(?:{ORGANISATION}|Show|Article|Question|Section|Chapter|How|What|Is|Rules?|{ROADS})\b", re.I)
EN_WORDS = frozenset("the a an is are was to of for in on at and or please file show article after all see this will form grant policy".split())
KO_CONTEXT = re.compile(rf"(?:(?:{BEFORE})((?:{SURNAMES}) ?[가-힣]{{2}})(?=입니다|,|\.|$|\n| ?\)|이라|이고|님| 올림)|(?<![가-힣])((?:{SURNAMES}) ?[가-힣]{{2}})(?= 씨[가는의를께에 ]|님 앞| 과장에게| 부장에게| 팀장에게| 올림| 드림))")

_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0xA0: 0x20, 0x2009: 0x20, 0x202F: 0x20} | {c: 0x2D for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212, 0x00AD, 0xFE63)}
_HANGUL_DIGIT = {ord(c): str(d) for c, d in zip("공영일이삼사오육륙칠팔구", (0, 0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9))}
_NOT_PERSON = re.compile(NO_PERSON, re.I)
_SAYS_NAME = re.compile("제 이름은|성명|예금주")


def valid_date(six: str) -> bool:
    """Whether six digits are a date as yymmdd (any century)."""
    month, day = int(six[2:4]), int(six[4:6])
    return 1 <= month <= 12 and 1 <= day <= (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]


class Detector:
    """Finds personal data in one text; ``syllables`` are (first, second) syllables of given names."""

    def __init__(self, syllables: tuple[str, str] = ("", "")):
        first, second = (re.escape(s) for s in syllables)
        self.alone = None
        if first and second:
            self.alone = re.compile(
                rf"(?<![가-힣])(?:{SURNAMES}) ?[{first}][{second}](?![가-힣])(?! (?:{KO_ORGANISATION}))"
                rf"|(?<![가-힣])(?:{SURNAMES}) ?[{first}][{second}](?=님|씨|입니다|이고|에게|의 )"
            )

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Non-overlapping (start, end, kind), in order; a value broken by a bracketed phrase gives two spans."""
        if not text:
            return []
        flat = text.translate(_WIDE)
        found = self._flat(flat)
        for inner in re.finditer(r" ?\([^()]{6,}\)", flat):
            cut, end = inner.span()
            if not any(cut <= a and b <= end for a, b, _ in found):
                continue
            low = max(0, cut - AROUND)
            outer, size, at = flat[low:cut] + flat[end : end + AROUND], end - cut, cut - low
            for a, b, kind in self._flat(outer):
                if a < at < b:  # broken by the phrase
                    rest = at + len(outer[at:b]) - len(outer[at:b].lstrip())
                    a, b, rest = a + low, b + low + size, rest + low + size
                    found = [x for x in found if not (a <= x[0] < cut or end <= x[0] and x[1] <= b)]
                    found += [(a, cut, kind), (rest, b, kind)]
        return sorted(found)

    def _flat(self, text: str) -> list[tuple[int, int, str]]:
        taken: list[tuple[int, int, str]] = []
        busy = bytearray(len(text))

        def take(a: int, b: int, kind: str) -> None:
            while a < b and text[a].isspace():
                a += 1
            if a < b and 1 not in busy[a:b]:
                busy[a:b] = b"\1" * (b - a)
                taken.append((a, b, kind))

        def numbered(at: int) -> bool:  # a word for a document or ticket stands before
            return bool(_NOT_PERSON.search(text[max(0, at - 40) : at]))

        for m in EMAIL.finditer(text):
            take(*m.span(), "EMAIL")
        if any(c.isdigit() for c in text):
            for m in RESIDENT.finditer(text):
                if valid_date(m[1]) and "1" <= m[3][0] <= "8" and not numbered(m.start()):
                    take(*m.span(), "ID_NUMBER")
            for rx in IDS:
                for m in rx.finditer(text):
                    if not numbered(m.start()):
                        take(*m.span(m.lastindex or 0), "ID_NUMBER")
            for rx in ADDRESSES:
                for m in rx.finditer(text):
                    take(*m.span(), "ADDRESS")
        for rx in PHONES:
            for m in rx.finditer(text):
                if not numbered(m.start()):
                    take(*m.span(), "PHONE")
        for m in KO_CONTEXT.finditer(text):
            k = 1 if m[1] else 2
            told = k == 2 or not self.alone or _SAYS_NAME.match(m[0]) or self.alone.match(m[k])
            if m[k][-2:] not in ("번호", "이름", "성명") and told:
                take(*m.span(k), "NAME")
        if self.alone:
            for m in self.alone.finditer(text):
                take(*m.span(), "NAME")
        for rx in (EN_CONTEXT, EN_TITLE, EN_SPEAKING, EN_OBJECT, EN_ALONE):
            for m in rx.finditer(text):
                words = m[1].lower().replace(",", "").split()
                if not EN_NOT.search(m[1]) and not any(w in EN_WORDS for w in words):
                    take(*m.span(1), "NAME")
        return taken


def _digest(key: bytes, *parts: object, size: int = 8) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=size).digest(), "big")


def permute_digits(digits: str, key: bytes, tweak: str) -> str:
    """Keyed permutation of a digit string within its length: an alternating Feistel network of 10 rounds."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + _digest(key, tweak, n)) % 10) if digits else ""
    u = n // 2
    a, b, sizes = int(digits[:u]), int(digits[u:]), (u, n - u)
    for r in range(10):
        m = 10 ** sizes[r % 2]
        a, b = b, (a + _digest(key, tweak, n, r, b)) % m
    return f"{a:0{u}d}{b:0{n - u}d}"


def restore_digits(digits: str, key: bytes, tweak: str) -> str:
    """Inverse of ``permute_digits`` for the holder of the key (two digits or more)."""
    n = len(digits)
    u = n // 2
    a, b, sizes = int(digits[:u]), int(digits[u:]), (u, n - u)
    for r in reversed(range(10)):
        m = 10 ** sizes[r % 2]
        a, b = (b - _digest(key, tweak, n, r, a)) % m, a
    return f"{a:0{u}d}{b:0{n - u}d}"


def walk(digits: str, key: bytes, tweak: str, kind: Callable[[str], object]) -> str:
    """Permutation of the digit strings of one length and one ``kind``, by walking the cycle of the permutation of all."""
    same = kind(digits)
    while True:
        digits = permute_digits(digits, key, tweak)
        if kind(digits) == same:
            return digits


def _century(sex_digit: str) -> int:
    """First year of the century that the seventh digit of a resident number stands for."""
    return 2000 if sex_digit in "3478" else 1800 if sex_digit in "09" else 1900


def permute_date(six: str, key: bytes, first_year: int = 1900) -> str:
    """Keyed permutation of yymmdd within the dates of a century.

    29 February of years that have none is permuted among those, so the map
    stays one to one on all that ``valid_date`` takes.
    """
    start = dt.date(first_year, 1, 1)
    days = (dt.date(first_year + 100, 1, 1) - start).days
    try:
        day = (dt.date(first_year + int(six[:2]), int(six[2:4]), int(six[4:6])) - start).days
    except ValueError:
        return walk(six[:2], key, f"year{first_year}", lambda y: calendar.isleap(first_year + int(y))) + six[2:]
    new = walk(f"{day:05d}", key, f"date{first_year}", lambda d: int(d) < days)
    return (start + dt.timedelta(days=int(new))).strftime("%y%m%d")


def phone_parts(flat: str) -> tuple[str, str, str]:
    """(what is written before the subscriber, country and area, subscriber) of a telephone number, digits only.

    Korean numbers have an area of one to three digits after 0 or 82, British
    ones of two to four after 0 or 44, American ones of three after an optional 1.
    """
    digits = "".join(c for c in flat if c.isdigit())
    groups = re.findall(r"\d+", flat)
    plus = flat.lstrip().startswith("+")
    if plus and digits[:2] in ("82", "44"):
        country, at = digits[:2], 2
    elif digits[:1] == "0":
        british = len(digits) == 11 and (digits[:2] == "02" or digits[:2] in ("01", "07") and len(groups[0]) in (4, 5))
        country, at = "44" if british else "82", 0
    else:
        country, at = "1", len(digits) - 10
    at += country != "1" and digits[at : at + 1] == "0"
    rest = digits[at:]
    if country == "82":
        n = 1 if rest[:1] == "2" else 3 if rest[:2] == "50" else 2
    elif country == "44":
        n = 2 if rest[:1] == "2" else 3 if rest[:2] == "11" or rest[:1] == "1" and rest[2:3] == "1" else 4
    else:
        n = 3
    return digits[: at + n], f"{country}-{rest[:n]}", rest[n:]


def _social_kind(nine: str) -> tuple[bool, ...]:
    """Which rules of a social security number its digits break."""
    return nine[:3] in ("000", "666"), nine[0] == "9", nine[3:5] == "00", nine[5:] == "0000"


def _refill(shape: str, digits: str) -> str:
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in shape)


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """What the placeholder carries: permuted digits in the value's format, or a keyed tag."""
    flat = value.translate(_WIDE)
    if kind == "PHONE":
        flat = flat.translate(_HANGUL_DIGIT)
        digits = "".join(c for c in flat if c.isdigit())
        if len(digits) < 9:  # half of a number that a phrase breaks
            return _refill(flat, permute_digits(digits, key, "part"))
        head, area, subscriber = phone_parts(flat)
        return _refill(flat, head + walk(subscriber, key, f"phone{area}", lambda d: d[:1] >= "2"))
    if kind == "ID_NUMBER":
        digits = "".join(c for c in flat if c.isdigit())
        if len(digits) == 13:
            return _refill(flat, permute_date(digits[:6], key, _century(digits[6])) + digits[6] + permute_digits(digits[7:], key, "resident"))
        if len(digits) == 12:  # a driving licence begins with its region
            return _refill(flat, digits[:2] + permute_digits(digits[2:], key, "licence"))
        if len(digits) == 9:
            return _refill(flat, walk(digits, key, "social", _social_kind))
        return _refill(flat, permute_digits(digits, key, f"id{len(digits)}"))
    canonical = re.sub(r"[\s,()\[\]-]", "", flat.casefold())
    if kind == "EMAIL":
        canonical = re.sub(r"[\[(]at[\])]|골뱅이", "@", re.sub(r"[\[(]dot[\])]", ".", re.sub(r"\s", "", flat.casefold())))
    return f"{_digest(key, kind, canonical, size=16):032x}"


def mask(text: str, spans: list[tuple[int, int, str]], key: bytes) -> str:
    """The text with each value replaced; the second half of a broken value becomes its type only."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind} {pseudonym(text[a:b], kind, key)}]"]
        at = b
    return "".join([*out, text[at:]])


def learn_syllables(texts: DataFrame, column: str = "text", least: int = LEAST_NAMES, lift: float = LEAST_LIFT) -> tuple[str, str]:
    """First and second syllables of given names that stand beside a title or phrase, over all texts.

    A syllable counts if ``least`` names have it and its share of the names is
    ``lift`` times its share of all Hangul of the texts, whatever the size of
    the corpus and the number of syllables that names use. What reaches the
    driver is bounded by the alphabet: two lists of at most 11,172 syllables.
    """
    context = rf"(?:(?:제 이름은 |성명: ?|예금주는 )((?:{SURNAMES}) ?[가-힣]{{2}})(?=입니다|,|\.|$|\n|\))|(?<![가-힣])((?:{SURNAMES}) ?[가-힣]{{2}})(?= 씨가|님 앞| 과장에게| 올림| 드림))"
    names = F.filter(F.concat(F.regexp_extract_all(F.col(column), F.lit(context), F.lit(1)), F.regexp_extract_all(F.col(column), F.lit(context), F.lit(2))), lambda n: n != "")

    def side(k: int, at: int) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(k).alias("side"), F.substring(n, at, 1).alias("syllable")))

    plain = F.transform(F.regexp_extract_all(F.col(column), F.lit("[가-힣]"), F.lit(0)), lambda c: F.struct(F.lit(0).alias("side"), c.alias("syllable")))
    counts = texts.select(F.explode(F.concat(side(1, -2), side(2, -1), plain)).alias("s")).groupBy("s.side", "s.syllable").agg(F.count("*").alias("n"))
    rows = counts.collect()  # no more than three times the syllables there are
    total = {k: sum(r["n"] for r in rows if r["side"] == k) for k in (0, 1, 2)}
    usual = {r["syllable"]: r["n"] / total[0] for r in rows if r["side"] == 0}
    kept = {k: sorted(r["syllable"] for r in rows if r["side"] == k and r["n"] >= least and r["n"] / total[k] >= lift * usual[r["syllable"]]) for k in (1, 2)}
    return "".join(kept[1]), "".join(kept[2])


def scan(df: DataFrame, text: str, syllables: tuple[str, str]) -> DataFrame:
    """Adds ``kinds`` (distinct kinds found) to the rows of ``df``; null and empty texts have none."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Detector(syllables).spans
        for batch in batches:
            kinds = [sorted({k for _, _, k in spans(t)}) if t else [] for t in batch.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, type=pa.list_(pa.string()))], names=[*names, "kinds"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("kinds", T.ArrayType(T.StringType()))]))


def masker(syllables: tuple[str, str], key: str = DEFAULT_KEY):
    """Arrow-batched function of a text column: the masked text (null stays null)."""
    secret = key.encode()

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spans = Detector(syllables).spans
        for texts in batches:
            yield pd.Series([mask(t, spans(t), secret) if isinstance(t, str) and t else t for t in texts], dtype=object)

    return masked


def list_masker(syllables: tuple[str, str], key: str = DEFAULT_KEY):
    """The same for a column of lists of texts, element by element."""
    secret = key.encode()

    @F.pandas_udf("array<string>")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spans = Detector(syllables).spans
        for lists in batches:
            yield pd.Series([None if x is None else [mask(t, spans(t), secret) if t else t for t in x] for x in lists], dtype=object)

    return masked


def user_texts(traces: DataFrame, feedback: DataFrame) -> DataFrame:
    """All texts that users wrote, in long form: table_name, row_key, field_name, text."""

    def part(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field_name"), value.alias("text"))

    query = F.array(part("request.query", F.col("request.query")))
    words = F.transform(F.coalesce(F.col("request.include_keywords"), F.array().cast("array<string>")), lambda k: part("request.include_keywords", k))
    asked = traces.select(F.lit("trace_record").alias("table_name"), F.col("trace_id").alias("row_key"), F.explode(F.concat(query, words)).alias("p")).select("table_name", "row_key", "p.field_name", "p.text")
    said = feedback.select(F.lit("tb_query_feedback").alias("table_name"), F.col("id").cast("string").alias("row_key"), F.lit("free_text").alias("field_name"), F.col("free_text").alias("text"))
    return spread(asked.unionAll(said).where("text is not null and text <> ''"))


def find_personal_data(traces: DataFrame, feedback: DataFrame) -> DataFrame:
    """One distinct row (table_name, row_key, field_name, kind) for what is found in each record and field.

    Rows without a key keep a null key. Null, empty and very long texts are
    fine; repeated rows give one row.
    """
    texts = user_texts(traces, feedback)
    found = scan(texts, "text", learn_syllables(texts))
    return found.select("table_name", "row_key", "field_name", F.explode("kinds").alias("kind")).distinct()


def mask_traces(traces: DataFrame, syllables: tuple[str, str], key: str = DEFAULT_KEY) -> DataFrame:
    """trace_record with request.query and request.include_keywords masked, all else as it was."""
    safe = F.col("request").withField("query", masker(syllables, key)(F.col("request.query"))).withField("include_keywords", list_masker(syllables, key)(F.col("request.include_keywords")))
    return traces.withColumn("request", F.when(F.col("request").isNotNull(), safe))


def mask_feedback(feedback: DataFrame, syllables: tuple[str, str], key: str = DEFAULT_KEY) -> DataFrame:
    """tb_query_feedback with free_text masked."""
    return feedback.withColumn("free_text", masker(syllables, key)(F.col("free_text")))
