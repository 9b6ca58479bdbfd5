"""Personal data: kinds found, traps left alone, pseudonyms linked and reversible."""

import pytest

from paperloom.llm import pii

KEY = b"k"
SYLLABLES = ("빛예온", "솔린별")


def kinds(text):
    return sorted({k for *_, k in pii.Detector(SYLLABLES).spans(text)})


@pytest.mark.parametrize(
    ("text", "expect"),
    [
        ("회신은 wystan+doc4＠saebit.example로", ["EMAIL"]), ("desk_9 [at] box [dot] invalid", ["EMAIL"]), ("a(at)mail.example", ["EMAIL"]), ("mailto:x.y@dept.example.com", ["EMAIL"]),
        ("010 - 0045 - 8773입니다", ["PHONE"]), ("０１０－０２２８－３８７５", ["PHONE"]), ("031) 011-8175", ["PHONE"]), ("+82 10 0531 2040", ["PHONE"]), ("(202) 555-0133", ["PHONE"]), ("+44 20 7946 0913", ["PHONE"]), ("020 7946 0462", ["PHONE"]), ("공일공-공오이일-육오사육", ["PHONE"]), ("01043219876", ["PHONE"]),
        ("801005-8687782", ["ID_NUMBER"]), ("790213 6836400", ["ID_NUMBER"]), ("７９０２１３－６８３６４００", ["ID_NUMBER"]), ("SSN 977-00-5538", ["ID_NUMBER"]), ("passport ZK9847742", ["ID_NUMBER"]), ("여권번호 M84584257", ["ID_NUMBER"]), ("운전면허 60-41-672461-25", ["ID_NUMBER"]), ("면허번호는 598282621799", ["ID_NUMBER"]),
        ("가온시 들꽃구 개울가길 153", ["ADDRESS"]), ("도담시한빛구안개골길282로", ["ADDRESS"]), ("새울시 바람구 너울동 682-5번지", ["ADDRESS"]), ("하늘마루로 58 8층", ["ADDRESS"]), ("Apt 30A, 45 Foxmere Avenue", ["ADDRESS"]), ("2 Foxmere Avenue\nWychley", ["ADDRESS"]), ("62, Dalmuri-ro 13-gil, Hanbit-gu, Saeul-si", ["ADDRESS"]),
        ("강예린 씨가 문의", ["NAME"]), ("(오빛솔)", ["NAME"]), ("제 이름은 한온별입니다", ["NAME"]), ("남궁빛린님 앞으로", ["NAME"]), ("권 예솔", ["NAME"]), ("my name is Wystan Calloway", ["NAME"]), ("K. Ashgrove", ["NAME"]), ("Ashgrove, Odessa", ["NAME"]), ("(VANYA TILLBROOK)", ["NAME"]), ("claim of Ms Lorcan Thornby", ["NAME"]),
        ("접수번호 66321303346", []), ("문서번호 1322-0314-9667 기준", []), ("ticket 79532424794", []), ("1588 대표번호", []), ("2493쪽 497행", []), ("2025-03-13 이후", []), ("금액 1,279,000원", []), ("version 10.3.8", []), ("[PHONE_MASKED] 로", []), ("담당자 [NAME_MASKED]", []),
        ("Rose Council rules", []), ("Grant Street policy", []), ("amount 1,489,000, Grant Street policy", []), ("빛솔 지원팀의 정류장 절차", []), ("조정안과 이자율", []), ("@전체 공유", []), ("주소 변경 절차", []), ("991332-1234567", []), ("", []), (None, []),
    ],
)
def test_kinds(text, expect):
    assert kinds(text) == expect


def test_broken_value_in_brackets():
    text = "(010 0817 (제 메일 desk_60@office.test 확인 바랍니다) 5462로 전화)"
    spans = pii.Detector().spans(text)
    assert sorted(k for *_, k in spans) == ["EMAIL", "PHONE", "PHONE"]
    masked = pii.mask(text, spans, KEY)
    assert "0817" not in masked and "5462" not in masked and "확인 바랍니다" in masked


def test_only_the_values_change():
    text = "앞 010-1234-5678 뒤 a@b.example 끝"
    masked = pii.mask(text, pii.Detector().spans(text), KEY)
    assert masked.startswith("앞 [PHONE 010-") and " 뒤 [EMAIL " in masked and masked.endswith("] 끝")


def test_permutation_is_one_to_one_and_reversible():
    seen = {pii.permute_digits(f"{i:04d}", KEY, "t") for i in range(10_000)}
    assert len(seen) == 10_000
    for d in ("00", "123", "98765432109876"):
        assert pii.restore_digits(pii.permute_digits(d, KEY, "t"), KEY, "t") == d and len(pii.permute_digits(d, KEY, "t")) == len(d)
    dates = {pii.permute_date(f"{y:02d}{m:02d}15", KEY) for y in range(100) for m in range(1, 13)}
    assert len(dates) == 1200 and all(pii.valid_date(d) for d in dates)


def test_equal_values_stay_linked_across_spellings():
    same = {"".join(c for c in pii.pseudonym(v, "PHONE", KEY) if c.isdigit())[-8:] for v in ("010-1234-5678", "010 1234 5678", "+82 10 1234 5678", "０１０１２３４５６７８")}
    assert len(same) == 1
    assert pii.pseudonym("A@b.example", "EMAIL", KEY) == pii.pseudonym("a (at) b.example", "EMAIL", KEY).replace(" ", "")
    a = pii.pseudonym("801005-1687782", "ID_NUMBER", KEY)
    assert a[6] == "-" and a[7] == "1" and pii.valid_date(a[:6]) and pii.pseudonym("801005-1687782", "ID_NUMBER", b"other") != a


@pytest.mark.parametrize(
    ("spellings", "area"),
    [
        (["02-123-4567", "02 123 4567", "02)123-4567", "+82 2 123 4567", "+82-2-123-4567"], "02"), (["031-123-4567", "031) 123 4567", "+82 31 123 4567"], "031"), (["010-1234-5678", "01012345678", "+82 (0)10-1234-5678", "공일공-일이삼사-오육칠팔"], "010"),
        (["0505-123-4567", "0505 123 4567"], "0505"), (["070-1234-5678"], "070"), (["020 7946 0958", "+44 20 7946 0958", "+44 (0)20 7946 0958"], "020"), (["0113 496 0000", "+44 113 496 0000"], "0113"), (["(212) 555-1234", "+1 212 555 1234", "212-555-1234", "2125551234", "1-212-555-1234"], "212"),
    ],
)
def test_one_pseudonym_per_number(spellings, area):
    """Over all spellings, with the area kept and digits that a subscriber may have."""
    made = [pii.pseudonym(v, "PHONE", KEY) for v in spellings]
    national = set()
    for v, m in zip(spellings, made):
        flat = v.translate(pii._WIDE).translate(pii._HANGUL_DIGIT)
        assert [c.isdigit() for c in m] == [c.isdigit() for c in flat] and m != flat
        head, where, subscriber = pii.phone_parts(m)
        assert pii.phone_parts(flat)[:2] == (head, where)
        assert (subscriber[0] >= "2") == (pii.phone_parts(flat)[2][0] >= "2")
        national.add(where + subscriber)
    assert len(national) == 1 and made[0].lstrip("(").startswith(area[:2])


def test_numbers_stay_one_to_one():
    few = [f"02-{i:03d}-4567" for i in range(1000)]
    assert len({pii.pseudonym(v, "PHONE", KEY) for v in few}) == 1000
    for century in (1800, 1900, 2000):
        days = [f"{y:02d}{m:02d}{d:02d}" for y in range(100) for m in range(1, 13) for d in range(1, 32) if pii.valid_date(f"{y:02d}{m:02d}{d:02d}")]
        made = {pii.permute_date(d, KEY, century) for d in days}
        assert len(made) == len(days) and all(pii.valid_date(d) for d in made)
    assert pii.permute_date("000229", KEY, 1900).endswith("0229") and pii.valid_date(pii.pseudonym("000229-3123456", "ID_NUMBER", KEY)[:6])
    social = [pii.pseudonym(f"212-{i:02d}-5538", "ID_NUMBER", KEY) for i in range(1, 100)]
    assert len(set(social)) == 99 and not any(s.startswith(("000", "666", "9")) or "-00-" in s or s.endswith("-0000") for s in social)
    assert pii.pseudonym("11-22-123456-78", "ID_NUMBER", KEY).replace("-", "") == pii.pseudonym("112212345678", "ID_NUMBER", KEY)
    assert len(pii.pseudonym("a@b.example", "EMAIL", KEY)) == 32


def test_syllables_do_not_depend_on_their_number(spark):
    """More than a hundred evenly used syllables are all learnt."""
    first, second = "".join(chr(0xAC00 + 28 * i) for i in range(120)), "".join(chr(0xAC00 + 28 * i + 4) for i in range(120))
    filler = "담당자는 서류를 검토하고 기준에 따라 처리한다."
    rows = [(f"제 이름은 김{first[i % 120]}{second[(i * 7) % 120]}입니다",) for i in range(600)] + [(filler,)] * 200
    got = pii.learn_syllables(spark.createDataFrame(rows, "text string"))
    usual = set(filler + "제 이름은 김입니다")
    assert set(first) - usual <= set(got[0]) and set(second) - usual <= set(got[1])
    assert kinds("제 이름은 박하늘입니다") == ["NAME"] and kinds("저는 이용자이고 문의합니다") == []


@pytest.mark.parametrize("text", ["Reach me at lorcan_t@quill.example after six.", "Hotline for me: 02-555-0188.", "Please use passport QX1234567 for the booking.", "새 주소: 가람시 푸른구 너른길 12, 3층으로 바꿔 주세요"])
def test_phrases_that_the_tables_do_not_have(text):
    assert len(kinds(text)) == 1


def test_long_phrase_in_a_value():
    text = "010 0817 (" + "아주 긴 설명이 이어집니다 " * 30 + "desk@office.test) 5462"
    assert sorted(k for *_, k in pii.Detector().spans(text)) == ["EMAIL", "PHONE", "PHONE"]


def test_tables(spark):
    request = "struct<query:string,include_keywords:array<string>,top_k:int>"
    rows = [("t1", "d", 1, ("전화 010-1234-5678", ["보험", "강빛솔", None, ""], 3)), ("t1", "d", 2, ("전화 010-1234-5678", None, 3)), (None, "d", 3, None), ("t2", None, None, (None, [], None))]
    traces = spark.createDataFrame(rows, f"trace_id string, dt string, line_no long, request {request}")
    names = [(i, f"제 이름은 강{a}{b}입니다") for i, (a, b) in enumerate([("빛", "솔"), ("예", "린"), ("온", "별")])]
    traces = traces.unionByName(spark.createDataFrame([(None, "d", 100 + i, ("담당 부서의 처리 기준과 절차는 언제 바뀌나요 성명: 강빛솔", None, 1)) for i in range(3)], traces.schema))
    feedback = spark.createDataFrame([*[(i, t, "x") for i, t in names], (9, None, "x"), (10, "", "x"), (11, "가 " * 30_000 + "010-1234-5678", "x"), (11, "가", "x")], "id long, free_text string, kind string")
    got = {tuple(r) for r in pii.find_personal_data(traces, feedback).collect()}
    assert ("trace_record", "t1", "request.query", "PHONE") in got and ("trace_record", "t1", "request.include_keywords", "NAME") in got
    assert ("tb_query_feedback", "11", "free_text", "PHONE") in got and ("trace_record", None, "request.query", "NAME") in got and len(got) == 7
    masked = pii.mask_traces(traces, SYLLABLES).collect()
    assert masked[0]["request"]["query"].startswith("전화 [PHONE 010-") and masked[0]["request"]["top_k"] == 3 and masked[0]["request"]["include_keywords"][2:] == [None, ""]
    assert masked[2]["request"] is None and masked[3]["request"]["query"] is None
    assert pii.find_personal_data(traces.limit(0), feedback.limit(0)).count() == 0
