"""Scanned text, leaked items and subjects on small made cases, brute force where there is one."""

import itertools
import random

import pytest

from paperloom.llm import leakage, ocr_repair, subjects

WORDS = "계획서 회의록 통지서 점검표 신청서 확인서 관리 기록 보관 검토 승인 제출 처리 통보 등록 평가 구분 적용 시행 요청".split()


@pytest.mark.parametrize("line", ["[6]", "· 9 ·", "Page 3 of 12", "〔9〕", "9쪽", "- 9 -", "제 18 면", "p. 9", "9", "9 / 12", "— 9 —", "xviii"])
def test_page_numbers(line):
    assert ocr_repair.line_kinds([line]) == ["page_no"]


@pytest.mark.parametrize(("line", "kind"), [("", "blank"), ("<!-- page:3 -->", "mark"), ("# 제1조", "heading"), ("| a | b |", "table"), ("30일 안에", "text"), ("제3조", "text"), ("civil", "text")])
def test_other_lines(line, kind):
    assert ocr_repair.line_kinds([line]) == [kind]


@pytest.mark.parametrize(
    ("rare", "frequent", "made"),
    [("받아양", "받아야", ">ᆼ"), ("규젖", "규정", "ᆼ>ᆽ"), ("fina1", "final", "l>1"), ("vehide", "vehicle", "cl>d"), ("liistory", "history", "h>li"), ("rnanaged", "managed", "m>rn"), ("cat", "dog", None), ("bus", "bud", None), ("소송은", "소송을", "ᆯ>ᆫ")],
)
def test_differences(rare, frequent, made):
    got = ocr_repair.difference(ocr_repair.letters(rare), ocr_repair.letters(frequent))
    assert got == made
    if made:  # words with one confusion meet on a key of the hash
        assert ocr_repair.difference_keys(ocr_repair.letters(rare), True) & ocr_repair.difference_keys(ocr_repair.letters(frequent), False)


def test_keys_against_brute_force():
    rng = random.Random(4)
    words = ["".join(rng.choice("가나다라마간난단") for _ in range(3)) for _ in range(60)]
    for a, b in itertools.combinations(set(words), 2):
        x, y = ocr_repair.letters(a), ocr_repair.letters(b)
        if ocr_repair.difference(x, y):
            assert ocr_repair.difference_keys(x, True) & ocr_repair.difference_keys(y, False)


def scanned(rng, noisy):
    pages = []
    for p in range(1, 5):
        body = []
        for _ in range(12):
            body.append(" ".join(rng.choice(WORDS) + rng.choice(["를", "는"]) for _ in range(6)) + " 한다.")
        if noisy:
            body.insert(0, "하늘 사업 운영 규정")
            hit = next((i for i, b in enumerate(body) if i and " 회의록를 " in b), None) if p == 1 else None
            if hit:
                body[hit] = body[hit].replace("회의록를", "회의룩를", 1)
            body[5] = "관계 기관은 점검-"
            body.insert(6, "표를 등록 한다.")
            body.append(f"- {p} -")
        pages.append(f"<!-- page:{p} -->\n" + "\n".join(body))
    return "\n".join(pages)


def test_noise_and_repair(spark):
    rng = random.Random(6)
    rows = [(i, scanned(rng, i % 2 == 0), "x") for i in range(40)] + [(100, None, "x"), (101, "", "x"), (102, "\n" * 500 + "긴 글 " * 20_000, "x")]
    rows.append(rows[0])
    extracts = spark.createDataFrame(rows, "id long, raw_markdown string, text string")
    chunks = spark.createDataFrame([(1, ["하늘 사업 운영 규정\n계획서를 관리는 한다.", None, ""]), (2, None), (3, [])], "id long, image_ocr_texts array<string>")
    found = {tuple(r) for r in ocr_repair.find_noise(extracts, chunks).collect()}
    for i in range(40):
        here = {(n, k) for t, r, e, n, k in found if t == "tb_document_extract" and r == i}
        if i % 2:
            assert not here
        else:
            lines = rows[i][1].split("\n")
            expect = {(n, "header") for n, s in enumerate(lines, 1) if s == "하늘 사업 운영 규정"} | {(n, "page_no") for n, s in enumerate(lines, 1) if s.startswith("- ")}
            expect |= {(n, "hyphen") for n, s in enumerate(lines, 1) if s.endswith("점검-")} | {(n, "misread") for n, s in enumerate(lines, 1) if "회의룩를" in s}
            assert here == expect
    assert ("tb_document_chunks", 1, 1, 1, "header") in found and not any(r >= 100 for _, r, *_ in found)
    fixed = {r["row_id"]: r["text"] for r in ocr_repair.repair(extracts, chunks).where("table_name = 'tb_document_extract'").collect()}
    assert "점검표를" in fixed[0] and "점검-" not in fixed[0] and "회의룩를" not in fixed[0] and "운영 규정" not in fixed[0] and "- 1 -" not in fixed[0]
    assert fixed[0].count("<!-- page:") == 4


def test_copied_noisy_text(spark):
    """A misread word of a text that fills a third of the rows is no frequent word."""
    rng = random.Random(9)
    special = "이번 감사보고서를 제출 한다."
    rows = [(i, scanned(rng, i % 2 == 0).replace("\n", f"\n{special}\n", 1)) for i in range(40)]
    rows[0] = (0, rows[0][1].replace("감사보고서를", "감사보구서를"))
    rows += [(1000 + i, rows[0][1]) for i in range(20)]
    extracts = spark.createDataFrame(rows, "id long, raw_markdown string")
    chunks = spark.createDataFrame([], "id long, image_ocr_texts array<string>")
    at = rows[0][1].split("\n").index("이번 감사보구서를 제출 한다.") + 1
    found = {(r["row_id"], r["line_no"]) for r in ocr_repair.find_noise(extracts, chunks).where("kind = 'misread'").collect()}
    assert {(i, at) for i in (0, *range(1000, 1020))} <= found
    assert not {r for r, _ in found if r % 2 and r < 1000}
    fixed = ocr_repair.repair(extracts, chunks).where("row_id = 0 or row_id >= 1000").collect()
    assert len(fixed) == 21 and all("감사보고서를" in r["text"] and "감사보구서를" not in r["text"] for r in fixed)


@pytest.mark.parametrize(
    ("noisy", "right"),
    [
        (["기한은 2o25년 이며 l3일 안에 통보 한다.", "기한은 2OlB년 이며 SB일 안에 통보 한다."], ["기한은 2025년 이며 13일 안에 통보 한다.", "기한은 2018년 이며 58일 안에 통보 한다."]),
        (["이번 회의룩-", "를 제출 한다.", "이번 회의-", "룩를 제출 한다."], ["이번 회의록를 제출 한다.", "이번 회의록를 제출 한다."]),
        (["이번 회의룩를 제출 이번 회의룩를 제출 한다."], ["이번 회의록를 제출 이번 회의록를 제출 한다."]),
    ],
    ids=["numbers", "broken", "twice"],
)
def test_repair_of_what_is_found(spark, noisy, right):
    rng = random.Random(10)
    usual = "이번 회의록를 제출 한다.\n기한은 2024년 이며 15일 안에 통보 한다."
    rows = [(i, scanned(rng, i % 2 == 0) + "\n" + usual) for i in range(40)]
    rows[1] = (1, rows[1][1] + "\n" + "\n".join(noisy))
    extracts = spark.createDataFrame(rows, "id long, raw_markdown string")
    chunks = spark.createDataFrame([], "id long, image_ocr_texts array<string>")
    assert ocr_repair.find_noise(extracts, chunks).where("row_id = 1 and kind = 'misread'").count() == sum("룩" in x or "2o" in x or "2O" in x for x in noisy)
    fixed = ocr_repair.repair(extracts, chunks).where("row_id = 1 and table_name = 'tb_document_extract'").first()["text"]
    assert fixed.replace("\n\n", " ").endswith(" ".join(right))


def test_numbers_meet_in_the_join():
    forms = [ocr_repair.word_form(t) for t in ("1oss", "L0SS", "B5일", "2OI9년", "3B", "l회", "boss", "c0ver")]
    assert forms == ["9oss", "l9ss", "b9일", "9oi9년", "9b", "l회", "boss", "c0ver"]
    assert [ocr_repair.number_reading(f) for f in forms] == ["9999", "9999", "99일", "9999년", "99", "9회", None, None]
    assert [ocr_repair.read_number(t) for t in ("B5일", "2OI9년", "3B")] == ["85일", "2019년", "38"]
    for rare, frequent in (("9oss", "loss"), ("9oi9년", "9999년"), ("9b", "99"), ("l회", "9회")):
        x, y = ocr_repair.letters(rare), ocr_repair.letters(frequent)
        assert ocr_repair.difference(x, y) and ocr_repair.difference_keys(x, True) & ocr_repair.difference_keys(y, False)
    fixes = [{"first": 1, "word": w, "before": "요금", "after": "또는", "variant": v} for w, v in (("9io만원", "999만원"), ("9o9만원", "999만원"))]
    assert ocr_repair.corrected(["요금 I,9Io만원 또는 12,5O0만원"], ["text"], {"999만원"}, fixes) == ["요금 1,910만원 또는 12,500만원"]


def test_same_lines_in_a_larger_corpus(spark):
    """Ten times the distinct texts: the same lines are headers, and running lines that share a word with headers are none."""
    rng = random.Random(12)
    titles = [f"{a} {b} 규정" for a in ("Admission", "Claim", "Article", "Final") for b in ("운영", "관리")]

    def text(i):
        t = scanned(rng, i % 2 == 0).replace("하늘 사업 운영 규정", titles[i // 2 % len(titles)])
        return t.replace("관계 기관은", "Article 40 takes effect, and the final\nAdmission 절차 등록\n관계 기관은")

    rows = [(i, text(i)) for i in range(40)]
    chunks = spark.createDataFrame([(1, ["Claim 운영 규정    28\n계획서를 관리는\n한다.", "Admission 절차를 등록\n한다."])], "id long, image_ocr_texts array<string>")

    def headers(times):
        more = [(i + 100 * k, t + f"\n<!-- page:{k + 10} -->" * (k > 0)) for i, t in rows for k in range(times)]
        found = ocr_repair.find_noise(spark.createDataFrame(more, "id long, raw_markdown string"), chunks).where("kind = 'header'").collect()
        return {(r["table_name"], r["row_id"], r["elem_no"], r["line_no"]) for r in found if r["row_id"] < 100}

    once = headers(1)
    assert once == {("tb_document_extract", i, 1, n) for i, t in rows for n, s in enumerate(t.split("\n"), 1) if s in titles} | {("tb_document_chunks", 1, 1, 1)}
    assert headers(10) == once


def test_empty_scans(spark):
    extracts = spark.createDataFrame([], "id long, raw_markdown string")
    chunks = spark.createDataFrame([], "id long, image_ocr_texts array<string>")
    assert ocr_repair.find_noise(extracts, chunks).count() == 0 and ocr_repair.repair(extracts, chunks).count() == 0


def sentence(rng, vocabulary, n=9):
    return " ".join(rng.choice(vocabulary) for _ in range(n)) + "."


def test_leaks(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    items = [(i, f"[Question {i}] " + " ".join(sentence(rng, vocabulary) for _ in range(6))) for i in range(12)]
    noise = lambda k: " ".join(sentence(rng, vocabulary) for _ in range(k))
    body = lambda i: items[i][1].split("] ", 1)[1]
    words = body(2).split()
    changed = [w if j % 14 else "zzzz" for j, w in enumerate(body(3).split())]
    half = body(4).split()
    docs = [
        (0, noise(4) + " " + body(0) + " " + noise(4)), (1, noise(3) + "\n" + body(1).upper().replace(" ", "  \n") + noise(2)), (2, noise(2) + " ".join(words[:20] + ["<!-- page:3 -->", "Some", "Header", "Line"] + words[20:]) + noise(1)),
        (3, noise(2) + " ".join(changed) + noise(2)), (4, noise(2) + " ".join(half[: len(half) // 2 + 2]) + " " + noise(3)), (5, noise(2) + " ".join(body(5).split()[:9]) + noise(5)),
        (6, " ".join(x for s in body(6).split(". ") for x in (s + ".", noise(3)))), (7, noise(300)), (8, None), (9, ""), (10, body(7).replace("a", "а").replace("e", "е​")), (10, body(7)), (11, body(8) + "\n" + body(9)),
        (12, " ".join(body(10).split()[:30] + body(10).split()[32:])),
    ]
    frame = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int").repartition(3)
    suite = spark.createDataFrame([*[(a, b, "s", "en") for a, b in items], (50, None, "s", "en"), (51, "", "s", "en"), (52, "?!", "s", "en"), items[0] + ("s", "en")], "item_id long, text string, suite string, lang string")
    leaks = leakage.find_leaks(frame, suite)
    got = {tuple(r) for r in leaks.collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (10, 7), (11, 8), (11, 9), (12, 10)}
    assert leakage.find_leaks(frame.limit(0), suite).count() == 0 and leakage.find_leaks(frame, suite.limit(0)).count() == 0


def test_half_of_a_short_item_with_changed_words():
    """Four of 24 words changed: no 26 of its 12-grams are left, but 83% of its characters."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("가나다라마바사아자차카타파하거너더러머버서어저처") for _ in range(3))
    item = [word() for _ in range(48)]
    half = [word() if j % 5 == 4 else w for j, w in enumerate(item[10:34])]
    noise = lambda k: " ".join(word() for _ in range(k))
    texts = [f"{noise(60)} {' '.join(half)} {noise(60)}", noise(150), f"{noise(60)} {' '.join(item[10:26])} {noise(60)}"]
    index = leakage.Items([(1, " ".join(item)), (2, noise(48))])
    assert leakage.leaked_items(texts, index) == [(0, 1)]


@pytest.mark.parametrize("copies", [1, 4, 5, 8, 40])
def test_items_held_under_several_ids(spark, copies):
    """Equal items, and items that differ by a word, are found under every id."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    item = [word() for _ in range(40)]
    suite = [(i, " ".join(item) if i % 2 else f"[Question {i}] " + " ".join(item).upper()) for i in range(copies)]
    suite += [(1000 + i, " ".join([*item[:39], word()])) for i in range(copies)] + [(5000, " ".join(word() for _ in range(40)))]
    text = " ".join([word() for _ in range(30)] + item[:39] + [word() for _ in range(30)])
    documents = spark.createDataFrame([(7, text), (8, " ".join(word() for _ in range(90)))], "doc_id long, text string")
    found = {tuple(r) for r in leakage.find_leaks(documents, spark.createDataFrame(suite, "item_id long, text string")).collect()}
    assert found == {(7, i) for i, _ in suite if i != 5000}


def test_short_items():
    """Under twelve letters an item counts where it stands whole; longer ones by halves."""
    index = leakage.Items([(1, "Water boils"), (2, "물은 끓는다."), (3, "Water boils"), (4, "?!"), (5, "물")])
    texts = ["In summer water-boils quickly.", "water", "모든 물은\n끓는다", None, "", "no"]
    assert leakage.leaked_items(texts, index) == [(0, 1), (0, 3), (2, 2), (2, 5)]
    only = leakage.Items([(1, "Water boils")])
    assert leakage.leaked_items(texts, only) == [(0, 1)] and leakage.leaked_items(texts, leakage.Items([])) == []


def test_cover_passes_what_the_alignment_accepts():
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("가나다라마바사아자차카타파하") for _ in range(rng.randint(1, 4)))
    seen = 0
    for _ in range(300):
        item = [word() for _ in range(rng.randint(12, 40))]
        index = leakage.Items([(1, " ".join(item))])
        text = leakage.plain(" ".join(word() if rng.random() < 0.12 else w for w in item[rng.randrange(8) :]))
        for diagonal in (-20, 0, 20):
            if index.verify(0, text, diagonal):
                seen += 1
                assert index.runs[0].cover(leakage.gram_codes(text, leakage.RUN), diagonal)
    assert seen > 50


def test_gram_codes_do_not_depend_on_place():
    a, b = "abcdefghijklmnopqrstuvwxyz", "xxabcdefghijklmnop가나"
    assert set(leakage.gram_codes(a).tolist()) & set(leakage.gram_codes(b).tolist()) == set(leakage.gram_codes("abcdefghijklmnop").tolist())
    assert len(leakage.gram_codes("short")) == 0


def test_rules_and_subjects(spark):
    rng = random.Random(8)
    terms = {"law": "소송 판결 항소 원고 피고".split(), "food": "곡물 급식 농지 비료 작물".split(), "sport": "경기 선수 리그 심판 득점".split()}
    common = "담당자 서류 절차 기준 내역 부서 보고서 지침".split()

    def text(subject_counts, neutral):
        out = [f"{rng.choice(common)}는 {rng.choice(terms[s])}을 {rng.choice(common)}에 따라 처리한다." for s, n in subject_counts.items() for _ in range(n)]
        out += [f"{rng.choice(common)}는 {rng.choice(common)}에 따라 보관한다." for _ in range(neutral)]
        rng.shuffle(out)
        return "# 소송 안내\n\n" + " ".join(out) + "\n\n| 판결 | 1 |\n|---|---|"

    docs, truth = [], {}
    for i in range(160):
        chosen = rng.sample(list(terms), rng.choice([1, 1, 2]))
        docs.append((i, text({s: 4 for s in chosen}, 5)))
        truth[i] = set(chosen)
    docs += [(900, None), (901, ""), (902, "!!!"), (903, text({"law": 1}, 30)), (904, text({}, 6)), (905, text({"law": 3}, 20_000))]
    frame = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, subject_code string")
    labels = spark.createDataFrame([(i, s) for i in range(80) for s in truth[i]] + [(0, next(iter(truth[0]))), (None, "law"), (5, None)], "doc_id long, subject_code string")
    areas = spark.createDataFrame([(s,) for s in terms], "subject_code string")
    got = {}
    for r in subjects.assign_subjects(frame, labels, areas).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject_code"])
    right = sum(got.get(i, set()) == truth[i] for i in range(80, 160))
    assert right >= 78
    assert not {900, 901, 902, 903, 904, 905} & set(got)
    rows = subjects.labelled_sentences(frame, subjects.chosen_labels(labels))
    mined = subjects.mine_rules(rows)
    rules = mined.collect()
    transactions = [(set(r["words"]), set(r["subjects"])) for r in rows.dropDuplicates(["words", "subjects"]).collect()]
    for r in rules:  # brute force
        assert r["support"] == sum(set(r["words"]) <= w and r["subject"] in s for w, s in transactions)
    top = subjects.surest(mined, 9).collect()
    assert {s: sum(r["subject"] == s for r in top) for s in terms} == {s: 3 for s in terms}
    assert all(len(r["words"]) <= 2 and 0 < r["confidence"] <= 1 for r in rules)
    assert {r["subject"] for r in rules if r["words"] == ["판결"]} == {"law"}
    assert subjects.assign_subjects(frame, labels.limit(0), areas).count() == 0 and subjects.assign_subjects(frame.limit(0), labels, areas).count() == 0


def test_sentences():
    text = "# 제목\n첫 문장이다. 둘째\n문장이다.\n| a | b |\n1. 셋째다.\nQ. 물음인가?\nA. 넷째다.\n<!-- page:2 -->\n\n다섯째"
    assert len(subjects.sentences(text)) == 5
    assert subjects.words("병상을 bus stops 활주로는") == {"병상", "bus", "stop", "활주로"}
