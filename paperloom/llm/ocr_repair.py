"""Noise of scanned pages: broken words, misread characters, running headers, page numbers.

Method: every word of the corpus has an anagram hash, the sum of a power of its
letters (Hangul by letter, not by syllable). Two words that differ in one letter
have hashes that differ by that letter's value, so a join in SQL on the hashes
less one letter brings every rare word together with its frequent variants; a
short list of differences adds letters that are misread as two. The variants of
a rare word are ranked by how often they stand beside its neighbours in the
corpus, and the best one is the correction. Misread numbers meet their digits
in the same join. Lines at page edges whose words are more usual in recurring
headers than in running lines are removed with the page numbers, and a hyphen at
a line's end goes if the corpus knows the joined word or not the hyphenated one.

Word, neighbour and header counts are taken over all distinct texts by Spark. A task gets
only lists that are bounded by a share of the whole (``FREQUENT_SHARE`` of all
words each, and ``HEADER_SHARE`` of all words in headers).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut, spread

FREQUENT = 8  # occurrences that make a word frequent,
FREQUENT_SHARE = 5e-6  # and its share of all words
RATIO = 10  # how many times more frequent than the rare word a variant must be
CONTEXT = 3  # how often the variant must stand beside a neighbour of the rare word
SURE_LETTERS = 7  # letters of a word that needs no neighbour, if the variant is far more frequent
SURE_RATIO = 20
USUAL = 0.0004  # share of all differences that a difference must have to be one of the scanner's
HEADER_SHARE = 1e-5  # least share of the words of running headers that a word must have to be weighed
HEADER_SUM = 2.0  # sum of the words' weights from which a line at a page edge is a header,
INNER_SUM = 6.0  # and one that stands elsewhere (pages without mark or number)
STRONG = 3.0  # weight from which a word is known with a misread letter, too
RUNNING = -2.0  # weight of a frequent running word that headers do not have

# Latin letters that are misread for one another, and letters misread as two or the reverse.
LOOKALIKE = frozenset("ec tf ao il o0 s5 l1 i1 g9 q9 b6 z2 b8 a4 e3 uv hb t7 ij ft co vy gq".split())
MISREAD_DIGITS = frozenset("olisbzgq")  # letters that stand for digits, which forms have as 9
DOUBLES = (("d", "cl"), ("h", "li"), ("m", "rn"), ("u", "ii"), ("w", "vv"), ("n", "ri"), ("k", "lc"), ("b", "lo"), ("nn", "rm"))

PARTICLES = frozenset("은는이가을를의에와과로도만")

HYPHENS = "-‐‑­¬"
PAGE = re.compile(
    r"^\s*(?:[-–—−·•~*]\s*\d{1,5}\s*[-–—−·•~*]|[\[〔(<{【]\s*\d{1,5}\s*[\]〕)>}】]|\d{1,5}\s*(?:쪽|페이지|면)|제\s*\d{1,5}\s*(?:면|쪽|페이지)"
    r"|(?:pp?\.?|page)\s*\d{1,5}(?:\s*(?:of|/)\s*\d{1,5})?|\d{1,5}(?:\s*(?:/|of)\s*\d{1,5})?|(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))\s*$",
    re.I,
)
_MARK = re.compile(r"^\s*<!--.*-->\s*$")
_BROKEN = re.compile(rf"([^\W\d_]+)[{HYPHENS}]\s*$")
_TOKEN = re.compile(r"[^\s.,!?:;\"'“”‘’()\[\]{}〔〕|<>*#·…]+")
_CAPITAL = re.compile(r"\b[A-Z][^\s.,!?:;\"'“”‘’()\[\]{}〔〕|<>*#·…]+")
_START = re.compile(r"^\s*([^\W\d_][^\s.,!?:;\"'()\[\]]*)")
_DIGIT = re.compile(r"\d")
_LATIN = re.compile(r"[a-z]")
_HANGUL = re.compile(r"[가-힣]")
_LIKE_DIGITS = re.compile(r"^([0-9olisbzgq]{1,8})((?:[가-힣%].*)?)$")
_NUMBERS = re.compile(r"\d+")
_AS_DIGITS = str.maketrans("oOlLiIsSbBzZgGqQ", "0011115568229690")


def line_kinds(lines: list[str]) -> list[str]:
    """blank, mark, heading, table, page_no or text for each line."""
    out = []
    for line in lines:
        s = line.strip()
        if not s:
            out.append("blank")
        elif s[0] == "#":
            out.append("heading")
        elif s[0] == "|" and s[-1] == "|" and len(s) > 1:
            out.append("table")
        elif s[0] == "<" and _MARK.match(s):
            out.append("mark")
        elif PAGE.match(s):
            out.append("page_no")
        else:
            out.append("text")
    return out


class _Forms(dict):
    """Forms of tokens seen by this process; emptied when full."""

    def __missing__(self, token: str) -> str:
        w = token.lower()
        if len(self) > 300_000:
            self.clear()
        if not _LATIN.search(w) or _LIKE_DIGITS.match(w):
            w = _DIGIT.sub("9", w)
        self[token] = w
        return w


_FORMS = _Forms()


def word_form(token: str) -> str:
    """Form in which a word is counted: lower case, digits of numbers alike, also of numbers with letters among them (2o25)."""
    return _FORMS[token]


def number_reading(form: str) -> str | None:
    """Form of the number that a form with letters for digits stands for (9o99, l9, l with a unit); None for other words."""
    m = _LIKE_DIGITS.match(form)
    if not m or not _LATIN.search(m[1]) or not (m[2] or len(m[1]) > 1 and "9" in m[1]):
        return None
    return "9" * len(m[1]) + m[2]


def read_number(token: str) -> str:
    """The digits that a misread number stands for."""
    m = _LIKE_DIGITS.match(token.lower())
    return token[: m.end(1)].translate(_AS_DIGITS) + token[m.end(1) :]


def header_key(line: str) -> str:
    """A line without numbers, separators and blanks, to see it again on other pages."""
    return re.sub(r"[\W\d_]+", "", line.lower())


def may_be_header(line: str) -> bool:
    """Without the end of a sentence or a broken word."""
    s = line.strip()
    return len(s) >= 2 and s[-1] not in ".?!,:;。" and s[-1] not in HYPHENS


def edges(kinds: list[str]) -> list[bool]:
    """Whether each line stands at the edge of a page: beside a page number, a page mark or an end of the text."""
    near = []
    for order in (range(len(kinds)), range(len(kinds) - 1, -1, -1)):
        last, side = "end", [False] * len(kinds)
        for i in order:
            side[i] = last in ("end", "mark", "page_no")
            if kinds[i] != "blank":
                last = kinds[i]
        near.append(side)
    return [a or b for a, b in zip(*near)]


def repeated_headers(lines: list[str], kinds: list[str]) -> set[int]:
    """Lines that recur at page edges of the same text."""
    seen: dict[str, list[int]] = {}
    for i, (line, kind) in enumerate(zip(lines, kinds)):
        if kind == "text" and may_be_header(line):
            seen.setdefault(header_key(line), []).append(i)
    edge = edges(kinds)
    return {i for key, at in seen.items() if len(key) >= 4 and len(at) >= 2 and sum(edge[i] for i in at) * 2 > len(at) for i in at}


def ends_broken(line: str) -> re.Match | None:
    """The match of a word and a hyphen at the end of a line."""
    end = line.rstrip()
    return _BROKEN.search(end.rsplit(None, 1)[-1]) if end and end[-1] in HYPHENS else None


def flow(lines: list[str], kinds: list[str]) -> list[tuple[str, int, int]]:
    """Running words (form, first line, last line) in order; a broken word is one word on two lines."""
    out: list[tuple[str, int, int]] = []
    broken: tuple[str, int] | None = None
    for i, (line, kind) in enumerate(zip(lines, kinds)):
        if kind in ("heading", "table"):
            broken = None
        if kind != "text":
            continue
        tokens = _TOKEN.findall(line)
        if broken is not None and tokens and _START.match(line):
            out.append((word_form(broken[0] + tokens[0].lstrip(HYPHENS)), broken[1], i))
            tokens = tokens[1:]
            if not tokens:
                broken = None
                continue
        broken = None
        if tokens and ends_broken(line):
            broken = (tokens[-1].rstrip(HYPHENS), i)
            tokens = tokens[:-1]
        out += [(_FORMS[t], i, i) for t in tokens]
    return out


def scanned_texts(extracts: DataFrame, chunks: DataFrame) -> DataFrame:
    """All texts of both tables: table_name, row_id, elem_no, text; null and empty ones are left out."""
    a = extracts.select(F.lit("tb_document_extract").alias("table_name"), F.col("id").cast("long").alias("row_id"), F.lit(1).alias("elem_no"), F.col("raw_markdown").alias("text"))
    b = chunks.where("image_ocr_texts is not null").select(F.col("id").cast("long").alias("row_id"), F.posexplode("image_ocr_texts").alias("p", "text"))
    b = b.select(F.lit("tb_document_chunks").alias("table_name"), "row_id", (F.col("p") + 1).cast("int").alias("elem_no"), "text")
    return spread(a.unionAll(b).where("text is not null and text <> ''"))


def count_words(texts: DataFrame) -> DataFrame:
    """Counts over all distinct texts: kind (word, pair, capital, or header: texts with a word in headers), a, b, n. A task adds up before it sends.

    A text in many rows counts once: its misread words would be frequent by its copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {"word": Counter(), "pair": Counter(), "header": Counter(), "capital": Counter()}

        def send() -> Iterator[pa.RecordBatch]:
            for kind, counter in held.items():
                keys, n = list(counter.keys()), list(counter.values())
                two = kind == "pair"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(keys), pa.string()), pa.array([k[0] for k in keys] if two else keys, pa.string()), pa.array([k[1] if two else "" for k in keys], pa.string()), pa.array(n, pa.int64())],
                    names=["kind", "a", "b", "n"],
                )
                counter.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                lines = text.split("\n")
                kinds = line_kinds(lines)
                found = repeated_headers(lines, kinds)
                titles: set[str] = set()
                for i in found:
                    titles.update(t for t in _TOKEN.findall(lines[i]) if not _DIGIT.search(t))
                    kinds[i] = "header"
                held["header"].update(titles)
                words = [w for w, _, _ in flow(lines, kinds)]
                held["word"].update(words)
                held["pair"].update(zip(words, words[1:]))
                # running words in capitals, to tell titles from them; other words are counted as they are
                held["capital"].update(t for i, k in enumerate(kinds) if k == "text" for t in _CAPITAL.findall(lines[i]))
            if sum(map(len, held.values())) > 1_500_000:
                yield from send()
        yield from send()

    parts = texts.select("text").distinct().mapInArrow(run, "kind string, a string, b string, n long")
    return parts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def header_weights(counts: DataFrame) -> dict[str, float]:
    """How much each word of running headers tells for a header: log of its share of header words over its share of running words.

    Shares do not move with the size of the corpus. Words under ``HEADER_SHARE``
    of all header words are left out, so the list has at most 1 / ``HEADER_SHARE`` words.
    """
    heads = counts.where("kind = 'header'").select(F.col("a").alias("word"), F.col("n").alias("h"))
    capital = counts.where("kind = 'capital'").select(F.col("a").alias("word"), "n")
    plain = counts.where("kind = 'word'").select(F.col("a").alias("word"), "n")
    total = heads.agg(F.sum("h").alias("n")).first()["n"]
    if not total:
        return {}
    running = plain.agg(F.sum("n").alias("n")).first()["n"] or 0
    kept = heads.where((F.col("h") >= HEADER_SHARE * total) & (F.length("word") >= 2))
    lines = plain.unionAll(capital).join(F.broadcast(kept.select("word")), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    told = F.log((F.col("h") + 0.5) / F.lit(total + 1.0)) - F.log((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(running + 1.0))
    return {r["word"]: r["w"] for r in kept.join(lines, "word", "left").select("word", told.alias("w")).collect()}


def letters(word: str) -> str:
    """A word as its letters: Hangul syllables taken apart."""
    return unicodedata.normalize("NFD", word)


def anagram_value(letter: str) -> int:
    """Value of a letter in the hash: a power of its code, within 62 bits of a sum."""
    return pow(ord(letter), 5, (1 << 57) - 13)


def anagram_hash(word_letters: str) -> int:
    """Sum of the values of all letters, the same for every order of them."""
    return sum(map(anagram_value, word_letters)) & ((1 << 62) - 1)


def difference_keys(word_letters: str, rare: bool) -> set[int]:
    """Keys on which words meet: the hash, the hash less each letter, and (rare words) the listed differences and the number read."""
    whole = anagram_hash(word_letters)
    m = (1 << 62) - 1
    keys = {whole} | {(whole - anagram_value(c)) & m for c in set(word_letters)}
    if rare and word_letters.isascii():
        for one, two in DOUBLES:
            for a, b in ((one, two), (two, one)):
                if a in word_letters:
                    keys.add((whole - sum(map(anagram_value, a)) + sum(map(anagram_value, b))) & m)
    if rare and (number := number_reading(unicodedata.normalize("NFC", word_letters))):
        keys.add(anagram_hash(letters(number)))
    return keys


def difference(rare: str, frequent: str) -> str | None:
    """The one confusion that turns the frequent word's letters into the rare one's, as "from>to"; None if there is none.

    Letters in a number are one confusion, however many they are.
    """
    if (number := number_reading(unicodedata.normalize("NFC", rare))) and letters(number) == frequent:
        return "9>letter"
    p, n = 0, min(len(rare), len(frequent))
    while p < n and rare[p] == frequent[p]:
        p += 1
    q = 0
    while q < n - p and rare[-1 - q] == frequent[-1 - q]:
        q += 1
    a, b = rare[p : len(rare) - q], frequent[p : len(frequent) - q]
    if len(a) <= 1 and len(b) <= 1:
        one_for_one = len(a) == len(b) == 1
        if one_for_one and a == "9" and b in MISREAD_DIGITS:  # 9oss for loss
            return "letter>9"
        if not (a + b).isascii() or one_for_one and (a + b in LOOKALIKE or b + a in LOOKALIKE):
            return f"{b}>{a}"
        return None
    for one, two in DOUBLES:
        for x, y in ((one, two), (two, one)):
            at = rare.find(x)
            while at >= 0:
                if rare[:at] + y + rare[at + len(x) :] == frequent:
                    return f"{y}>{x}"
                at = rare.find(x, at + 1)
    return None


def variants(counts: DataFrame) -> DataFrame:
    """Rare words with the frequent words they may be misreadings of: word, variant, n, m, difference, particle, size.

    ``particle`` tells that the word is its variant's stem with another particle, a word in its own right; ``size`` is its number of letters.
    """
    words = counts.where("kind = 'word' and length(a) >= 2").select(F.col("a").alias("word"), "n")

    def keyed(rare: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, n, keys = [], [], []
                for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    w_letters = letters(w)
                    if rare and (not any(c.isalpha() for c in w) or len(w_letters) < 3 and number_reading(w) is None):
                        continue
                    for key in difference_keys(w_letters, rare):
                        words.append(w)
                        n.append(k)
                        keys.append(key)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(keys, pa.int64())], names=["word", "n", "key"])

        side = words if rare else words.where(F.col("n") >= FREQUENT)
        return side.mapInArrow(run, "word string, n long, key long")

    frequent = keyed(False).select(F.col("word").alias("variant"), F.col("n").alias("m"), "key")
    met = keyed(True).join(frequent, "key").where((F.col("m") >= RATIO * F.col("n")) & (F.col("word") != F.col("variant")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            made = pa.array([difference(letters(w), letters(v)) for w, v in pairs], pa.string())
            other = pa.array([w[-1] in PARTICLES and w[:-1] == v[:-1] for w, v in pairs], pa.bool_())
            size = pa.array([len(letters(w)) for w, _ in pairs], pa.int32())
            whole = pa.RecordBatch.from_arrays([*batch.columns, made, other, size], names=["word", "variant", "n", "m", "difference", "particle", "size"])
            yield whole.filter(made.is_valid())

    schema = "word string, variant string, n long, m long, difference string, particle boolean, size int"
    return met.select("word", "variant", "n", "m").distinct().mapInArrow(check, schema)


def misreadings(counts: DataFrame) -> DataFrame:
    """``variants`` with differences that are usual in the corpus, which are no more than the pairs of letters."""
    near = cut(variants(counts))
    certain = near.where((F.length("word") >= 3) & ~F.col("particle")).groupBy("difference").agg(F.sum("n").alias("times"))
    whole = certain.agg(F.sum("times").alias("n")).first()["n"] or 0
    usual = certain.where(F.col("times") >= max(2, USUAL * whole)).select("difference")
    return near.join(F.broadcast(usual), "difference", "left_semi")


def often_from(counts: DataFrame) -> float:
    """Occurrences from which a word is frequent."""
    total = counts.where("kind = 'word'").agg(F.sum("n").alias("n")).first()["n"] or 0
    return max(FREQUENT, FREQUENT_SHARE * total)


def known_words(counts: DataFrame, near: DataFrame) -> list[str]:
    """Words that need no look at their neighbours: frequent, and no misreading of a more frequent word.

    Each makes ``FREQUENT_SHARE`` of all words, so they are at most 200,000.
    """
    often = counts.where("kind = 'word'").where(F.col("n") >= often_from(counts)).select(F.col("a").alias("word"))
    doubtful = near.where(~F.col("particle")).select("word").distinct()
    return [r["word"] for r in often.join(doubtful, "word", "left_anti").collect()]


class Pages:
    """Finds headers, page numbers and broken words in one text."""

    def __init__(self, weights: dict[str, float], frequent: set[str]):
        self.weights = weights
        self.near = {k: w for t, w in weights.items() if w >= STRONG and len(letters(t)) >= 5 for k in self._near(t)}
        self.frequent = frequent
        self.judged: dict[str, float] = {}

    @staticmethod
    def _near(word: str) -> set[str]:
        s = letters(word)
        return {s[:i] + "\0" + s[i + 1 :] for i in range(len(s))} | {s[:i] + "\0" + s[i:] for i in range(len(s) + 1)}

    def weight(self, token: str) -> float:
        """How much a word tells for a header, also with a misread letter."""
        known = self.judged.get(token)
        if known is None:
            if len(self.judged) > 300_000:
                self.judged.clear()
            known = self.judged[token] = self._weight(token)
        return known

    def _weight(self, t: str) -> float:
        if t in self.weights:
            return self.weights[t]
        if word_form(t) in self.frequent:
            return RUNNING
        if len(t) < 2 or t.isascii() and not t[0].isupper():
            return 0.0
        doubled = [self.weights.get(t.replace(x, y, 1), 0.0) for one, two in DOUBLES for x, y in ((one, two), (two, one)) if x in t]
        return max([0.0, *[w for w in doubled if w >= STRONG], *[self.near[k] for k in self._near(t) if k in self.near]])

    def kinds(self, lines: list[str]) -> list[str]:
        """Line kinds with ``header`` among them: lines at page edges whose words tell for a header, and surer ones elsewhere."""
        kinds = line_kinds(lines)
        found = repeated_headers(lines, kinds)
        edge = edges(kinds)
        for i, (line, kind) in enumerate(zip(lines, kinds)):
            if kind == "text" and may_be_header(line):
                told = sum(self.weight(t) for t in _TOKEN.findall(line) if not t.isdigit())
                if told >= (0.0 if i in found else HEADER_SUM if edge[i] else INNER_SUM):
                    kinds[i] = "header"
        return kinds

    def broken(self, lines: list[str], kinds: list[str]) -> list[tuple[int, int]]:
        """(line, line of the rest) of words that a line's end breaks."""
        out, text = [], [i for i, k in enumerate(kinds) if k in ("text", "heading", "table")]
        for i, j in zip(text, text[1:]):
            if kinds[i] != "text" or kinds[j] != "text":
                continue
            end = ends_broken(lines[i])
            start = _START.match(lines[j]) if end else None
            if not end or not start or start[1][0].isupper() and not end[1].isupper():
                continue
            left = _TOKEN.findall(lines[i])[-1].rstrip(HYPHENS)
            right = _TOKEN.findall(start[1])
            if not right:
                continue
            joined, kept = word_form(left + right[0]), word_form(left + "-" + right[0])
            if joined in self.frequent or kept not in self.frequent:
                out.append((i, j))
        return out


def _prepared(texts: DataFrame) -> tuple[dict[str, float], list[str], DataFrame, DataFrame]:
    counts = cut(count_words(texts))
    near = cut(misreadings(counts))
    return header_weights(counts), known_words(counts, near), counts, near


def line_findings(texts: DataFrame, weights: dict[str, float], frequent: list[str]) -> DataFrame:
    """Per line and kind what the layout tells, and every infrequent running word with its neighbours (kind ``word``)."""
    shared = texts.sparkSession.sparkContext.broadcast((weights, set(frequent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["table_name", "row_id", "elem_no", "line_no", "kind", "word", "before", "after"]
        pages = Pages(*shared.value)
        known = pages.frequent
        for batch in batches:
            rows: list[tuple] = []
            for table_name, row_id, elem_no, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.split("\n")
                kinds = pages.kinds(lines)
                for i, k in enumerate(kinds):
                    if k in ("header", "page_no"):
                        rows.append((table_name, row_id, elem_no, i + 1, k, None, None, None))
                rows += [(table_name, row_id, elem_no, i + 1, "hyphen", None, None, None) for i, _ in pages.broken(lines, kinds)]
                running = flow(lines, kinds)
                for k, (w, first, last) in enumerate(running):
                    if w not in known and len(w) >= 2:
                        before = running[k - 1][0] if k else ""
                        after = running[k + 1][0] if k + 1 < len(running) else ""
                        if first != last:  # the misread letter stands on one of the two lines
                            left = len(letters(_TOKEN.findall(lines[first])[-1].rstrip(HYPHENS)))
                            rows.append((table_name, row_id, elem_no, -(first + 1), f"{left}:{last + 1}", w, before, after))
                        else:
                            rows.append((table_name, row_id, elem_no, first + 1, "word", w, before, after))
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds_of = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of)], names=names)

    return texts.mapInArrow(run, "table_name string, row_id long, elem_no int, line_no int, kind string, word string, before string, after string")


def corrections(found: DataFrame, counts: DataFrame, near: DataFrame) -> DataFrame:
    """The best variant of each infrequent word where it stands: table_name, row_id, elem_no, line_no, first, word, before, after, variant.

    ``line_no`` is the line of the misread letter and ``first`` the line where the word begins, which differ in a broken word.

    Variants are ranked by how often they stand beside the word's neighbours;
    one that stands there no more than the word itself is no correction, nor is
    a word that is not in ``near``. A long, rare word
    of a much more frequent variant needs no neighbour, unless it differs by its
    particle only.
    """
    words = found.where("word is not null")
    possible = words.join(near, "word")
    pairs = counts.where("kind = 'pair'").select("a", "b", "n")
    left = pairs.select(F.col("a").alias("before"), F.col("b").alias("variant"), F.col("n").alias("n_left"))
    right = pairs.select(F.col("a").alias("variant"), F.col("b").alias("after"), F.col("n").alias("n_right"))
    own_left = pairs.select(F.col("a").alias("before"), F.col("b").alias("word"), F.col("n").alias("own_left"))
    own_right = pairs.select(F.col("a").alias("word"), F.col("b").alias("after"), F.col("n").alias("own_right"))
    scored = (
        possible.join(left, ["before", "variant"], "left").join(right, ["variant", "after"], "left")
        .join(own_left, ["before", "word"], "left").join(own_right, ["word", "after"], "left")
        .withColumn("beside", F.coalesce("n_left", F.lit(0)) + F.coalesce("n_right", F.lit(0)))
        .withColumn("own", F.coalesce("own_left", F.lit(0)) + F.coalesce("own_right", F.lit(0)))
        .withColumn("long", (F.col("size") >= SURE_LETTERS) & (F.col("n") < often_from(counts)) & (F.col("m") >= SURE_RATIO * F.col("n")) & ~F.col("particle"))
        .where(((F.col("beside") >= CONTEXT) & (F.col("beside") >= 2 * F.col("own"))) | F.col("long"))
    )
    best = scored.groupBy("table_name", "row_id", "elem_no", "line_no", "kind", "word", "before", "after").agg(F.max_by("variant", F.struct("beside", "m", "variant")).alias("variant"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, begins = [], []
            for line_no, kind, word, variant in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 8))):
                begins.append(abs(line_no))
                if line_no < 0:  # a broken word: which side has the letter that differs
                    split, last = map(int, kind.split(":"))
                    a, b = letters(word), letters(variant)
                    p = 0
                    while p < min(len(a), len(b)) and a[p] == b[p]:
                        p += 1
                    line_no = -line_no if p < split else last
                at.append(line_no)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at, pa.int32()), pa.array(begins, pa.int32()), *batch.columns[5:]], names=["table_name", "row_id", "elem_no", "line_no", "first", "word", "before", "after", "variant"])

    ordered = best.select("table_name", "row_id", "elem_no", "line_no", "kind", "word", "before", "after", "variant")
    return ordered.mapInArrow(place, "table_name string, row_id long, elem_no int, line_no int, first int, word string, before string, after string, variant string")


def find_noise(extracts: DataFrame, chunks: DataFrame) -> DataFrame:
    """One distinct row (table_name, row_id, elem_no, line_no, kind) per noisy line and kind.

    Kinds are hyphen, misread, header and page_no; a header has no other kind.
    Null and empty texts and elements have none.
    """
    texts = scanned_texts(extracts, chunks)
    weights, frequent, counts, near = _prepared(texts)
    found = cut(line_findings(texts, weights, frequent))
    layout = found.where("word is null").select("table_name", "row_id", "elem_no", "line_no", "kind")
    misread = corrections(found, counts, near).select("table_name", "row_id", "elem_no", "line_no", F.lit("misread").alias("kind"))
    return layout.unionAll(misread).distinct()


def corrected(lines: list[str], kinds: list[str], known: set[str], fixes: list[dict[str, str | int]]) -> list[str]:
    """The lines with corrections put in; a broken word is corrected on both its lines.

    Every occurrence gets the correction of its own neighbours, or else the one
    that the word has elsewhere in the line.
    """
    exact = {(f["first"], f["word"], f["before"], f["after"]): f["variant"] for f in fixes}
    in_line = {(f["first"], f["word"]): f["variant"] for f in sorted(fixes, key=lambda f: f["variant"])}
    running = flow(lines, kinds)
    tokens: dict[int, list[re.Match]] = {}
    taken: dict[int, int] = {}
    edits: dict[int, list[tuple[int, int, str]]] = {}
    for k, (w, first, last) in enumerate(running):
        for i in (first, last):
            if i not in tokens:
                tokens[i], taken[i] = list(_TOKEN.finditer(lines[i])), 0
        at = taken[last]
        taken[last] += 1
        if w in known or len(w) < 2:
            continue
        before = running[k - 1][0] if k else ""
        after = running[k + 1][0] if k + 1 < len(running) else ""
        variant = exact.get((first + 1, w, before, after)) or in_line.get((first + 1, w))
        if variant is None:
            continue
        if first == last:
            m = tokens[first][at]
            edits.setdefault(first, []).append((*m.span(), _in_form(m[0], w, variant)))
            thousands = tokens[first][at - 1] if at and variant == number_reading(w) else None  # I,9Io
            if thousands and lines[first][thousands.end() : m.start()] == "," and _LIKE_DIGITS.match(thousands[0].lower()):
                edits[first].append((*thousands.span(), thousands[0].translate(_AS_DIGITS)))
            continue
        m, n = tokens[first][-1], tokens[last][0]
        left, right = m[0].rstrip(HYPHENS), n[0].lstrip(HYPHENS)
        new = _in_form(left + right, w, variant)
        split = len(left) if new.startswith(left) else max(1, len(new) - len(right))
        edits.setdefault(first, []).append((m.start(), m.start() + len(left), new[:split]))
        edits.setdefault(last, []).append((n.end() - len(right), n.end(), new[split:]))
    out = list(lines)
    for i, changes in edits.items():
        for start, end, new in sorted(set(changes), reverse=True):
            out[i] = out[i][:start] + new + out[i][end:]
    return out


def repair_text(text: str, pages: Pages, fixes: list[dict[str, str | int]]) -> str:
    """The text in continuous paragraphs: headers and page numbers gone, broken words joined, corrections put in."""
    lines = text.split("\n")
    kinds = pages.kinds(lines)
    rest = {j: i for i, j in pages.broken(lines, kinds)}
    lines = corrected(lines, kinds, pages.frequent, fixes)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            out.append("".join(held).strip())
            held.clear()

    gap = False
    for i, (line, kind) in enumerate(zip(lines, kinds)):
        if kind in ("header", "page_no"):
            continue
        if kind == "text":
            if held and i in rest:
                held[-1] = held[-1].rstrip().rstrip(HYPHENS)
                held.append(line.strip())
            elif held and gap and held[-1].rstrip()[-1:] in ".?!":
                flush()
                held.append(line.strip())
            else:
                held.append((" " if held else "") + line.strip())
            gap = False
        elif kind == "blank":
            gap = True
            if held and held[-1].rstrip()[-1:] in ".?!":
                flush()
        elif kind == "mark" and held and held[-1].rstrip()[-1:] not in ".?!":
            out.append(line.strip())  # the paragraph goes on over the page
        else:
            flush()
            out.append(line)
    flush()
    return "\n\n".join(_tables_together(out))


def _tables_together(blocks: list[str]) -> list[str]:
    out: list[str] = []
    for b in blocks:
        if out and b.startswith("|") and out[-1].startswith("|"):
            out[-1] += "\n" + b
        else:
            out.append(b)
    return out


def _in_form(token: str, word: str, variant: str) -> str:
    """The variant with the numbers and capitals of the token."""
    if variant == number_reading(word):
        return read_number(token)
    digits = iter(_NUMBERS.findall(token)) if not _LATIN.search(word) else None
    new = _NUMBERS.sub(lambda x: next(digits, x[0]), variant) if digits else variant
    return new.upper() if token.isupper() and len(token) > 1 else new[:1].upper() + new[1:] if token[:1].isupper() else new


def repair(extracts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every text repaired: table_name, row_id, elem_no, text. Clean texts come out with their paragraphs joined."""
    texts = scanned_texts(extracts, chunks)
    weights, frequent, counts, near = _prepared(texts)
    found = line_findings(texts, weights, frequent).where("word is not null")
    fixes = corrections(found, counts, near).groupBy("table_name", "row_id", "elem_no").agg(F.collect_list(F.struct("first", "word", "before", "after", "variant")).alias("fixes"))
    shared = texts.sparkSession.sparkContext.broadcast((weights, set(frequent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = Pages(*shared.value)
        for batch in batches:
            new = [repair_text(text, pages, fixes or []) for text, fixes in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, pa.string())], names=["table_name", "row_id", "elem_no", "text"])

    keys = ["table_name", "row_id", "elem_no"]
    return texts.join(fixes, keys, "left").select(*keys, "text", "fixes").mapInArrow(run, "table_name string, row_id long, elem_no int, text string")
