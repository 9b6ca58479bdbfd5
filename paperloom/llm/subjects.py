"""Subject areas of documents by class-association rules.

Method: the sentences of hand-labelled documents are transactions of word stems
and of the document's subjects. Parallel frequent-pattern growth finds the sets
of one or two words that occur with a subject: the words of a transaction are
ordered by frequency, each word's group gets the more frequent words before it
(its conditional transactions), and the groups grow their sets by partial sums,
to that length and no further. A rule "words -> subject" has a calibrated
confidence: the lower bound of its rate, so a rule seen a few times counts less
than one seen often. A pair of words makes a rule only if one of them points to
the subject by itself, and is redundant unless it is surer than that word can be. Every
sentence of every document is scored by its matching rules, and a document has
the subjects that more than one in twelve of its sentences are about.

Fitting reads at most ``LABELLED_DOCUMENTS`` labelled documents (all of them up
to that bound): one in ``HELD_OUT`` to calibrate, the others to mine. Scoring
covers all documents, whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.session import cut, spread

LABELLED_DOCUMENTS = 20_000
SHARE = 12  # a subject counts when more than one in so many sentences are about it
LEAST_SUPPORT = 3  # sentences with all words of a rule
LEAST_LIFT = 1.6  # of a word, to take part in rules
LEAST_CONFIDENCE = 0.1
Z = 1.6  # standard errors from the rate at which its bounds are taken
CUTS = (0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85)
HELD_OUT = 5  # one in so many labelled documents is kept from mining, to calibrate on
MOST_RULES = 400_000  # rules that are broadcast: the surest of each subject, each subject an equal share

# Korean particles that are taken off a word.
PARTICLES = "으로부터 에서는 에게서 으로서 이라는 에는 에서 에게 까지 부터 으로 로서 이나 이며 처럼 보다 마다 하고 에만 은 는 이 가 을 를 의 에 와 과 로 도 만 나".split()
_PARTICLE = re.compile("^([가-힣]{2,}?)(?:" + "|".join(sorted(PARTICLES, key=len, reverse=True)) + ")$")
_WORD = re.compile(r"[가-힣]{2,}|[a-z]{2,}(?:-[a-z]+)*")
_END = re.compile(r"(?<=[.?!])[\"')\]]*\s+")
_ITEM = re.compile(r"^(?:[-*•·]|\d{1,3}[.)]|\(?[가-하][.)]|[QAqa][.:]|[문답][.:])\s+")
_QUESTION = re.compile(r"^(?:[Qq]|문)[.:)]?\s")
_MARK = re.compile(r"<!--.{0,80}?-->")
_LETTERS = re.compile(r"[가-힣]{2}|[A-Za-z]{2}")


def sentences(text: str) -> list[str]:
    """Running sentences of a text: no headings, questions of a question list, table rows or page markers; list marks taken off."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if "<!--" in text:
        text = _MARK.sub(" ", text)
    out, held = [], []

    def flush() -> None:
        if held:
            out.extend(s for s in _END.split(" ".join(held)) if _LETTERS.search(s))
            held.clear()

    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#|":
            if not line or line[0] != "|" or held:
                flush()
            continue
        if _QUESTION.match(line):
            flush()
            continue
        if _ITEM.match(line):
            flush()
            line = _ITEM.sub("", line)
        held.append(line)
    flush()
    return out


_STEMS: dict[str, str] = {}


def _stem(word: str) -> str:
    if word[0] >= "가":
        m = _PARTICLE.match(word)
        return m[1] if m else word
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


def words(sentence: str) -> set[str]:
    """Word stems of a sentence."""
    out = set()
    for w in _WORD.findall(sentence.lower()):
        stem = _STEMS.get(w)
        if stem is None:
            if len(_STEMS) > 200_000:
                _STEMS.clear()
            stem = _STEMS[w] = _stem(w)
        out.add(stem)
    return out


def sentence_words(documents: DataFrame) -> DataFrame:
    """Distinct word stems of every sentence: doc_id, sentence_no, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, stems = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, s in enumerate(sentences(text)):
                    ids.append(doc_id)
                    numbers.append(n)
                    stems.append(sorted(words(s)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(stems, pa.list_(pa.string()))], names=["doc_id", "sentence_no", "words"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and text <> ''")
    return rows.mapInArrow(run, "doc_id long, sentence_no int, words array<string>")


def chosen_labels(labels: DataFrame, most: int = LABELLED_DOCUMENTS) -> DataFrame:
    """doc_id, subjects (sorted) and held (kept from mining) of the labelled documents that fitting reads.

    Repeated labels count once; labels without subject or document are left out.
    """
    per_doc = labels.where("doc_id is not null and subject_code is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject_code")).alias("subjects"))
    chosen = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return chosen.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD_OUT)) == 0)


def labelled_sentences(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """Sentences of labelled documents: doc_id, sentence_no, words, subjects."""
    texts = spread(documents.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id", "left_semi")
    return sentence_words(texts).join(F.broadcast(chosen.select("doc_id", "subjects")), "doc_id")


def bound(k: Column, n: Column, z: float) -> Column:
    """End of the score interval of the rate k / n, ``z`` standard errors away (lower where negative)."""
    rate = k / n
    return (rate + Z * Z / (2 * n) + F.lit(z) * F.sqrt(rate * (1 - rate) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def mine_rules(rows: DataFrame) -> DataFrame:
    """Rules from labelled sentences: words (sorted), subject, support, confidence; redundant ones pruned."""
    rows = cut(rows.dropDuplicates(["words", "subjects"]))  # copies of a sentence count once
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "words array<string>, subject string, support long, confidence double")
    share = rows.select(F.explode("subjects").alias("subject")).groupBy("subject").agg((F.count("*") / F.lit(total)).alias("share"))
    single = rows.select(F.explode("words").alias("word"), "subjects")
    counts = single.groupBy("word").agg(F.count("*").alias("n"))
    pairs = single.select("word", F.explode("subjects").alias("subject")).groupBy("word", "subject").agg(F.count("*").alias("k"))
    telling = (
        pairs.join(counts, "word").join(F.broadcast(share), "subject")
        .where((F.col("k") >= LEAST_SUPPORT) & (F.col("k") / F.col("n") >= LEAST_LIFT * F.col("share"))).select("word").distinct()
    )
    ranked = counts.join(telling, "word").select("word", F.struct(-F.col("n"), "word").alias("rank"))
    transactions = (
        rows.select("doc_id", "sentence_no", "subjects", F.explode("words").alias("word")).join(ranked, "word")
        .groupBy("doc_id", "sentence_no").agg(F.sort_array(F.collect_set("rank")).alias("ranks"), F.first("subjects").alias("subjects"))
        .select(F.col("ranks.word").alias("words"), "subjects")
    )
    # each word with each more frequent one before it, and alone
    grown = transactions.select("words", "subjects", F.posexplode("words").alias("at", "last"))
    grown = grown.select("subjects", "last", F.explode(F.concat(F.slice("words", 1, F.col("at")), F.array(F.lit(None).cast("string")))).alias("other"))
    sets = grown.groupBy("last", "other").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SUPPORT)
    with_head = grown.select("last", "other", F.explode("subjects").alias("subject")).groupBy("last", "other", "subject").agg(F.count("*").alias("support"))
    with_head = with_head.where(F.col("support") >= LEAST_SUPPORT)
    named = lambda df: df.withColumn("words", F.sort_array(F.array_compact(F.array("last", "other")))).drop("last", "other")
    bodies = named(sets)
    rules = (
        named(with_head).join(bodies, "words").join(F.broadcast(share), "subject")
        .withColumn("confidence", bound(F.col("support"), F.col("n"), -Z))
        .withColumn("upper", bound(F.col("support"), F.col("n"), Z))
        .where((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("confidence") >= LEAST_LIFT * F.col("share")))
        .select("words", "subject", "support", "confidence", "upper")
    )
    rules = cut(rules)
    simple = rules.where("size(words) = 1").select(F.col("words")[0].alias("word"), "subject", F.col("upper").alias("already"))
    implied = (
        rules.where("size(words) = 2").select("*", F.explode("words").alias("word")).join(simple, ["word", "subject"])
        .groupBy("words", "subject").agg(F.max("already").alias("already"))
    )
    return (
        rules.join(implied, ["words", "subject"], "left")
        .where((F.size("words") == 1) | (F.col("confidence") > F.col("already"))).select("words", "subject", "support", "confidence")
    )


class _Telling(dict):
    """Word as written to its stem if a rule has it, else to nothing; emptied when full."""

    def __init__(self, stems: set[str]):
        super().__init__()
        self.stems = stems

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        stem = _stem(word)
        self[word] = stem = stem if stem in self.stems else ""
        return stem


class Scorer:
    """Rules as lookups: word, or pair of words, to (subject, confidence)."""

    def __init__(self, rules: list[tuple[list[str], str, float]]):
        self.one: dict[str, list[tuple[str, float]]] = {}
        self.two: dict[str, dict[str, list[tuple[str, float]]]] = {}
        for body, subject, confidence in rules:
            if len(body) == 1:
                self.one.setdefault(body[0], []).append((subject, confidence))
            else:
                self.two.setdefault(body[0], {}).setdefault(body[1], []).append((subject, confidence))
        self.telling = _Telling({w for body, _, _ in rules for w in body})

    def evidence(self, sentence: str) -> dict[str, float]:
        """Confidence of the surest matching rule per subject."""
        best: dict[str, float] = {}
        telling = self.telling
        stems = {s for w in _WORD.findall(sentence) if (s := telling[w])}
        for w in stems:
            for s, c in self.one.get(w, ()):
                if c > best.get(s, 0):
                    best[s] = c
            pairs = self.two.get(w)
            if pairs:
                for v in stems & pairs.keys():
                    for s, c in pairs[v]:
                        if c > best.get(s, 0):
                            best[s] = c
        return best

    def about(self, found: list[dict[str, float]], sure: float) -> Counter:
        """Sentences per subject: each goes to its surest subject; an unsure one to a subject that the document has anyway."""
        count: Counter = Counter()
        unsure = []
        for e in found:
            if e:
                subject, c = max(e.items(), key=lambda x: (x[1], x[0]))
                if c >= sure:
                    count[subject] += 1
                else:
                    unsure.append(e)
        strong = dict(count)
        for e in unsure:
            likely = [(strong[s], c, s) for s, c in e.items() if s in strong]
            if likely:
                count[max(likely)[2]] += 1
            else:
                subject, c = max(e.items(), key=lambda x: (x[1], x[0]))
                if c >= 0.6 * sure:
                    count[subject] += 1
        return count

    def subjects(self, text: str, cuts: tuple[float, ...]) -> list[list[str]]:
        """Subjects of a text at each cut."""
        found = [self.evidence(s) for s in sentences(text.lower())]
        return [sorted(s for s, k in self.about(found, c).items() if k * SHARE > len(found)) for c in cuts]


def _score(documents: DataFrame, rules: list, cuts: tuple[float, ...]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            ids, numbers, codes = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, found in enumerate(scorer.subjects(text, cuts)):
                    for s in found:
                        ids.append(doc_id)
                        numbers.append(n)
                        codes.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(codes, pa.string())], names=["doc_id", "cut_no", "subject_code"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and text <> ''")
    return rows.mapInArrow(run, "doc_id long, cut_no int, subject_code string")


def calibrate(documents: DataFrame, held: DataFrame, rules: list) -> float:
    """The sureness, out of ``CUTS``, that agrees best (F1) with the labels of documents that the rules were not mined from."""
    truth = held.select("doc_id", F.explode("subjects").alias("subject_code"))
    texts = spread(documents.select("doc_id", "text")).join(F.broadcast(held.select("doc_id")), "doc_id", "left_semi")
    scored = _score(texts, rules, CUTS)
    sums = scored.join(F.broadcast(truth.withColumn("right", F.lit(1))), ["doc_id", "subject_code"], "left").groupBy("cut_no").agg(F.count("*").alias("n"), F.count("right").alias("right")).collect()
    n = truth.count()
    f1 = {r["cut_no"]: 2 * r["right"] / (r["n"] + n) for r in sums}
    return CUTS[max(f1, key=lambda k: (f1[k], k))] if f1 else CUTS[len(CUTS) // 2]


def surest(rules: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """The surest rules of each subject, each subject an equal share of ``most``; all where they are fewer."""
    n = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("confidence"), F.desc("support"), "words"))
    share = rules.select(F.col("subject").alias("_s")).distinct().agg(F.count("*").alias("_of"))
    ranked = rules.withColumn("_n", n).crossJoin(F.broadcast(share))
    return ranked.where(F.col("_n") <= F.floor(F.lit(most) / F.col("_of"))).select(*rules.columns)


def fit(documents: DataFrame, labels: DataFrame) -> tuple[list[tuple[list[str], str, float]], float]:
    """The pruned rules on the driver, at most ``MOST_RULES``, and the sureness from which a sentence is about a subject."""
    chosen = cut(chosen_labels(labels))
    rules = cut(mine_rules(labelled_sentences(documents, chosen.where("not held"))))
    kept = [(r["words"], r["subject"], r["confidence"]) for r in surest(rules).collect()]
    return kept, calibrate(documents, chosen.where("held"), kept)


def assign_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """Columns doc_id and subject_code: the subjects of every document, none to several each.

    Null, empty and wordless texts have no subject; repeated rows give one row
    per subject; a subject that ``areas`` lacks is not given.
    """
    rules, sure = fit(documents, labels)
    found = _score(spread(documents.select("doc_id", "text")), rules, (sure,)).select("doc_id", "subject_code").distinct()
    return found.join(F.broadcast(areas.select("subject_code").distinct()), "subject_code", "left_semi").select("doc_id", "subject_code")


def composition(documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per subject and language: documents and their characters; 'none' for documents without subject."""
    sized = documents.select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return (
        sized.join(subjects, "doc_id", "left").groupBy(F.coalesce("subject_code", F.lit("none")).alias("subject_code"), "lang")
        .agg(F.count("*").alias("documents"), F.sum("chars").cast("long").alias("chars"))
    )
