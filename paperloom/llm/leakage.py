"""Evaluation items that leaked into training documents.

Method: q-gram lemma filtering. A stretch of n characters that went through k
edits still shares at least n + 1 - (k + 1) q of its q-grams with the original,
near one diagonal. So a task counts, for every document and item, the q-grams
that both have in overlapping bands of diagonals, keeps the regions that reach
the item's bound, and verifies each with an alignment inside its band.

The lemma holds for any subset of the q-grams as well: k edits destroy no more
of the counted ones than touch them. So an item counts the q-grams that few
items of the suite have (``RARITIES``), as long as its bound stays at ``ENOUGH``
or above, and all of them otherwise; what is not counted lowers the bound and
drops no case. The bound is the fewest counted q-grams that any stretch of half
the item's words keeps when k words anywhere in it are changed or left out; k is
two words, and one more in ``EDITED``. Stretches with more changed words are found, too, unless
nearly all counted q-grams of the shortest of them are hit. A region goes to the
alignment only if its equal runs of ``RUN`` characters cover as much of the item
as every alignment that is accepted does, which loses nothing.

Items are few (a fixed evaluation suite). They go to the tasks in blocks whose
size is checked; a larger suite takes more passes, never a larger broadcast.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import spread

Q = 7  # characters of a counted q-gram
RUN = 5  # characters of the shortest run of equal characters in an alignment
EDITED = 11  # k: two words of a stretch, and one more in so many, may be changed or left out
WINDOW = 60_000  # characters of the documents whose q-grams are counted at a time
BAND = 96  # diagonals of a band: words left out, or a layout line of half of that put in, keep a stretch in one
PART = 0.5  # share of an item's words that makes a case
SLACK = 0.06  # how much of that share may lie in changed words at the ends of a stretch
AGREE = 0.82  # share of a stretch's characters that must be equal
SHORT = 12  # items of fewer characters count where they stand whole and unchanged
RARITIES = (4, 8, 16, 32, 64)  # most places in the suite of a counted q-gram, the first that leaves an item ``ENOUGH``
ENOUGH = 32
BLOCK_CHARS = 1_000_000  # characters of the items that one pass takes; their index has some 60 bytes for each

# Letters of other scripts that look like Latin letters.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁһԛԝαβενορτυχικѵ", "abekmhopctyxijsdhqwabevoptuxikv")
_FOREIGN = re.compile("[Ͱ-ԯ]")
_SKIP = re.compile(r"[\W_]+")
_NUMBER = re.compile(r"^\s*\[[^\]]{0,40}\d[^\]]{0,10}\]\s*")
_MARK = re.compile(r"<!--.{0,60}?-->")


def plain(text: str) -> str:
    """Letters and digits only: one width, composition, case and letter form; no layout marks."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "<!--" in text:
        text = _MARK.sub(" ", text)
    text = _SKIP.sub("", text)
    return text.translate(LOOKALIKES) if _FOREIGN.search(text) else text


def item_text(text: str) -> tuple[str, np.ndarray]:
    """Plain item without its question number, and the word number of every character."""
    words = [w for w in (plain(w) for w in unicodedata.normalize("NFKC", _NUMBER.sub("", text)).split()) if w]
    return "".join(words), np.repeat(np.arange(len(words)), [len(w) for w in words])


def gram_codes(text: str, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at every place of a text, by doubling."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < q:
        return np.zeros(0, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    mask = (1 << 64) - 1
    codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    done, have, power, size, need = None, codes, base, 1, q
    with np.errstate(over="ignore"):
        while need:
            if need & 1:
                done = have if done is None else done[: len(done) - size] * np.uint64(power) + have[len(have) - (len(done) - size) :]
            need >>= 1
            if need:
                have = have[: len(have) - size] * np.uint64(power) + have[size:]
                power, size = power * power & mask, size * 2
    done = done[: len(codes) - q + 1]
    return done ^ (done >> np.uint64(29))


def fewest_grams(words: np.ndarray, counted: np.ndarray) -> int:
    """Fewest counted q-grams that a stretch of half an item's words keeps when any k of its words are changed.

    ``words`` has the word number of every character, ``counted`` tells which
    q-grams count. A word takes all q-grams that touch it.
    """
    total = int(words[-1]) + 1
    first = np.searchsorted(words, np.arange(total + 1))
    upto, grams = np.r_[0, np.cumsum(counted)], len(counted)
    between = lambda a, b: upto[np.clip(b, 0, grams)] - upto[np.clip(a, 0, grams)]
    lost = between(first[:-1] - Q + 1, first[1:])
    w = needed_words(total)
    k = min(w, 2 + w // EDITED)
    starts = np.arange(total - w + 1)
    held = np.maximum(between(first[starts], first[starts + w] - Q + 1), 0)
    worst = np.sort(np.lib.stride_tricks.sliding_window_view(lost, w), axis=1)[:, w - k :].sum(axis=1)
    return int((held - worst).min())


def needed_words(total: int) -> int:
    """Words of a stretch that makes a case, of an item of ``total`` words."""
    return math.ceil((PART - SLACK) * total)


class _Runs:
    """The runs of ``RUN`` characters of an item, to see how much of it a region covers."""

    def __init__(self, text: str, words: np.ndarray):
        g = gram_codes(text, RUN)
        self.codes, where, n = np.unique(g, return_inverse=True, return_counts=True)
        self.one = np.zeros(len(self.codes), dtype=np.int64)
        self.one[where] = np.arange(len(g))  # the last place of each run,
        self.other = np.zeros(len(self.codes), dtype=np.int64)
        self.other[where[::-1]] = np.arange(len(g))[::-1]  # and the first
        self.free = np.zeros(len(words), dtype=bool)  # runs at more than two places are taken as covered
        self.free[: len(g)] = n[where] > 2
        least = needed_words(int(words[-1]) + 1)
        latest = np.searchsorted(words, words - least + 1, "right")  # a stretch that ends here begins before this place
        self.ends = np.flatnonzero(latest)
        self.begins = latest[self.ends] - 1
        self.fewest = AGREE * float((self.ends - self.begins).min(initial=len(words)))

    def cover(self, codes: np.ndarray, diagonal: int) -> bool:
        """Whether the places in equal runs near a diagonal can make a case; every alignment that is accepted passes.

        ``codes`` are the hashes of a region's runs and ``diagonal`` is relative to its start.
        """
        if not len(self.codes):
            return False
        slot = np.searchsorted(self.codes, codes)
        slot[slot == len(self.codes)] = 0
        t = np.flatnonzero(self.codes[slot] == codes)
        slot = slot[t]
        t -= diagonal
        begins = self.free.copy()
        for place in (self.one[slot], self.other[slot]):
            begins[place[np.abs(t - place) <= BAND]] = True
        reach = begins.copy()
        for j in range(1, RUN):
            reach[j:] |= begins[:-j]
        if np.count_nonzero(reach) < self.fewest:
            return False
        gain = np.zeros(len(reach) + 1)
        np.cumsum(reach - AGREE, out=gain[1:])
        lowest = np.minimum.accumulate(gain)
        return bool((gain[self.ends + 1] - lowest[self.begins] >= -1e-9).any())


class Items:
    """Index of a block of items: q-gram hashes with their places, and what alignment needs.

    Items of equal plain text are one entry with several ids. Places that are
    counted are in ``item`` and ``place``, by ``first`` and ``n`` of each hash.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        ids: dict[str, list[int]] = {}
        words_of: dict[str, np.ndarray] = {}
        for item_id, text in rows:
            s, words = item_text(text or "")
            if s:
                ids.setdefault(s, []).append(item_id)
                words_of.setdefault(s, words)
        self.short: dict[int, dict[str, list[int]]] = defaultdict(dict)
        for s in [s for s in ids if len(s) < SHORT]:
            self.short[len(s)][s] = ids.pop(s)
        self.texts, self.ids, self.words = list(ids), list(ids.values()), [words_of[s] for s in ids]
        codes_of = [gram_codes(s) for s in self.texts]
        self.runs = [_Runs(s, w) for s, w in zip(self.texts, self.words)]
        self.seeds: list[dict[str, list[int]] | None] = [None] * len(self.ids)
        self.longest = max(map(len, self.texts), default=0)
        none = np.zeros(0, dtype=np.uint64)
        all_codes, inverse, n = np.unique(np.concatenate(codes_of or [none]), return_inverse=True, return_counts=True)
        places = n[inverse]  # of each q-gram of each item, in the whole suite
        hashes, items, at, need, done = [], [], [], [], 0
        for k, g in enumerate(codes_of):
            seen_at = places[done : done + len(g)]
            done += len(g)
            for most in (*RARITIES, None):
                counted = seen_at <= most if most else np.ones(len(g), dtype=bool)
                bound = fewest_grams(self.words[k], counted)
                if bound >= ENOUGH or most is None:
                    break
            need.append(max(1, bound))
            hashes.append(g[counted])
            at.append(np.flatnonzero(counted).astype(np.int32))
            items.append(np.full(len(at[-1]), k, dtype=np.int32))
        self.need = np.asarray(need or [0])
        h = np.concatenate(hashes or [none])
        order = np.argsort(h, kind="stable")
        self.codes, self.first, self.n = np.unique(h[order], return_index=True, return_counts=True)
        self.item = np.concatenate(items)[order] if items else np.zeros(0, dtype=np.int32)
        self.place = np.concatenate(at)[order] if at else np.zeros(0, dtype=np.int32)
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.codes >> np.uint64(42)).astype(np.int64)] = True

    def seed_places(self, k: int) -> dict[str, list[int]]:
        """Places of every run of ``RUN`` characters in an item."""
        if self.seeds[k] is None:
            places, s = defaultdict(list), self.texts[k]
            for i in range(len(s) - RUN + 1):
                places[s[i : i + RUN]].append(i)
            self.seeds[k] = places
        return self.seeds[k]

    def whole(self, joined: str) -> list[tuple[int, list[int]]]:
        """(place, ids) of short items in the joined documents."""
        out = []
        for size, texts in self.short.items():
            wanted = np.concatenate([gram_codes(s, size) for s in texts])
            for at in np.flatnonzero(np.isin(gram_codes(joined, size), wanted)).tolist():
                if ids := texts.get(joined[at : at + size]):
                    out.append((at, ids))
        return out

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first place, last place, diagonal) of regions of the joined documents, given by their hashes, that reach the bound."""
        if not len(self.codes):
            return []
        out = []
        over = self.longest + 2 * BAND  # no band of an item is longer, so each lies whole in a window
        width = max(WINDOW, 4 * over)
        for start in range(0, len(codes), width - over):
            out += self._regions(codes[start : start + width], start)
            if start + width >= len(codes):
                break
        return out

    def _regions(self, h: np.ndarray, start: int) -> list[tuple[int, int, int, int]]:
        at = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        slot = np.searchsorted(self.codes, h[at])
        slot[slot == len(self.codes)] = 0
        same = self.codes[slot] == h[at]
        at, slot = at[same], slot[same]
        if not len(at):
            return []
        n = self.n[slot]
        pos = np.repeat(at, n)
        entry = np.arange(len(pos)) + np.repeat(self.first[slot] - np.cumsum(n) + n, n)
        diagonal = pos - self.place[entry]
        bands = (len(h) + self.longest) // BAND + 3
        cell = self.item[entry].astype(np.int64) * bands
        need, out = np.repeat(self.need, bands), []
        for shift in (0, BAND // 2):
            key = cell + (diagonal + (shift + self.longest)) // BAND
            full = np.bincount(key, minlength=len(need)) >= need
            kept = np.flatnonzero(full[key])
            if not len(kept):
                continue
            # a place of the item counts once in a band, however often it is hit
            k = key[kept]
            once, order = np.unique(k * self.longest + self.place[entry[kept]], return_index=True)
            held = np.bincount(once // self.longest, minlength=len(need)) >= need
            kept = kept[order[held[once // self.longest]]]
            kept = kept[np.lexsort((diagonal[kept], key[kept]))]
            k, d, p = key[kept], diagonal[kept], pos[kept]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, dtype=np.int64)
            ends = np.r_[starts[1:], len(k)]
            if len(starts):
                low, high = np.minimum.reduceat(p, starts) + start, np.maximum.reduceat(p, starts) + start + Q
                out += zip((k[starts] // bands).tolist(), low.tolist(), high.tolist(), (d[(starts + ends) // 2] + start).tolist())
        return out

    def verify(self, k: int, region: str, diagonal: int) -> bool:
        """Whether the region holds one stretch of half the item's words, by alignment within the band.

        ``diagonal`` is that of the region's start. The alignment is a chain of
        equal runs, found by dynamic programming: runs gain their length, and
        changed, missing and inserted characters between two runs cost. What may
        be missing between two runs is what ``AGREE`` leaves of the item; what
        is put in is limited by the band alone.
        """
        seeds, runs, last = self.seed_places(k), [], {}
        for t in range(len(region) - RUN + 1):
            for i in seeds.get(region[t : t + RUN], ()):
                d = t - i
                if abs(d - diagonal) > BAND:
                    continue
                run = last.get(d)
                if run is not None and run[1] == i + RUN - 1:
                    run[1] = i + RUN
                else:
                    run = [i, i + RUN, d]
                    last[d] = run
                    runs.append(run)
        if not runs:
            return False
        runs.sort()
        words, least = self.words[k], needed_words(int(self.words[k][-1]) + 1)
        gap = math.ceil((1 - AGREE) * len(words))
        longest = max(b - a for a, b, _ in runs)
        best: list[tuple[float, int, int]] = []  # score, first place in the item, equal characters
        for j, (a, b, d) in enumerate(runs):
            score, start, equal = float(b - a), a, b - a
            for x in range(j - 1, -1, -1):
                c, e, f = runs[x]
                if c + longest + gap < a:  # too much is missing after this run and all before it
                    break
                if e >= b or e + f >= b + d:
                    continue
                over = max(0, e - a, e + f - a - d)
                missing, put_in = a + over - e, a + over + d - e - f
                if missing > gap:
                    continue
                cost = 0.6 * missing + min(0.5 * max(0, put_in - missing), 6 + 0.02 * put_in)
                s = best[x][0] + (b - a - over) - cost
                if s > score:
                    score, start, equal = s, best[x][1], best[x][2] + b - a - over
            best.append((score, start, equal))
            stretch = b - start
            if equal >= AGREE * stretch and int(words[b - 1]) - int(words[start]) + 1 >= least:
                return True
        return False


def leaked_items(texts: list[str | None], items: Items) -> list[tuple[int, int]]:
    """(place of the text, item id) of each leak in a batch of texts."""
    plains = [plain(t) if t else "" for t in texts]
    joined = "\0".join(plains)
    starts = np.cumsum([0, *(len(p) + 1 for p in plains)])
    runs = gram_codes(joined, RUN)
    tried: set[tuple[int, int, int]] = set()
    leaks: set[tuple[int, int]] = set()
    for k, first, end, diagonal in items.candidates(gram_codes(joined)):
        for doc in range(int(np.searchsorted(starts, first, "right")) - 1, int(np.searchsorted(starts, end - 1, "right"))):
            low = max(int(starts[doc]), diagonal - BAND)
            high = min(int(starts[doc + 1]) - 1, diagonal + len(items.texts[k]) + BAND)
            if low + RUN > high or (doc, items.ids[k][0]) in leaks or (k, doc, diagonal) in tried:
                continue
            tried.add((k, doc, diagonal))
            if items.runs[k].cover(runs[low : high - RUN + 1], diagonal - low) and items.verify(k, joined[low:high], diagonal - low):
                leaks.update((doc, i) for i in items.ids[k])
    for at, ids in items.whole(joined):
        leaks.update((int(np.searchsorted(starts, at, "right")) - 1, i) for i in ids)
    return sorted(leaks)


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Columns doc_id and item_id: every document that holds an item or half of its words in one stretch.

    One distinct row per pair. Null and empty texts and items leak nothing;
    items under ``SHORT`` characters are found whole only; whole texts are
    searched, and equal items are found under each of their ids. Items are taken in blocks of ``BLOCK_CHARS``
    characters, one pass over the documents each.
    """
    sized = items.select(F.col("item_id"), F.col("text")).where("text is not null and text <> ''").distinct()
    total = sized.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / BLOCK_CHARS * 1.2))
    context = documents.sparkSession.sparkContext
    rows = spread(documents.select("doc_id", "text").where("text is not null and text <> ''"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", sized.schema["item_id"].dataType)])

    def search(block: int) -> DataFrame:
        part = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        shared = context.broadcast(Items([(r["item_id"], r["text"]) for r in part]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for a in range(0, batch.num_rows, 400):
                    found = leaked_items(texts.slice(a, 400).to_pylist(), index)
                    docs = ids.take(pa.array([a + d for d, _ in found], type=pa.int64()))
                    yield pa.RecordBatch.from_arrays([docs, pa.array([i for _, i in found], type=pa.int64())], names=["doc_id", "item_id"])

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, [search(b) for b in range(blocks)]).distinct()


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Per suite and language: items that leaked and the documents that hold them."""
    return (
        leaks.join(items.select("item_id", "suite", "lang"), "item_id").groupBy("suite", "lang")
        .agg(F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("documents"), F.count("*").alias("leaks"))
    )
