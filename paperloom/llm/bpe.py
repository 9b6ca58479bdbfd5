"""Byte-pair encoding of a whole corpus with a public vocabulary.

Method: contiguous rank array. A word's bytes are held as an array of part
boundaries with the rank of every adjacent pair beside it. The array is scanned
for its smallest rank, the boundary inside that pair is deleted, and the ranks
of the two neighbouring pairs are refreshed, until no pair has a rank. Words
over ``SHORT_WORD`` bytes, for which repeated scans would be quadratic, keep the
same boundaries as a linked list with a heap of ranks; both give the same ids.

Spark spreads the documents; a task encodes its Arrow batches and joins cached
encodings of words, so the cost of a merge is paid once per distinct word.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import spread

# The published pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT_WORD = 192
CACHE_WORDS = 400_000
NONE = 1 << 60


def default_vocabulary() -> str:
    """Path of the byte_bpe_50k rank file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: byte string to rank, which is also its id."""
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by repeated scans of the rank array."""
    get = ranks.get
    cuts = list(range(len(word) + 1))
    pair = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == NONE:
            break
        i = pair.index(low)
        del cuts[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[cuts[i] : cuts[i + 2]], NONE)
        if i:
            pair[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids with a heap over a linked list of parts, for long words."""
    n, get = len(word), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]], NONE)) != NONE:
                heapq.heappush(heap, (r, i, after[end]))
        p = before[i]
        if p >= 0 and (r := get(word[p:end], NONE)) != NONE:
            heapq.heappush(heap, (r, p, end))
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


class WordIds(dict):
    """Word to its ids as int32 bytes; emptied when full, which costs only time."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = [whole]
        else:
            ids = (merge_short if len(raw) <= SHORT_WORD else merge_long)(raw, self.ranks)
        packed = np.asarray(ids, dtype=np.int32).tobytes()
        if len(raw) <= SHORT_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed


def encode_texts(texts: list[str | None], words: WordIds, find) -> pa.Array:
    """One list of ids per text; empty and null texts give an empty list."""
    lookup, parts, ends = words.__getitem__, [], [0]
    total = 0
    for text in texts:
        if text:
            packed = b"".join(map(lookup, find(text)))
            parts.append(packed)
            total += len(packed) // 4
        ends.append(total)
    values = pa.array(np.frombuffer(b"".join(parts), dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Ids of every text: columns ``key`` and ``ids`` (array<int>).

    One row per input row, repeated rows included. Null and empty texts give an
    empty array; white space is text; strings that look like special tokens are
    ordinary text. Columns other than the two named are ignored. The vocabulary
    file (under 1 MB, checked) is read once on the driver and broadcast.
    """
    ranks = read_ranks(vocabulary or default_vocabulary())
    if len(ranks) > 1_000_000:
        raise ValueError("vocabulary too large to broadcast")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    key_type = rows.schema["key"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(shared.value)
        find = regex.compile(PATTERN).findall
        for batch in batches:
            texts = batch.column(1)
            for start in range(0, batch.num_rows, 500):
                part = texts.slice(start, 500).to_pylist()
                ids = encode_texts(part, words, find)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 500), ids], names=["key", "ids"])

    schema = T.StructType([T.StructField("key", key_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(encode, schema).select(F.col("key").alias(key), "ids")
