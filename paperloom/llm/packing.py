"""Filling contexts of a fixed number of tokens with contents.

Method: cost-balanced packing. A content of length n costs ``n + n * n / C`` in a
context (linear work plus quadratic attention, scaled by the capacity C). The
contents of a block are taken in descending length and each goes to the context
of lowest cost among those with enough room. As many contexts are opened as the
total length needs; one more is opened only when none has room.

A block is a stretch of some 10,000 rows of a task's own input, so the operator
needs no shuffle, holds one block at a time and knows no hot key; every task and
block leaves at most a few partly filled contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
BLOCK_ROWS = 10_000


def text_tokens(text: Column) -> Column:
    """Token estimate of a text without a count: a token per four UTF-8 bytes.

    At least 1 for a text that is not empty; null and empty texts count 0. The
    README has the measured error of this estimate on the rows that have counts.
    """
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(4)).cast("int")


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Context number of each size (all at most ``capacity``), by the method above."""
    home = np.zeros(len(sizes), dtype=np.int64)
    if not len(sizes):
        return home
    opened = max(1, -(-int(sizes.sum()) // capacity))
    room = np.full(opened + len(sizes), -1, dtype=np.int64)
    room[:opened] = capacity
    cost = np.zeros(len(room))
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fits = np.flatnonzero(room[:opened] >= size)
        if len(fits):
            k = fits[cost[fits].argmin()]
        else:
            k, opened = opened, opened + 1
            room[k] = capacity
        home[i] = k
        room[k] -= size
        cost[k] += size + size * size / capacity
    return home


def pack(df: DataFrame, key: str, tokens: Column, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The context of each content: ``key``, part_no, part_tokens, context_id.

    One row per input row (part_no 1); a content over the capacity is split into
    full contexts, each a row of its own, and a rest that is packed like any
    other content. Null, negative and zero counts take no room but get a
    context. Repeated rows are packed each. context_id is unique over the whole
    result and is made of the task's partition, block and context number.
    """
    rows = df.select(F.col(key).alias("key"), F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)).alias("tokens"))
    key_type = rows.schema["key"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block_rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for block_no, block in enumerate(blocks(batches)):
            sizes = block.column("tokens").to_numpy()
            full = np.where(sizes > capacity, (sizes - 1) // capacity, 0)
            rest = sizes - full * capacity
            home = assign(rest, capacity)
            taken = int(home.max()) + 1 if len(home) else 0
            at = np.repeat(np.arange(len(sizes)), full + 1)
            first = np.cumsum(full + 1) - (full + 1)
            part = np.arange(len(at)) - first[at]
            last = part == full[at]
            context = np.where(last, home[at], 0)
            context[~last] = taken + np.arange(int((~last).sum()))
            names = [f"{task}-{block_no}-{c}" for c in context.tolist()]
            yield pa.RecordBatch.from_arrays(
                [block.column("key").combine_chunks().take(pa.array(at)), pa.array((part + 1).astype(np.int32)), pa.array(np.where(last, rest[at], capacity).astype(np.int64)), pa.array(names, pa.string())],
                names=["key", "part_no", "part_tokens", "context_id"],
            )

    out = rows.mapInArrow(fill, f"key {key_type}, part_no int, part_tokens long, context_id string")
    return out.withColumnRenamed("key", key)


def content_tokens() -> Column:
    """Size of a serving content: its count, or by its text where the count is missing or 0."""
    count = F.col("token_count")
    return F.when(count > 0, count).otherwise(text_tokens(F.col("content")))


def pack_contents(contents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Contexts of tb_document_contents."""
    return pack(contents, "id", content_tokens(), capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per decile of use: contexts, tokens held and unused (capacity is the whole)."""
    used = packed.groupBy("context_id").agg(F.sum("part_tokens").alias("used"), F.count("*").alias("parts"))
    tenth = F.least(F.floor(F.col("used") * 10 / capacity), F.lit(10)).cast("int").alias("tenth")
    return used.groupBy(tenth).agg(F.count("*").alias("contexts"), F.sum("used").alias("tokens"), F.sum(F.lit(capacity) - F.col("used")).alias("unused"), F.sum("parts").alias("parts"))
