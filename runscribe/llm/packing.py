"""Packing tokens into fixed windows with minimum bin slack.

Documents are cut at multiples of the window; what is left of each is one piece.  Pieces matter to the
plan by their length alone, so the whole corpus enters as one histogram of at most ``window`` counts.
The plan fills a window with the longest piece left and the multiset of other lengths, found by a
subset-sum bitset over the remaining counts, that comes closest to capacity; it repeats that filling as
often as the counts allow.  A plan has at most about as many fillings as there are lengths, whatever the
corpus holds, so it is small enough to hand to every task.

Pieces then find their place by rank: the n-th piece of a length goes to the n-th slot of that length.
Ranks come from a window over (length, salt) with as many salts as the length's count asks for, so a length
that a third of all pieces share is dealt over tasks of a fair share of all pieces, at most about ROWS_PER_TASK.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .token_arrays import chunk_tokens
from .token_counts import slices
from .workspace import stage


#: Pieces of one length that are ranked in one task.
ROWS_PER_TASK = 500_000


def fullest_filling(counts: dict[int, int], lengths: list[int], capacity: int, slack_for_power: int) -> dict[int, int]:
    """The multiset {length: count} of one window: the longest length, and what comes closest to capacity with it.

    ``lengths`` ascends and holds the keys of ``counts``.  Where more than ``slack_for_power`` tokens would
    be padded and a power of two of at least a quarter of the capacity can be met exactly, that is taken,
    because such windows need no padding.
    """
    longest = lengths[-1]
    room = capacity - longest
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for i in range(bisect_left(lengths, room + 1) - 1, -1, -1):
        length = lengths[i]
        n, k = min(counts[length] - (length == longest), room // length), 1
        while n > 0:
            t = min(k, n)
            steps.append((length, t, reach))
            reach |= (reach << (length * t)) & mask
            n, k = n - t, k * 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    if room - best > slack_for_power:
        power = 1 << (capacity.bit_length() - 1)
        while power >= max(longest, capacity // 4):
            if power < capacity and reach >> (power - longest) & 1:
                best = power - longest
                break
            power >>= 1
    used = {longest: 1}
    for length, t, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + t
            best -= length * t
    return used


def plan_windows(counts: dict[int, int], capacity: int, slack_for_power: int = 64) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: count}) fillings that use every piece of the histogram exactly once."""
    left = {k: v for k, v in counts.items() if v}
    lengths, plan = sorted(left), []
    while lengths:
        used = fullest_filling(left, lengths, capacity, slack_for_power)
        times = min(left[k] // n for k, n in used.items())
        plan.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
                del lengths[bisect_left(lengths, k)]
    return plan


def cut_tokens(docs: DataFrame, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """doc_id, doc_tokens, start, length, ids_crc32 of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = chunk_tokens(vocabulary), int(end_id).to_bytes(4, "little")
        for batch in batches:
            texts, row, start, length, crc, total = batch.column("text").to_pylist(), [], [], [], [], []
            for a, b in slices(texts):
                for i, ids in enumerate(tokens.encode(texts[a:b]), a):
                    ids += end
                    n = len(ids) // 4
                    for s in range(0, n, window):
                        piece = ids[s * 4 : (s + window) * 4]
                        row.append(i)
                        start.append(s)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
            cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (total, start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "doc_tokens", "start", "length", "ids_crc32"])
        tokens.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, doc_tokens long, start long, length long, ids_crc32 long")


def place(ranked: DataFrame, plan: list[tuple[int, dict[int, int]]]) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a length and a rank from 0 within it."""
    next_rank: dict[int, int] = {}
    slots, sequence = [], 0
    for times, used in plan:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            first = next_rank.get(length, 0)
            slots.append((length, first, n, sequence, offset))
            next_rank[length] = first + n * times
            offset += length * n
        sequence += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)  # a few numbers for each length of each filling
    names = [f.name for f in ranked.schema.fields if f.name != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] << np.int64(44) | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << np.int64(44) | rank, "right") - 1
            behind = rank - table[at, 1]
            where = [pa.array(table[at, 3] + behind // table[at, 2]), pa.array(table[at, 4] + behind % table[at, 2] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *where], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece of each document.

    Offsets run from 0 without gaps in each sequence; no sequence exceeds ``window`` tokens.  Null and empty
    texts are the end id alone, so every row has at least one piece; repeated rows are packed as often as
    they occur; pieces of equal length are interchangeable and ranked by salt and (doc_id, start), nulls first; an
    empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    pieces = stage(cut_tokens(docs, vocabulary, window, end_id).withColumn("draw", F.xxhash64("doc_id", "start")), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    fair = max(1, min(rows_per_task, sum(histogram.values()) // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = spark.createDataFrame([(k, -(-n // fair)) for k, n in histogram.items()], "length long, salts long")  # at most `window` rows: broadcast, so that no length is dealt to one task
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod("draw", F.col("salts")))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("salt"))  # one row a task
    before = counts.select("length", "salt", (upto - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("within") - 1).alias("rank"))
    return place(ranked, plan_windows(histogram, window))
