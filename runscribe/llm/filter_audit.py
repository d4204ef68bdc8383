"""How five quality filters interact, whatever order they run in.

Which filters a text fails is a number of five bits.  A table made once says for each of the 32 numbers and each of the
120 orders at which step such a text goes.  Tasks look rows up in it and count removals by part, label, order and step
with ``np.bincount``; a task hands on its sums, and sums of tasks are added up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import stage

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Parts whose sums a task holds before it hands them on; one takes 23 kB.
HELD_PARTS = 500
#: Rows looked up at once: 120 numbers each.
ROWS = 4096
STEPS = len(FILTERS) + 1
WIDE = 1 << len(FILTERS)
SUMS = [f"n{i}" for i in range(WIDE)]
_SIGNS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))


def first_failures() -> np.ndarray:
    """For each set of failed filters (bit i: the i-th letter) and order, the step that removes such a text, from 0; 5 if none does."""
    table = np.full((WIDE, len(ORDERS)), len(FILTERS), np.int64)
    for failed in range(len(table)):
        for o, order in enumerate(ORDERS):
            for step, letter in enumerate(order):
                if failed >> FILTERS.index(letter) & 1:
                    table[failed, o] = step
                    break
    return table


def own_failures(body: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails; ``bytes.split`` cuts words at exactly space and \\t..\\r."""
    words = body.split()
    n = len(words)
    capitals = len(body) - len(body.translate(None, _CAPITALS))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 2 * n_chars) << 2 | (_SIGNS.search(body) is not None) << 3


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed: a row of ``docs`` (doc_id, text, source) each, with the bits of all filters that it fails.

    Only ids and 128-bit digests of texts are shuffled.  The first row of a text is found by (digest, doc_id), which no
    number of copies makes a hot key: whatever meets no first row is a copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            chars = pc.utf8_length(texts).to_numpy()
            failed, digests = [], []
            for i in range(batch.num_rows):  # one text at a time as a Python object
                body = texts[i].as_buffer().to_pybytes()
                failed.append(own_failures(body, int(chars[i])))
                digests.append(hashlib.md5(body, usedforsecurity=False).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "failed", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, f"doc_id {kind}, part string, failed int, digest binary")
    own = stage(own, "audit-own")
    firsts = own.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return own.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed"))


def partial_sums(rows: DataFrame) -> DataFrame:
    """part, order_no, n0 .. n31 of ``rows`` (part, failed, label): a task's sums; label is 1 for good plus 2 for toxic.

    For an order: removals by label and step (0 to 4; 5: never removed), 24 numbers.  Order -1: rows by what they fail.
    """
    table = first_failures()
    order_at = np.arange(len(ORDERS)) * 4 * STEPS
    cells = len(ORDERS) * 4 * STEPS

    def handed_on(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, counts in sums.items():
            wide = np.zeros((len(ORDERS) + 1, WIDE), np.int64)
            wide[:-1, : 4 * STEPS] = counts[:cells].reshape(len(ORDERS), -1)
            wide[-1] = counts[cells:]
            numbers = np.r_[np.arange(len(ORDERS)), -1].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(wide), pa.string()), pa.array(numbers), *map(pa.array, wide.T)], ["part", "order_no", *SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                parts = rows.column("part").dictionary_encode()
                place, failed, label = parts.indices.to_numpy(), rows.column("failed").to_numpy(), rows.column("label").to_numpy()
                by_part = np.argsort(place, kind="stable")
                ends = np.cumsum(np.bincount(place, minlength=len(parts.dictionary)))
                for part, mine in zip(parts.dictionary.to_pylist(), np.split(by_part, ends[:-1]), strict=True):
                    steps = table[failed[mine]] + order_at + (label[mine] * STEPS)[:, None]
                    counts = sums.setdefault(part, np.zeros(cells + WIDE, np.int64))
                    counts[:cells] += np.bincount(steps.ravel(), minlength=cells)
                    counts[cells:] += np.bincount(failed[mine], minlength=WIDE)
                    if len(sums) > HELD_PARTS:
                        yield from handed_on(sums)
                        sums.clear()
        yield from handed_on(sums)

    return rows.select("part", "failed", "label").mapInArrow(run, "part string, order_no int, " + ", ".join(f"{n} long" for n in SUMS))


def report(part: str, by_order: np.ndarray, by_failed: np.ndarray) -> pd.DataFrame:
    """The 600 rows of a part from its sums: 120 x 24 by order, 32 by failed filters."""
    removals = by_order.reshape(len(ORDERS), 2, 2, STEPS)  # order, toxic, good, step
    removed, good, toxic = removals.sum(axis=(1, 2)), removals[:, :, 1].sum(axis=1), removals[:, 1].sum(axis=1)
    letter = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    fails = np.array([by_failed[np.arange(WIDE) >> f & 1 == 1].sum() for f in range(len(FILTERS))])
    alone = by_failed[1 << np.arange(len(FILTERS))]
    here = removed[:, :-1]
    shapley = np.array([here[letter == f].sum() for f in range(len(FILTERS))])
    return pd.DataFrame(
        {
            "part": part,
            "filter_order": np.repeat(ORDERS, len(FILTERS)),
            "step": np.tile(np.arange(1, STEPS, dtype=np.int32), len(ORDERS)),
            "kept": (by_failed.sum() - here.cumsum(axis=1)).ravel(),
            "removed": here.ravel(),
            "redundant": (fails[letter] - here).ravel(),
            "unique_fails": alone[letter].ravel(),
            "good_lost": good[:, :-1].ravel(),
            "toxic_lost": toxic[:, :-1].ravel(),
            "shapley": shapley[letter].ravel(),
        }
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic.  A null text is empty; a null source is the part ''.
    A row without doc_id is no copy and has no copies, as it is neither smaller nor larger; rows that repeat a doc_id
    count each, and a text's first doc_id is no copy in any of its rows.  A doc_id with several labels is good or
    toxic if one of them says so; without labels it is neither.  An empty table gives no rows; extra columns are ignored.
    """
    held = [F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")]
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*held)
    marks = marks.select("doc_id", (F.coalesce("quality", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))).alias("label"))
    rows = failures(docs).join(marks, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    sums = partial_sums(rows).groupBy("part", "order_no").agg(*[F.sum(n).alias(n) for n in SUMS])

    def run(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order_no")  # 121 rows a part, whatever the table's size
        counts = rows[SUMS].to_numpy()
        return report(key[0], counts[1:, : 4 * STEPS], counts[0])

    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return sums.groupBy("part").applyInPandas(run, f"part string, filter_order string, step int, {longs}")
