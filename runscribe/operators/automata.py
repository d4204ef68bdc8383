"""Automata over the lines of a transcript as summaries that merge: no task needs a transcript's lines in order.

What a run of lines does is told for every state that it may begin in.  Summaries of neighbouring runs compose to that of
both, in any grouping, so lines fold within chunks, chunks within transcripts, and only chunks are ever ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import guarded, hits, lowered

#: Lines of a chunk: what a group gathers at most before it is folded.
CHUNK_LOG2 = 16
# What opens and closes a triple-quoted string; the states are outside (0), and inside of each (1, 2).
QUOTES = ['\"\"\"', "\'\'\'"]
_CLOSED = r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''"
_STRINGS = r"\"\"\"[\s\S]*?(?:\"\"\"|\z)|'''[\s\S]*?(?:'''|\z)"


def chunk_of(line_no: str = "line_no", log2: int | None = None) -> Column:
    return F.shiftright(F.col(line_no).cast("long"), CHUNK_LOG2 if log2 is None else log2)


def has_triple_quote(text: Column) -> Column:
    return text.contains(QUOTES[0]) | text.contains(QUOTES[1])


def _outside(text: Column) -> tuple[Column, Column]:
    """(state behind it, what shows of it) of a text that begins outside of a string."""
    left = F.regexp_replace(text, _CLOSED, "\x00")
    one, two = F.instr(left, QUOTES[0]), F.instr(left, QUOTES[1])
    return F.when((one > 0) & ((two == 0) | (one < two)), 1).when(two > 0, 2).otherwise(0), F.regexp_replace(text, _STRINGS, "")


def docstring_step(text: Column, low: Column) -> Column:
    """What a line does to docstrings and to the count of unfinished work outside of them: by state, the next state and the count.

    Null for the many lines that change no state and count nothing.
    """
    ends, counts = [], []
    for state in range(3):
        rest = text if state == 0 else F.substr(text, F.instr(text, QUOTES[state - 1]) + 3)
        end, shown = _outside(rest)
        n = hits(shown, "incomplete")
        closes = F.lit(True) if state == 0 else text.contains(QUOTES[state - 1])
        ends.append(F.when(closes, end).otherwise(state))
        counts.append(F.when(closes, n).otherwise(0).cast("long"))
    n = hits(text, "incomplete", low)
    plain = F.struct(F.array(F.lit(0), F.lit(1), F.lit(2)).alias("ends"), F.array(n.cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("counts"))
    return F.when(has_triple_quote(text), F.struct(F.array(*ends).alias("ends"), F.array(*counts).alias("counts"))).when(n > 0, plain)


def composed(steps: Column) -> Column:
    """One step of an ordered array of steps; that of no steps changes nothing."""
    start = F.expr("named_struct('ends', array(0, 1, 2), 'counts', array(0L, 0L, 0L))")
    return F.reduce(
        steps,
        start,
        lambda a, x: F.struct(
            F.transform(a["ends"], lambda s: F.get(x["ends"], s)).alias("ends"),
            F.zip_with(a["counts"], a["ends"], lambda c, s: c + F.get(x["counts"], s)).alias("counts"),
        ),
    )


def first_distinct(found: Column, most: int, same: list[str]) -> Column:
    """The first ``most`` of an ordered array of structs that differ in ``same``; of two neighbouring arrays' firsts, one after the other, the firsts of both."""

    def add(kept: Column, x: Column) -> Column:
        known = F.exists(kept, lambda k: F.forall(F.array(*[k[c].eqNullSafe(x[c]) for c in same]), lambda b: b))
        return F.when((F.size(kept) >= most) | known, kept).otherwise(F.concat(kept, F.array(x)))

    return F.reduce(found, F.slice(found, 1, 0), add)


def unfinished(lines: DataFrame, log2: int | None = None) -> DataFrame:
    """transcript_id, n_incomplete, quoted: unfinished work outside of triple-quoted strings, of transcripts that may have either."""
    text, low = F.col("text"), lowered(F.col("text"))
    told = lines.where(has_triple_quote(text) | guarded("incomplete", low)).select("transcript_id", "line_no", docstring_step(text, low).alias("step"), has_triple_quote(text).alias("quoted"))
    inner = F.transform(F.sort_array(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("line_no", "step")))), lambda x: x["step"])
    chunks = told.groupBy("transcript_id", chunk_of(log2=log2).alias("chunk")).agg(composed(inner).alias("step"), F.max("quoted").alias("quoted"))
    outer = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "step"))), lambda x: x["step"])
    return chunks.groupBy("transcript_id").agg(composed(outer)["counts"][0].alias("n_incomplete"), F.max("quoted").alias("quoted"))
