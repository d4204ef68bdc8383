"""Spelling variants by an even-partition pigeonhole join.

A word of length l is cut into two segments, of l // 2 code points and the rest, and indexed under (l, segment
number, segment).  One edit leaves a segment whole, so a near word of equal length has one of the segments at its own
place, and one that is a code point longer has the first at its start or the second at its end, shifted by one.
Probes meet the index by equality; candidates that came both ways are met once and verified.

A segment that many words share ("tion" of eight letters) would pair all of them.  Where a segment holds more than
``CROWD`` words, the rest of the word is cut again: equal lengths meet on the rest with one code point left out, which
at most as many words share as there are letters; a longer word gives its rest with one code point left out to be met
whole.  So a word meets at most ``CROWD`` words a segment or as many as there are letters a place, at any size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words of a segment up to which its words are compared with each other one by one.
CROWD = 32
#: Distinct words that a task counts before it hands the counts on.
HELD = 200_000


def misspelt(doc_id: object, run: str) -> str:
    """``run``, without one code point if 199 divides the crc32 of ``<doc_id>:<run>``; a null doc_id is written as nothing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 199:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int) -> DataFrame:
    """word, n: distinct results of at least ``least_length`` code points with their occurrences in the whole table.

    The runs of a text are counted first, so a run is hashed once a document; a task hands on sums, not occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):  # one text at a time as a Python object
                text = texts[i].as_py()
                if text:
                    doc_id = ids[i].as_py()
                    for word, n in Counter(RUN.findall(text.translate(LOWER))).items():
                        if len(word) >= least_length and len(result := misspelt(doc_id, word)) >= least_length:
                            counts[result] += n
                    if len(counts) > HELD:
                        yield pa.RecordBatch.from_pydict({"word": pa.array(counts, pa.string()), "n": pa.array(counts.values(), pa.int64())})
                        counts.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(counts, pa.string()), "n": pa.array(counts.values(), pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _segments(word: str, length: str, shift: int) -> F.Column:
    """The two keys under which ``word`` is looked for among words of ``length``, each with what the segment leaves of the word.

    ``shift`` is 0 for words of that length and 1 for words that are a code point longer.
    """
    half = f"({length}) div 2"
    first = f"struct(({length}) AS length, 0 AS part, substr({word}, 1, {half}) AS segment, substr({word}, {half} + 1) AS rest)"
    second = f"struct(({length}) AS length, 1 AS part, substr({word}, {half} + 1 + {shift}) AS segment, substr({word}, 1, {half} + {shift}) AS rest)"
    return F.explode(F.expr(f"array({first}, {second})"))


def _one_left_out() -> F.Column:
    """Each place of ``rest`` and ``rest`` without the code point there."""
    return F.explode(F.expr("transform(sequence(1, length(rest)), p -> struct(p AS place, concat(substr(rest, 1, p - 1), substr(rest, p + 1)) AS left))"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b of each unordered pair of distinct words of ``words`` (one row a word) that differ by exactly one edit, once."""
    key = ["length", "part", "segment"]
    index = stage(words.select(F.col("word").alias("a"), _segments("word", "length(word)", 0).alias("k")).select("a", "k.*"), "spelling-index")
    longer = words.where("length(word) > 1").select(F.col("word").alias("b"), _segments("word", "length(word) - 1", 1).alias("k")).select("b", "k.*")
    sizes = stage(index.groupBy(*key).agg(F.count("*").alias("held")).where("held > 1"), "spelling-segments")
    crowded, quiet = sizes.where(F.col("held") > CROWD).select(*key), sizes.where(F.col("held") <= CROWD).select(*key)
    few = index.join(crowded, key, "left_anti")
    equal = index.join(quiet, key).select(*key, "a").join(index.select(*key, F.col("a").alias("b")), key).where("a < b")
    one_longer = longer.join(few, key)

    def places(rows: DataFrame, word: str) -> DataFrame:
        return rows.join(crowded, key, "left_semi").select(word, *key, _one_left_out().alias("o")).select(word, *key, "o.place", "o.left")

    cut = places(index, "a")
    crowded_equal = cut.join(cut.withColumnRenamed("a", "b"), [*key, "place", "left"]).where("a < b")
    crowded_longer = places(longer, "b").join(index.select("a", *key, F.col("rest").alias("left")), [*key, "left"])
    met = [df.select("a", "b") for df in (equal, one_longer, crowded_equal, crowded_longer)]
    candidates = met[0].unionByName(met[1]).unionByName(met[2]).unionByName(met[3]).distinct()
    return candidates.where(F.levenshtein("a", "b", 1) == 1)


def variant_groups(docs: DataFrame, least_length: int = 6, least_n: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``docs`` (doc_id, text).

    Words are runs of Latin letters, lower-cased in A-Z only, each document's runs thinned by ``misspelt``; kept with
    at least ``least_length`` code points and ``least_n`` occurrences.  A word's form is its near word with the largest n
    (ties: the smallest in code-point order) if that is at least ``times`` the word's n; the root is where following forms
    ends.  n grows by ``times`` at each step, so chains are short and following them twice as far a round ends soon.

    Null and empty texts have no words; a null doc_id is hashed as nothing; repeated rows count each time; an empty table
    gives no rows; extra columns are ignored.  A very long text is one row of a task, of which only its distinct words stay.
    """
    words = stage(word_counts(docs, least_length).where(F.col("n") >= least_n), "spelling-words")
    pairs = stage(near_pairs(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("best"))).alias("top"))
    top_n = -F.col("top.less")
    strong = top_n >= times * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("top.best")).alias("form"), F.when(strong, top_n).alias("form_n")
    )
    formed = stage(formed, "spelling-forms")
    ends = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = stage(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not ends.where("moved").head(1):
            break
        ends = ends.drop("moved")
    return formed.join(ends.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("form_n").cast("long").alias("form_n"))
