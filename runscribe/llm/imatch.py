"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon is the terms whose document frequency lies in a band (an inverse-document-frequency band).  A
band from ``least`` of all documents up holds at most (mean distinct terms a document) / least terms, however
large the corpus, so it can be handed to every task, and its bounds are the same at every size.  A fingerprint hashes a document's sorted distinct lexicon terms within each
of several random subsets of the lexicon; subsets are of different sizes, down to a share of 2**-20, and one
counts for a document if it holds one or two of its terms, so short and long documents have about as many
subsets of their own that an edit may spare.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, signed

TERM = re.compile(r"[^\W\d_]+")
#: Subset s takes a term with probability 2**-(1 + s % RATES); a document of a million lexicon terms still has subsets with one.
RATES = 20
SUBSETS = 8 * RATES
MOST_TERMS = 2
DIGITS = 6
#: Distinct terms of a task that are counted before rows go to the shuffle.
HELD_TERMS = 2_000_000
#: Text of a bucket of documents in doc_id order, and how many buckets there are at most (their bounds go to every task).
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 100_000


def terms_of(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's terms: runs of letters, in lower case."""
    if not text:
        return np.empty(0, np.uint64)
    words = set(TERM.findall(text.lower()))
    return np.sort(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term (hash), df over all documents; each task adds up its own documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if not waiting:
                return terms, counts
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            every, at = np.unique(np.concatenate([terms, new]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([counts, n]), len(every)).astype(np.int64)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                waiting.append(terms_of(text))
            if sum(map(len, waiting)) > HELD_TERMS:
                terms, counts = merged()
            if len(terms) > HELD_TERMS:
                yield pa.RecordBatch.from_arrays([pa.array(signed(terms)), pa.array(counts)], ["term", "df"])
                terms, counts = terms[:0], counts[:0]
        terms, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(signed(terms)), pa.array(counts)], ["term", "df"])

    return docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, n_docs: int, least: float, most: float) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    frequent = document_frequencies(docs).where((F.col("df") >= max(2, least * n_docs)) & (F.col("df") <= max(2, most * n_docs)))
    return np.sort(frequent.select("term").toArrow().column("term").to_numpy().view(np.uint64))


_SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64))
_SHIFT = np.array([64 - (1 + s % RATES) for s in range(SUBSETS)], np.uint64)
UNUSED = "-" * DIGITS
#: Terms whose subsets are drawn at a time.
DRAWN_TERMS = 1 << 13


def subset_draws(terms: np.ndarray) -> np.ndarray:
    """A row of SUBSETS bits a term: the subsets that take it."""
    parts = [np.packbits((mix(terms[s : s + DRAWN_TERMS, None] ^ _SEEDS) >> _SHIFT) == 0, axis=1) for s in range(0, len(terms), DRAWN_TERMS)]
    return np.concatenate(parts) if parts else np.empty((0, SUBSETS // 8), np.uint8)


def fingerprint(text: str | None, lex: np.ndarray, draws: np.ndarray | None = None) -> str:
    return fingerprint_of(terms_of(text), lex, draws)


def fingerprint_of(every: np.ndarray, lex: np.ndarray, draws: np.ndarray | None = None) -> str:
    """SUBSETS parts of DIGITS hex digits, UNUSED where a subset doesn't count, then a hash of all the terms.

    ``every``: the text's sorted distinct term hashes.  A text without a lexicon term has that last part alone, over
    all its terms; one without terms, of ``""``.  ``draws`` are the lexicon's subset_draws, if at hand.
    """
    at = np.minimum(np.searchsorted(lex, every), max(len(lex) - 1, 0))
    at = at[lex[at] == every] if len(lex) else at[:0]
    if not len(at):
        return xxhash.xxh3_64_hexdigest(every.tobytes())
    inside = lex[at]
    drawn = np.unpackbits(subset_draws(inside) if draws is None else draws[at], axis=1).view(bool)
    counts = np.count_nonzero(drawn, axis=0)
    parts = [UNUSED] * SUBSETS
    for s in np.flatnonzero((counts >= 1) & (counts <= MOST_TERMS)).tolist():
        parts[s] = xxhash.xxh3_64_hexdigest(inside[drawn[:, s]].tobytes())[:DIGITS]
    return "".join(parts) + xxhash.xxh3_64_hexdigest(inside.tobytes())


def likeness(a: str, b: str) -> float:
    """Share of the subsets counting for either document on which both agree; equal fingerprints are 1."""
    if a == b:
        return 1.0
    end = SUBSETS * DIGITS
    if len(a) <= end or len(b) <= end:
        return 0.0
    used = same = 0
    for i in range(0, end, DIGITS):
        x, y = a[i : i + DIGITS], b[i : i + DIGITS]
        if x != UNUSED or y != UNUSED:
            used += 1
            same += x == y
    return same / used if used else 0.0


def in_order(docs: DataFrame, buckets: int, null_buckets: int) -> DataFrame:
    """bucket, role, doc_id, packed (compressed text), sorted within partitions; buckets are ranges of doc_id.

    The first document of the next bucket also closes a bucket (role 1), the first of all the last (role 2),
    so each bucket is complete without any other.  The bounds are ids that occur.  Rows without doc_id are dealt
    by their text over buckets of their own, each opened by the first document of all (role -1).
    """
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    shares = [i / buckets for i in range(1, buckets)]
    row = ids.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", shares, max(10_000, 20 * buckets)).alias("cuts") if shares else F.lit(None).alias("cuts")).first()
    low, cuts = row["low"], sorted(set(row["cuts"] or []) - {row["low"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        starts, nulls = set(cuts), range(len(cuts) + 1, len(cuts) + 1 + null_buckets)
        for batch in batches:
            packed = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            at, bucket, role = [], [], []
            for i, d in enumerate(batch.column("doc_id").to_pylist()):
                places = [(bisect_right(cuts, d), 0)] if d is not None else [(nulls[xxhash.xxh3_64_intdigest(packed[i]) % null_buckets], 0)]
                if d in starts:
                    places.append((places[0][0] - 1, 1))
                if d is not None and d == low:
                    places += [(len(cuts), 2), *((n, -1) for n in nulls)]
                for b, r in places:
                    at.append(i), bucket.append(b), role.append(r)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(role, pa.int32()), batch.column("doc_id").take(take), pa.array(packed, pa.binary()).take(take)], ["bucket", "role", "doc_id", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text").mapInArrow(run, f"bucket int, role int, doc_id {kind}, packed binary")
    return dealt.repartition(max(1, (buckets + null_buckets) // 2), "bucket").sortWithinPartitions("bucket", "role", F.col("doc_id").asc_nulls_last(), "packed")


def fingerprints(docs: DataFrame, least: float = 0.005, most: float = 0.3, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of an edited text, and how alike they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  The
    edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document in doc_id order (after the last, the first).  Null text is empty; a row without doc_id has no place in
    the order, and the first document counts as its next (itself, if no row has a doc_id); rows with equal doc_id
    follow each other in a fixed order; a single document is its own next; equal texts have equal fingerprints; an
    empty table gives no rows; extra columns are ignored.

    A bucket is a range of about BUCKET_BYTES of text, so what a task reads doesn't grow with the corpus.
    """
    spark = docs.sparkSession
    octets = F.octet_length("text")
    size = docs.agg(F.count("*").alias("n"), F.sum(octets).alias("all"), F.sum(F.when(F.col("doc_id").isNull(), octets)).alias("null"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    lex = lexicon(docs, size["n"], least, most)
    buckets = buckets or min(MOST_BUCKETS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (size["all"] or 0) // BUCKET_BYTES + 1))
    null_buckets = min(MOST_BUCKETS, 1 + (size["null"] or 0) // BUCKET_BYTES) if size["nulls"] else 0
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        draws = subset_draws(lex)

        def read(doc_id, packed):
            """doc_id, text, the terms of what no edit reaches, where that ends (at a blank, so no word is cut), and the fingerprint."""
            text = unpress.decompress(packed).decode()
            end = max(0, text.rfind(" ", 0, len(text) - len(text) // 4))
            spared = terms_of(text[:end])
            return doc_id, text, spared, end, fingerprint_of(np.union1d(spared, terms_of(text[end:])), lex, draws)

        def finish(this, following):
            (doc_id, text, spared, end, mark), (_, next_text, _, _, next_mark) = this, following
            cut = len(text) // 4
            changed = text[end : len(text) - cut] + next_text[:cut]
            edited = text[:end] + changed
            edited_mark = mark if edited == text else fingerprint_of(np.union1d(spared, terms_of(changed)), lex, draws)
            return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark))

        def rows():
            pending = first = at = None
            closed = False
            for batch in batches:
                for bucket, role, doc_id, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "role", "doc_id", "packed")), strict=True):
                    if bucket != at:
                        pending, first, at, closed = None, None, bucket, False
                    if closed or (role == -1 and first is not None):
                        continue
                    this = read(doc_id, packed)
                    if role == -1:
                        first = this
                    elif doc_id is None:
                        yield finish(this, first or this)
                    else:
                        if pending is not None:
                            yield finish(pending, this)
                        pending, closed = (None, True) if role else (this, False)

        out = []
        for r in rows():
            out.append(r)
            if len(out) == 500:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema)

    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(doc_type)), ("n_chars", pa.int64()), *((n, pa.string()) for n in names[2:5]), *((n, pa.float64()) for n in names[5:])])
    kinds = f"doc_id {doc_type.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, buckets, null_buckets).mapInArrow(run, kinds)
