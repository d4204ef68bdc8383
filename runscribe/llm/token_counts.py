"""Token counts by rank-synchronous array merging (see :mod:`.token_arrays`)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .token_arrays import chunk_tokens

#: Texts of a record batch are handled in slices of at most about so many characters.
SLICE_CHARS = 2_000_000


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``most`` characters; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document.

    ``vocabulary``: a tokenizer file (byte-level or word BPE, ``.json``) that exists on every executor.
    Counts are those of the library for that file without added tokens; special strings inside texts count
    as one token, as is its default.  Null and empty texts have 0 bytes and 0 tokens; rows are independent,
    so repeated rows repeat their counts; extra columns are ignored.  One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chunk_tokens(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts: list[int] = []
            for a, b in slices(texts):
                counts += [len(x) // 4 for x in tokens.encode(texts[a:b])]
            n = pa.array(counts, pa.int64())
            size = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            over = pa.array([c > limit for c in counts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        tokens.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
