"""Substring dedup with a compressed FM-index per shard.

A window is ``window`` consecutive words of a document; it is a repeat if a document with a smaller doc_id has
it too.  An index of everything that every document is streamed against would meet each document with each
shard, so candidates are routed first, by narrow rows of hashes: each window has an anchor, its smallest
12-gram, and consecutive windows with one anchor are a run.  Anchors that one document alone has end there.
Runs that are equal in several documents name the smallest of them as their source; the windows of other runs
with a shared anchor, wherever they stand in their document, are compared one by one in the same way.  All of these are sums by hash, combined before
the shuffle, so a passage that a third of all documents hold costs each task one row.

Then texts move, those of documents with candidates only.  Stretches whose windows name one source become
queries to the shard that indexes the source; equal stretches are one query; a source with many queries is
indexed in several shards that share them.  A shard builds the FM-index of its sources and streams its queries
by backward search over the wavelet matrix; the intervals of matching statistics above the threshold, found in
the words themselves and not in hashes, are what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex, long_matches
from .words import gram_hashes, prefix_sums, run_hashes, signed, sliding_min, word_hashes, words_of
from .workspace import stage

GRAM = 12
#: Windows of a document that are anchored at a time; positions take 20 bits of a key.
STRIDE = 1 << 19
#: Words of queries to one source in one shard.
SHARD_WORDS = 200_000
#: Characters of documents with candidates for each shard.
SHARD_CHARS = 4_000_000


def window_runs(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor hash) of the runs of window starts that share an anchor; they follow each other."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    gram = min(GRAM, window)
    grams = gram_hashes(hashes, gram)
    width = window - gram + 1
    first, last, anchor = [], [], []
    for s in range(0, n, STRIDE):
        part = grams[s : min(s + STRIDE, n) + width - 1]
        key = (part & ~np.uint64(0xFFFFF)) | np.arange(len(part), dtype=np.uint64)
        place = (sliding_min(key, width) & np.uint64(0xFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        first.append(starts + s)
        last.append(np.r_[starts[1:], len(place)] - 1 + s)
        anchor.append(part[place[starts]])
    return np.concatenate(first), np.concatenate(last), np.concatenate(anchor)


def survey(docs: DataFrame, window: int) -> DataFrame:
    """One row a run (doc_id, text_key, first, last, anchor, run), and one a document (with n_words and its digest)."""
    names = ["doc_id", "text_key", "first", "last", "anchor", "run", "n_words", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            row, of, keys, parts, counts, digests = [], [], [], [], [], []
            for i, (text, doc_id) in enumerate(zip(texts, ids, strict=True)):
                words = words_of(text)
                joined = b" ".join(words)
                keys.append(xxhash.xxh3_64_intdigest(joined))
                counts.append(len(words))
                digests.append(hashlib.sha256(joined).hexdigest())
                if doc_id is None or len(words) < window:
                    continue
                h = word_hashes(words)
                first, last, anchor = window_runs(h, window)
                parts.append((first, last, anchor, run_hashes(prefix_sums(h), first, last + window)))
                of.append(np.full(len(first), i))
            row = np.concatenate([np.arange(len(texts)), *of]).astype(np.int64)
            extra = len(row) - len(texts)
            key = np.array(keys, np.uint64)[row] if len(row) else np.empty(0, np.uint64)
            cols = [np.concatenate([np.zeros(len(texts), np.int64), *(signed(p[k]) if p[k].dtype == np.uint64 else p[k] for p in parts)]) for k in range(4)]
            is_doc = np.arange(len(row)) < len(texts)
            arrays = [
                batch.column("doc_id").take(pa.array(row)),
                pa.array(signed(key)),
                *(pa.array(c, mask=is_doc) for c in cols),
                pa.array([*counts, *[None] * extra], pa.int64()),
                pa.array([*digests, *[None] * extra], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_key long, first long, last long, anchor long, run long, n_words long, digest string")


def window_hashes(open_runs: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, at, word_hash of each window of the runs."""
    spans = open_runs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    met = spans.join(texts, ["doc_id", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, spans_of) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                at = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans_of])
                hashes = run_hashes(prefix_sums(word_hashes(words_of(text))), at, at + window)
                one = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(one), batch.column("text_key").take(one), pa.array(at), pa.array(signed(hashes))], ["doc_id", "text_key", "at", "word_hash"])

    return met.mapInArrow(run, "doc_id long, text_key long, at long, word_hash long")


def stretches(claims: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, at, n, source, q1, q2, words: stretches of a document whose windows all claim one source."""
    per_doc = claims.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last", "source")).alias("claims"))
    met = per_doc.join(texts, ["doc_id", "text_key"])
    names = ["doc_id", "text_key", "at", "n", "source", "q1", "q2", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, n, source, q1, q2, out = [], [], [], [], [], [], []
            for i, (text, claims_of) in enumerate(zip(batch.column("text").to_pylist(), batch.column("claims").to_pylist(), strict=True)):
                words, merged = words_of(text), []
                for first, last, src in sorted((c["first"], c["last"], c["source"]) for c in claims_of):
                    if merged and merged[-1][2] == src and first <= merged[-1][1] + 1:
                        merged[-1][1] = max(last, merged[-1][1])
                    else:
                        merged.append([first, last, src])
                for first, last, src in merged:
                    body = b" ".join(words[first : last + window])
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(body), np.int64).tolist()
                    row.append(i), at.append(first), n.append(last - first + window), source.append(src), q1.append(a), q2.append(b), out.append(body)
            take = pa.array(row, pa.int64())
            cols = [pa.array(x, pa.int64()) for x in (at, n, source, q1, q2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_key").take(take), *cols, pa.array(out, pa.binary())], names)

    return met.mapInArrow(run, "doc_id long, text_key long, at long, n long, source long, q1 long, q2 long, words binary")


def search_shards(queries: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """(shard, source, q1, q2, words) against (shard, source, text) -> source, q1, q2, spans found in the shard."""
    schema = pa.schema([("source", pa.int64()), ("q1", pa.int64()), ("q2", pa.int64()), ("spans", pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())])))])

    def run(asked: pa.Table, indexed: pa.Table) -> pa.Table:
        rows = []
        if len(asked) and len(indexed):
            index = FMIndex([words_of(t) for t in indexed.column("text").to_pylist()])
            found: list[list[dict]] = [[] for _ in range(len(asked))]
            for q, b, e in long_matches(index, [index.encode(w.split()) for w in asked.column("words").to_pylist()], window):
                found[q].append({"b": b, "e": e})
            rows = [(*x, spans) for *x, spans in zip(*(asked.column(c).to_pylist() for c in ("source", "q1", "q2")), found, strict=True) if spans]
        return pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)}, schema=schema)

    return queries.groupBy("shard").cogroup(sources.groupBy("shard")).applyInArrow(run, "source long, q1 long, q2 long, spans array<struct<b:long,e:long>>")


def without_spans(removed: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, text_key, n_removed, kept_sha256, kept_text (words joined by one space) of documents with removals."""
    met = removed.join(texts, ["doc_id", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, digests, kept_texts = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    edge[s["b"]] += 1
                    edge[s["e"]] -= 1
                stays = (np.cumsum(edge)[:-1] == 0).tolist()
                kept = b" ".join(w for w, k in zip(words, stays, strict=True) if k)
                gone.append(len(words) - sum(stays))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode())
            cols = [batch.column("doc_id"), batch.column("text_key"), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n_removed", "kept_sha256", "kept_text"])

    return met.mapInArrow(run, "doc_id long, text_key long, n_removed long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of each document.

    A word goes if some window over it also starts in a document with a smaller doc_id; windows are judged on
    the input.  ``kept_text`` is null where nothing went.  Repeats within one document stay.  Null and blank
    texts have no words; texts shorter than a window keep everything; rows without doc_id neither lose words nor
    are a source; rows that repeat a doc_id are judged each for itself and lose nothing to each other; an empty
    table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stage(survey(own, window), "substring-runs")
    runs = rows.where("anchor IS NOT NULL").select("doc_id", "text_key", "first", "last", "anchor", "run")
    anchors = runs.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor", "low")
    shared = stage(runs.join(stage(anchors, "substring-anchors"), "anchor"), "substring-shared")
    equal = stage(shared.groupBy("run").agg(F.min("doc_id").alias("source")), "substring-equal")
    marked = stage(shared.join(equal, "run"), "substring-marked")
    resolved = marked.where("source < doc_id").select("doc_id", "text_key", "first", "last", "source")
    alone = marked.where("source = doc_id")
    undecided = alone.where("low < doc_id").select("anchor").distinct()
    open_runs = stage(alone.join(undecided, "anchor", "left_semi").dropDuplicates(["doc_id", "text_key", "first"]), "substring-open")
    involved = resolved.select("doc_id").union(resolved.select("source")).union(open_runs.select("doc_id")).distinct()
    texts = stage(keyed(own.join(involved, "doc_id", "left_semi")).dropDuplicates(["doc_id", "text_key"]), "substring-texts")
    windows = window_hashes(open_runs, texts, window)
    smallest = windows.groupBy("word_hash").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last_doc")).where("source < last_doc").select("word_hash", "source")
    single = windows.join(smallest, "word_hash").where("source < doc_id").select("doc_id", "text_key", F.col("at").alias("first"), F.col("at").alias("last"), "source")
    asked = stage(stretches(resolved.unionByName(single), texts, window), "substring-queries")
    distinct = asked.groupBy("source", "q1", "q2").agg(F.max("words").alias("words"), F.max("n").alias("n"))
    load = stage(distinct.groupBy("source").agg(F.ceil(F.sum("n") / SHARD_WORDS).cast("int").alias("salts")), "substring-load")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // SHARD_CHARS + 1)
    shard = F.pmod(F.xxhash64("source", "salt"), F.lit(shards))
    queries = distinct.join(load, "source").withColumn("salt", F.pmod("q1", F.col("salts")).cast("int")).withColumn("shard", shard).select("shard", "source", "q1", "q2", "words")
    salted = load.select("source", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).withColumn("shard", shard)
    sources = salted.join(texts.select(F.col("doc_id").alias("source"), "text"), "source").select("shard", "source", "text")
    verified = stage(search_shards(queries, sources, window), "substring-verified")
    spans = asked.join(verified, ["source", "q1", "q2"]).select(
        "doc_id", "text_key", F.transform("spans", lambda s: F.struct((s["b"] + F.col("at")).alias("b"), (s["e"] + F.col("at")).alias("e"))).alias("spans")
    )
    removed = spans.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    changed = without_spans(removed, texts)
    every = rows.where("digest IS NOT NULL").select("doc_id", "text_key", "n_words", "digest")
    return every.join(changed, ["doc_id", "text_key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "digest").alias("kept_sha256"), "kept_text"
    )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text; the key is a hash of the words, as in :func:`survey`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([xxhash.xxh3_64_intdigest(b" ".join(words_of(t))) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed(keys)), batch.column("text")], ["doc_id", "text_key", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_key long, text string")
