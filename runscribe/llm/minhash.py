"""MinHash near-dedup with b-bit signatures.

Each document's set of word shingles gives 256 minima.  Bands of five full minima find candidates; the two
low bits of each minimum are packed into eight longs, and the bit counts of two packed signatures, corrected
for the quarter of minima that agree by chance, estimate the similarity; candidates far below the threshold
go.  What is left is confirmed on the full sets, so a link is never an estimate.

Groups.  Equal sets are one node from the start.  A bucket of a band is never expanded into its pairs: each
member is compared with the bucket's two leaders, which links a group of copies at once.  What shares a bucket
that then still holds several components is one group; its members meet in blocks within tasks, where packed
bits choose and full sets decide, and a task returns no more links than it has members.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .words import gram_hashes, mix, prefix_sums, run_hashes, signed, word_hashes
from .workspace import set_aside, stage

MINIMA, BAND_ROWS, LOW_BITS = 256, 5, 2
BANDS = MINIMA // BAND_ROWS
#: A pair whose estimate is below threshold - MARGIN is dropped; five standard errors of 256 minima at 0.75.
MARGIN = 0.18
BLOCK = 1024

_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, MINIMA, np.uint64)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, A-Z in lower case; fewer words are one shingle."""
    w = text.encode().lower().split() if text else []
    h = word_hashes(w)
    if len(h) >= words:
        return np.unique(gram_hashes(h, words))
    return run_hashes(prefix_sums(h), np.array([0]), np.array([len(h)])) if len(h) else np.empty(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of MINIMA hash functions over a set that isn't empty."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        out = np.minimum(out, (shingles[i : i + 512, None] * _FACTORS + _ADDENDS).min(axis=0))
    return out


def band_keys(lowest: np.ndarray) -> np.ndarray:
    rows = lowest[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BAND_ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key


def packed(lowest: np.ndarray) -> np.ndarray:
    """The low bits of the minima (mixed, as a product's own low bits depend on its input's alone), in longs."""
    bits = (mix(lowest) & np.uint64(3)).reshape(-1, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(LOW_BITS))).sum(axis=1, dtype=np.uint64)


def corrected(agreeing: Column) -> Column:
    """Similarity from the number of agreeing low bits: a share 2**-b agrees by chance."""
    chance = 0.5**LOW_BITS
    return (agreeing / F.lit(float(MINIMA)) - F.lit(chance)) / F.lit(1 - chance)


def estimated(a: Column, b: Column) -> Column:
    def agreeing(x, y):
        differ = x.bitwiseXOR(y)
        return F.bit_count(F.bitwise_not(differ.bitwiseOR(F.shiftrightunsigned(differ, 1))).bitwiseAND(F.lit(0x5555555555555555)))

    return corrected(F.aggregate(F.zip_with(a, b, agreeing), F.lit(0), lambda n, x: n + x.cast("int")))


def parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``most`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (hash of the set), keys (of the bands), low (packed bits) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: OrderedDict[bytes, tuple] = OrderedDict()
        for batch in parts(batches, 2000):
            rows = []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, words)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if (row := last.get(digest)) is None:
                    if len(s):
                        m = minima(s)
                        row = (len(s), *np.frombuffer(digest, np.int64).tolist(), signed(band_keys(m)), signed(packed(m)))
                    else:
                        row = (0, 0, 0, None, None)
                    last[digest] = row
                    if len(last) > 2000:
                        last.popitem(last=False)
                rows.append(row)
            n, d1, d2, keys, low = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            cols = [pa.array(list(x), t) for x, t in zip((n, d1, d2, keys, low), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_shingles", "d1", "d2", "keys", "low"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, low array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """The pairs (a, b) of documents whose full sets are similar enough; texts (sid, text) meet by two joins."""
    share = round(threshold * 100)
    ta, tb = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    met = pairs.join(ta, "a").join(tb, "b").select("a", "b", "hash_a", "hash_b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: OrderedDict[int, tuple] = OrderedDict()

        def set_of(text):
            key = hash(text)
            if (got := last.get(key)) is None or got[0] != text:
                s = shingle_set(text, words)
                got = last[key] = (text, s, int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0]))
                if len(last) > 64:
                    last.popitem(last=False)
            return got[1:]

        for batch in parts(batches, 500):
            keep = []
            for i, (ha, hb, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hash_a", "hash_b", "text_a", "text_b")), strict=True)):
                (sa, da), (sb, db) = set_of(x), set_of(y)
                if da == ha and db == hb:  # another row with the same doc_id may hold another text
                    both = len(np.intersect1d(sa, sb, assume_unique=True))
                    if 100 * both >= share * (len(sa) + len(sb) - both):
                        keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def links_across(rows: DataFrame, threshold: float, words: int) -> DataFrame:
    """(group, block_a, block_b, side, sid, comp, hash, low, text) -> (a, b): links between components of a group.

    A task has one block of a group, or two.  The packed bits choose which members could be linked; the sizes
    of their intersections come from an inverted list of the task's shingles, so every pair of the blocks
    across components is decided on full sets.  Of the links those are returned that join what isn't yet
    joined, fewer than a block has members.
    """
    share, least = round(threshold * 100), threshold - MARGIN
    mask = np.uint64(0x5555555555555555)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        texts, hashes = table.column("text").to_pylist(), table.column("hash").to_pylist()
        sets = [shingle_set(t, words) for t in texts]
        good = [int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0]) == h for s, h in zip(sets, hashes, strict=True)]
        table, sets = table.filter(pa.array(good)), [s for s, g in zip(sets, good, strict=True) if g]
        sid, comp, side = (table.column(c).to_numpy() for c in ("sid", "comp", "side"))
        low = np.array(table.column("low").to_pylist(), np.int64).view(np.uint64).reshape(len(sid), -1)
        size = np.array([len(s) for s in sets], np.int64)
        one_block = key[1].as_py() == key[2].as_py()
        left = np.arange(len(sid)) if one_block else np.flatnonzero(side == 0)
        right = left if one_block else np.flatnonzero(side == 1)
        joined = {int(c): int(c) for c in comp}

        def root(c: int) -> int:
            while joined[c] != c:
                joined[c] = c = joined[joined[c]]
            return c

        a, b = [], []
        if len(left) and len(right):
            owner = np.repeat(np.arange(len(right)), size[right])
            flat = np.concatenate([sets[r] for r in right])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i in left.tolist():
                differ = low[right] ^ low[i]
                agree = np.bitwise_count(~(differ | (differ >> np.uint64(1))) & mask).sum(axis=1)
                likely = ((agree / MINIMA - 0.25) / 0.75 >= least) & (comp[right] != comp[i])
                if one_block:
                    likely &= sid[right] > sid[i]
                if not likely.any():
                    continue
                begin, end = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                n = end - begin
                at = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(right))
                linked = likely & (100 * both >= share * (size[i] + size[right] - both))
                for r in right[np.flatnonzero(linked)].tolist():
                    x, y = root(int(comp[i])), root(int(comp[r]))
                    if x != y:
                        joined[max(x, y)] = min(x, y)
                        a.append(int(sid[i])), b.append(int(sid[r]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("group", "block_a", "block_b").applyInArrow(run, "a long, b long")


def link_sets(docs: DataFrame, sets: DataFrame, threshold: float, words: int) -> DataFrame:
    """(node, component) over the representatives ``sets`` (sid, n, hash, keys, low), by confirmed links."""
    bands = sets.select("sid", F.explode("keys").alias("key"))
    order = F.xxhash64("sid")
    buckets = bands.groupBy("key").agg(F.count("*").alias("members"), F.min("sid").alias("first"), F.min_by("sid", order).alias("second")).where("members > 1")
    shared = stage(bands.join(stage(buckets, "minhash-keys"), "key"), "minhash-buckets")
    low = sets.select("sid", "n", "hash", "low")
    facts_a, facts_b = low.toDF("a", "n_a", "hash_a", "low_a"), low.toDF("b", "n_b", "hash_b", "low_b")
    members = shared.select("sid").distinct().hint("merge")
    texts = stage(docs.select(F.col("doc_id").alias("sid"), "text").join(members, "sid", "left_semi"), "minhash-texts")

    to_leaders = shared.select(F.least("sid", "first").alias("a"), F.greatest("sid", "first").alias("b")).union(shared.select(F.least("sid", "second"), F.greatest("sid", "second")))
    met = to_leaders.where("a <> b").distinct().join(facts_a, "a").join(facts_b, "b")
    fits = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    likely = met.where(fits & (estimated(F.col("low_a"), F.col("low_b")) >= threshold - MARGIN)).select("a", "b", "hash_a", "hash_b")
    links = stage(confirmed(likely, texts, threshold, words), "minhash-links")
    comps = components(links)

    # what shares a bucket that still holds several components is one group, searched in blocks
    named = shared.where("members > 2").select("key", "first", "sid").join(comps.withColumnRenamed("node", "sid"), "sid", "left")
    named = named.withColumn("comp", F.coalesce("component", "sid")).drop("component")
    several = stage(named.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key"), "minhash-several")
    still = stage(named.join(several, "key").select("first", "sid", "comp").distinct(), "minhash-open")
    groups = components(still.select(F.col("first").alias("a"), F.col("sid").alias("b"))).toDF("sid", "group")
    placed = stage(still.select("sid", "comp").distinct().join(groups, "sid"), "minhash-groups")
    # the largest component of a group needs no search in itself: blocks of the rest meet each other and its blocks
    sizes = stage(placed.groupBy("group", "comp").agg(F.count("*").alias("n")), "minhash-sizes")
    plans = sizes.groupBy("group").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("in_main"), F.sum("n").alias("n"))
    plans = plans.select(
        "group", "main", F.ceil((F.col("n") - F.col("in_main")) / BLOCK).cast("int").alias("rest_blocks"), F.ceil(F.col("in_main") / BLOCK).cast("int").alias("main_blocks")
    )
    in_main, hashed = F.col("comp") == F.col("main"), F.xxhash64("sid")
    spread = placed.join(stage(plans, "minhash-blocks"), "group").withColumn(
        "own", F.when(in_main, F.col("rest_blocks") + F.pmod(hashed, F.col("main_blocks"))).otherwise(F.pmod(hashed, F.col("rest_blocks"))).cast("int")
    )
    others = F.col("rest_blocks") + F.when(in_main, 0).otherwise(F.col("main_blocks"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    spread = spread.select(
        "group", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "sid", "comp"
    )
    more = stage(links_across(spread.join(low.select("sid", "hash", "low"), "sid").join(texts, "sid"), threshold, words), "minhash-links")
    return comps if more.isEmpty() else components(links.union(more))


def near_duplicates(docs: DataFrame, threshold: float = 0.75, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document.

    Documents are linked if 100 * intersection >= 75 * union of their shingle sets (for 0.75); a component is
    named by its smallest doc_id, which is kept.  Documents without words have an empty set and are linked with
    nothing, so they are kept, as are rows without doc_id, whose component is null.  Rows that repeat a doc_id
    are one node with every row's links.  An empty table gives no rows; extra columns are ignored.

    A pair exactly at 0.75 escapes all 51 bands with probability (1 - 0.75**5)**51 = 1e-6, one at 0.8 with 2e-9, and
    the estimate, whose standard error there is 0.033 (256 two-bit minima), drops it with about 2e-8 (MARGIN).
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed_docs = stage(signatures(own, words), "minhash-signatures")
    full = signed_docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    smallest = stage(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("sid"), F.count("*").alias("copies")), "minhash-sets")
    heads = full.join(smallest, ["d1", "d2"]).where("doc_id = sid").select("sid", F.col("n_shingles").alias("n"), F.col("d1").alias("hash"), "keys", "low")
    sets = stage(heads.dropDuplicates(["sid", "hash"]), "minhash-heads")
    comps = link_sets(own, sets, threshold, words)
    member = full.select("doc_id", "d1", "d2").join(smallest.where("copies > 1"), ["d1", "d2"]).where("doc_id <> sid")
    copies = member.select(F.col("doc_id").alias("a"), F.col("sid").alias("b")).distinct()
    repeated = sets.groupBy("sid").agg(F.count("*").alias("n")).where("n > 1")
    labels = copies.join(comps, F.col("b") == F.col("node"), "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
    odd = copies.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a").union(copies.select("a").join(sets.select(F.col("sid").alias("a")), "a", "left_semi"))
    if not odd.isEmpty() or not repeated.isEmpty():  # a doc_id with several texts joins their groups
        labels = components(copies.select("a", "b").union(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    else:
        labels = labels.unionByName(comps)
    labels = labels.withColumnRenamed("node", "doc_id")
    out = signed_docs.select("doc_id", "n_shingles").join(labels, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame, threshold: float = 0.75, words: int = 5) -> DataFrame:
    """The documents, with all their columns, without those that have a smaller near-duplicate."""
    gone = near_duplicates(docs, threshold, words).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    named, back = set_aside(docs, doc="doc_id")
    return named.join(gone, F.col("doc") == F.col("gone"), "left_anti").select(*back)
