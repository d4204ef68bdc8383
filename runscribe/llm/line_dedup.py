"""Line dedup by distinct-site spread.

Each line hash gets a HyperLogLog sketch of the sites (sources) that hold it; sketches merge map-side and
then by key.  An estimate far from the threshold decides; lines near it get an exact distinct count.
Lines on ``min_sites`` sites or more are boilerplate and go from every text but the first that has them.

Copied documents spread their own lines too, so what counts is not a document's site but that of its group of
near-duplicates: one group, one site.  Groups are asked for only where they matter.  A first sketch over all sites
leaves the lines that can reach the threshold at all, a second over distinct texts leaves those that still can, and only
texts that hold one of these go through near-dedup; a third sketch counts the groups' sites.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import near_duplicates
from .workspace import set_aside, stage

#: log2 of the sketch's registers; the standard error is 1.04 / sqrt(2**12) = 1.6 %.
SKETCH_LOG2 = 12
#: Estimates within this share of the threshold are counted exactly: over ten standard errors.
NEAR = 0.2
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_key, pos, k1, k2 of each line that isn't blank; 128 bits of hash are a line's key."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x, F.lit(BLANKS)).alias("line")))
    held = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), F.explode(F.filter(lines, lambda x: x["line"] != "")).alias("l"))
    return held.select("doc_id", "source", "text_key", "l.pos", F.xxhash64("l.line").alias("k1"), F.xxhash64(F.lit(7), "l.line").alias("k2"))


def spread_of(rows: DataFrame, site: str, min_sites: int) -> DataFrame:
    """k1, k2, sites of the lines of ``rows`` whose estimated number of distinct sites could be ``min_sites``."""
    sites = rows.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg(site, SKETCH_LOG2)).alias("sites"))
    return sites.where(F.col("sites") >= min_sites * (1 - NEAR))


def near_groups(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """text_key, near: for each of ``keys`` (text_key) its text's group of near-duplicates among these texts."""
    named, _ = set_aside(docs.where("text IS NOT NULL"), text_key=F.xxhash64("text"), body="text")
    texts = named.select("text_key", "body").join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.min("body").alias("text"))
    found = near_duplicates(texts.withColumnRenamed("text_key", "doc_id"))
    return found.select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("near"))


def widespread_lines(docs: DataFrame, lines: DataFrame, min_sites: int) -> DataFrame:
    """k1, k2, first_text of lines on at least ``min_sites`` distinct non-null sites, a group of near-duplicates having one."""
    with_source, first = F.struct(F.col("source").isNull(), F.col("doc_id").isNull(), "doc_id", "source"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    once = stage(lines.groupBy("k1", "k2", "text_key").agg(F.min(with_source).alias("own"), F.min(first).alias("first")), "line-texts")
    open_ = stage(spread_of(once, "own.source", min_sites).drop("sites"), "line-open")
    still = stage(once.join(open_, ["k1", "k2"]), "line-still")
    near = stage(near_groups(docs, still.select("text_key").distinct()), "line-near")
    groups = still.join(near, "text_key").groupBy("k1", "k2", "near").agg(F.min("own")["source"].alias("site"), F.min("first").alias("first"))
    groups = stage(groups, "line-groups")
    firsts = groups.groupBy("k1", "k2").agg(F.min("first")["text_key"].alias("first_text"))
    spread = stage(spread_of(groups, "site", min_sites).join(firsts, ["k1", "k2"]), "line-spread")
    far = spread.where(F.col("sites") > min_sites * (1 + NEAR)).drop("sites")
    near_bound = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).drop("sites")
    exact = (
        groups.select("k1", "k2", "site")
        .join(near_bound, ["k1", "k2"])
        .groupBy("k1", "k2", "first_text", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("k1", "k2", "first_text")
        .agg(F.count("site").alias("sites"))
    )
    return far.unionByName(exact.where(F.col("sites") >= min_sites).drop("sites"))


def _without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    def kept(t, g):
        if t is None or g is None or not len(g):
            return t
        drop = set(g)
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)

    return pd.Series([kept(t, g) for t, g in zip(text, gone, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, min_sites: int = 5) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines and n_removed behind its own columns.

    Lines are what stands between line feeds, compared without blanks at either end; blank lines stay.  The
    text of the smallest doc_id that has a boilerplate line keeps it, in every row with that text, so equal
    texts are cut alike; among rows with that doc_id, or where no row has one, any one text does.  Null text
    has no lines and stays null; null sources are no site; of a group of near-duplicates (shingles of five words,
    similarity 0.75, among the texts that hold a line in question), the site is that of the smallest doc_id with a source.  With fewer than ``min_sites`` sources nothing goes.  Other columns stay as
    they are, except that own columns called n_lines or n_removed give way to the operator's.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = lines_of(docs)
    held = stage(lines.join(stage(spread_of(lines, "source", min_sites).drop("sites"), "line-sites"), ["k1", "k2"]), "line-held")
    boilerplate = stage(widespread_lines(docs, held, min_sites), "line-boilerplate")
    hits = held.join(boilerplate, ["k1", "k2"]).where("text_key <> first_text")
    gone = hits.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone"))
    named, back = set_aside(docs, own_doc="doc_id", own_text="text", own_key=F.xxhash64("text"))
    joined = named.join(gone, F.col("own_doc").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key")), "left")
    n_lines = F.when(F.col("own_text").isNull(), 0).otherwise(F.size(F.split("own_text", "\n"))).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    # a set look-up a line: array_contains over the removed places would grow with lines times removed lines
    cut = F.when(F.col("gone").isNull(), F.col("own_text")).otherwise(F.pandas_udf(_without_lines, "string")("own_text", "gone"))
    kept = [cut.alias("text") if c == "text" else b for c, b in zip(docs.columns, back, strict=True)]
    return joined.select(*kept, n_lines.alias("n_lines"), n_removed.alias("n_removed"))
