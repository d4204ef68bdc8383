"""A training corpus from raw documents: language, boilerplate, near-duplicates, mixture, packed windows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscribe.llm import langid, line_dedup, minhash, mixing, packing
from runscribe.llm.workspace import read_table, stage

#: What a stage takes and, but for the last, returns; other columns of its input are left out.  Each stage takes an empty table and gives
#: an empty one, takes texts whole whatever their length, and handles nulls in any column as its operator says.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null texts, those without letters and those with no sure language go.

    Repeated rows are judged alike.  Where no label is learned (an empty table, no labels) everything is undetermined and goes.
    """
    return langid.accepted(docs.select(COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines; every row stays, and n_chars follows its text, null for a null text.

    The first text with a line keeps it; rows with equal texts are cut alike, so ties and repeated rows stay equal.
    """
    return line_dedup.dedup_lines(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Texts without words, and rows without doc_id, are linked with nothing and stay; rows that repeat a kept doc_id stay all.
    """
    return minhash.kept_documents(docs.select(COLUMNS)).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source to target weights; a document that the mix takes twice is there twice."""
    return mixing.mixed_documents(docs.select(COLUMNS)).select(COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens; a null text is empty and has its end token only, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Language ID and packing are beyond SQL; a test holds the rows of each stage against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{i}")
    return docs
