"""Working tables in the folder that all executors share.

A staged table cuts lineage: a lost executor costs at most the tasks that ran on it, because later
stages read Parquet files from ``spark.checkpoint.dir``.  The folder is read from the session; only
where the session names none and its master is local (tests, a laptop) is a temporary one made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folders import shared_folder, stage

__all__ = ["read_table", "set_aside", "shared_folder", "stage"]


def set_aside(docs: DataFrame, **needed: Column | str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns renamed _own_0, _own_1, ... and ``needed`` beside them, and what gives the columns back.

    An operator that adds columns of its own works on this form, so no name that a caller uses can clash with them.
    """
    own = [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns)]
    named = docs.select(*own, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in needed.items()])
    return named, [F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
