"""How rows lie before a long projection."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is read from fewer files than there are cores; else as it is.

    Only the list of input files is looked at, so no plan is built and no job runs.  A file larger than a split is
    read by several tasks anyhow; then this costs one exchange of the columns that are asked for.
    """
    cores = int(df.sparkSession.conf.get("spark.default.parallelism", None) or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(cores) if len(df.inputFiles()) < min(cores, 64) else df
