"""Partition layout of inputs for row-local work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Spread a frame that Spark reads in fewer splits than there are cores; leave larger inputs where they are.

    Row-local Python or regular-expression work runs with as many tasks as the
    scan has splits. A table of many splits needs no shuffle for it; a small one
    in a single file would run in one task. The rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()  # of the planned scan; no file names are gathered
    return df.repartition(cores) if splits < cores else df
