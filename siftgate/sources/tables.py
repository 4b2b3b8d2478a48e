"""Reading tables so that a few small splits still use all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str, source: DataFrame | None = None) -> DataFrame:
    """Hash-partition a table on its id when its scan has fewer splits than there are cores.

    A file with one row group is one task, however many cores wait. What counts are the
    planned splits, not the files: a few large files have many splits and are left as they
    are, without a shuffle. For a stream, `source` is the table it reads.
    """
    splits = (df if source is None else source).rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if splits < cores else df
