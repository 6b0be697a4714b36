"""How rows lie on the cluster before heavy expressions are evaluated on them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its scan has fewer splits than there are cores, else as it is.

    A small table in one file is one split, and detection would run on one core.  A large one has splits enough,
    and moving its texts would cost more than it brings.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
