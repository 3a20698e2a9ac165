"""Places in one order over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled


def ranked(rows: DataFrame, order: list[Column], group: tuple[str, ...] = (), out: str = "rank") -> DataFrame:
    """``rows`` with ``out``, the place from 1 in ``order`` among the rows of the group, or of all.

    A window would put a group, or the table, into one task.  Here rows are range-partitioned and sorted; a place is that in
    the partition plus the group's rows in the partitions before it, which are one row for each partition and group.
    ``order`` should end all ties.  Null groups are a group.
    """
    by = [F.col(g).asc_nulls_first() for g in group]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    placed = settled(placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = placed.groupBy("__part", *group).agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy("__part")
    bases = counts.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__{g}") for g in group], (F.sum("n").over(before) - F.col("n") - F.col("first") + 1).alias("__base"))
    on = F.col("__part") == F.col("__p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return placed.join(bases, on).withColumn(out, F.col("__at") + F.col("__base")).drop("__part", "__at", "__p", "__base", *[f"__{g}" for g in group])
