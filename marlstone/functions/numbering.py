"""Row numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stages import checkpointed


def numbered(df: DataFrame, order: list[Column | str], name: str = "rn") -> DataFrame:
    """``df`` with numbers from 0 in the given order, which must be total.

    Rows are range-partitioned by the order and numbered inside each partition; the partitions' counts, a row for
    each, give the offsets. The ranged rows are kept, so that both passes see the same partitions.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [f"__o{i}" for i in range(len(cols))]
    ranged = checkpointed(df.withColumns(dict(zip(keys, cols))).repartitionByRange(*keys).withColumn("__pid", F.spark_partition_id()))
    counts = ranged.groupBy("__pid").agg(F.count("*").alias("__n"))
    offsets = counts.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__pid").orderBy(*keys)) - 1
    return ranged.withColumn("__in", inside).join(F.broadcast(offsets), "__pid").withColumn(name, F.col("__first") + F.col("__in")).drop("__pid", "__first", "__in", *keys)
