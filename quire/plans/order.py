"""Global row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.session import cut_lineage, shuffle_width


def with_row_number(df: DataFrame, order: list[str | Column], name: str = "row") -> tuple[DataFrame, int]:
    """Number all rows from 0 in the given order; returns the frame and the row count.

    One range shuffle sorts the rows; each row then needs only its place within
    its partition and the number of rows in the partitions before it. The only
    data gathered are one count per partition. Rows that tie on every order
    column are interchangeable. Keep ``df`` narrow: it is shuffled whole.
    """
    spark = df.sparkSession
    placed = cut_lineage(
        df.repartitionByRange(shuffle_width(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    total, starts = 0, []
    for p, n in counts:
        starts.append((int(p), total))
        total += n
    offsets = spark.createDataFrame(starts, "_p long, _start long")
    out = (
        placed.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_p", "_at", "_start")
    )
    return out, total
