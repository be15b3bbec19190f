"""Session construction and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "quire", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings their own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with ``checkpoint()`` in the folder the cluster names.

    ``spark.checkpoint.dir`` (shared storage) is used when the session has it. A
    local session without one, as in tests, gets a temporary folder; on a
    cluster, where executors could not share it, its absence is an error. Spent
    checkpoints are removed by Spark itself when the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return df.checkpoint(eager=True)


def spent(df: DataFrame) -> None:
    """Has the driver's JVM collect its garbage, which is when Spark removes shuffles and checkpoints that nothing refers to."""
    df.sparkSession.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Most rows, and bytes of strings, that one task of costly per-row work is given.
SPREAD_ROWS = 100_000
SPREAD_BYTES = 2 << 20


def _dealt(df: DataFrame) -> tuple[int, int, int, int, int]:
    """Partitions that hold rows, rows, bytes of strings, and the most of both in a partition."""
    held = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")), F.lit(0)).cast("long")
    parts = df.select(F.spark_partition_id().alias("p"), held.alias("b")).groupBy("p").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    return tuple(x or 0 for x in parts.agg(F.count("*"), F.sum("n"), F.sum("b"), F.max("n"), F.max("b")).first())


def parts_for(df: DataFrame, rows: int = SPREAD_ROWS, size: int = SPREAD_BYTES) -> int:
    """As many partitions as the rows and bytes of ``df`` ask for, two a core at least."""
    _, n, b, _, _ = _dealt(df)
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // rows), -(-b // size))


def spread(df: DataFrame, rows: int = SPREAD_ROWS, size: int = SPREAD_BYTES) -> DataFrame:
    """``df`` over all cores, and in as many partitions as its rows and bytes ask for.

    For costly per-row work: a partition holds about ``rows`` rows and ``size`` bytes of
    strings at most (a single row may be larger), so a larger input means more tasks
    and not longer ones. An input that is dealt so already passes as it is. Counting
    reads the columns of strings only (without any, of Parquet files the footers).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    some, n, b, most_n, most_b = _dealt(df)
    if not some or (some >= cores and most_n <= 2 * rows and most_b <= 2 * size):
        return df
    return df.repartition(max(2 * cores, -(-n // rows), -(-b // size)))
