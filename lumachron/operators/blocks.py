"""Series in blocks: ranges of (keys, order), so that no task needs a whole series.

Rows are dealt by sampled range splitters and written once, as splitters are drawn anew whenever they are worked out. What
passes from a block to the next (places, last values, carries) is one row a key and block.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a block is to have, more or less.
ROWS_A_BLOCK = 50_000
ORDER = ("t", "row_id")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new local folder if driver and executors are one process, as in tests; else an
    error, as other machines wouldn't see a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocked(rows: DataFrame, keys: tuple[str, ...] = ("series_id",), order: tuple[str, ...] = ORDER, rows_a_block: int | None = None) -> DataFrame:
    """rows with block: within a key, blocks are ascending ranges of the order; rows equal in it share a block."""
    count = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (rows_a_block or ROWS_A_BLOCK)))
    return written(rows.repartitionByRange(count, *keys, *order).withColumn("block", F.spark_partition_id()), "blocks")


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet."""
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return a.join(right, on, how).drop(*[f"_{k}" for k in keys])


def numbered(rows: DataFrame, keys: tuple[str, ...] = ("series_id",), order: tuple[str, ...] = ORDER, rows_a_block: int | None = None) -> DataFrame:
    """rows with i, the place in the order of their key from 1, n, how many rows the key has, and block. Rows with block are taken as blocked."""
    rows = rows if "block" in rows.columns else blocked(rows, keys, order, rows_a_block)
    counts = rows.groupBy(*keys, "block").agg(F.count("*").alias("rows"))
    w = Window.partitionBy(*keys)
    starts = counts.select(*keys, "block", (F.sum("rows").over(w.orderBy("block")) - F.col("rows")).alias("start"), F.sum("rows").over(w).alias("n"))
    inner = F.row_number().over(Window.partitionBy(*keys, "block").orderBy(*order))
    return same(rows.withColumn("i", inner), starts, [*keys, "block"]).withColumn("i", F.col("i") + F.col("start")).drop("start")


def medians(rows: DataFrame, keys: tuple[str, ...], value: str, name: str = "middle") -> DataFrame:
    """keys, name: the median of each key's values that aren't null, as F.median gives it.

    Values are counted, and dealt in ranges of (key, value); running counts by range tell which ranges hold the middle
    ranks, and only those are ordered.
    """
    counted = rows.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(value).alias("c"))
    counted = blocked(counted, keys, ("v",))
    sums = counted.groupBy(*keys, "block").agg(F.sum("c").alias("rows"))
    w = Window.partitionBy(*keys)
    starts = sums.select(*keys, "block", "rows", (F.sum("rows").over(w.orderBy("block")) - F.col("rows")).alias("start"), F.sum("rows").over(w).alias("n"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    held = same(counted, starts.where((F.col("start") < high) & (F.col("start") + F.col("rows") >= low)).drop("rows"), [*keys, "block"])
    upto = F.col("start") + F.sum("c").over(Window.partitionBy(*keys, "block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("c") < rank) & (F.col("upto") >= rank), F.col("v")))
    found = held.withColumn("upto", upto).groupBy(*keys).agg(at(low).alias("a"), at(high).alias("b"))
    middle = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * 0.5 + F.col("b") * 0.5)
    return same(sums.select(*keys).distinct(), found.select(*keys, middle.alias(name)), list(keys), "left")
