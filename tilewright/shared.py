"""The folder that all executors share, and tables in it that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def staging_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder under /tmp only for a local master without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "/tmp/checkpoints"
    return f"{shared.rstrip('/')}/tilewright/{spark.sparkContext.applicationId}"


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that lost executors cost no lineage."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` written to the shared folder in buckets by ``keys``, as many as a shuffle has partitions: joins and groups by these keys need not move it again."""
    spark = df.sparkSession
    table = f"tilewright_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).option("path", staged_path(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def before_sums(df: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """``df`` with the sum of ``size`` (whole numbers) over the rows before each one in ``order`` as ``name``.

    Sums are made by parts of a range partitioning and then inside each: no task has all rows.
    """
    rows = staged(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.sum(size).alias("_n"))
    starts = sizes.select(F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(earlier.orderBy("_part")), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum(size).over(earlier.partitionBy("_part").orderBy(*order)), F.lit(0))
    return rows.withColumn("_inside", inside).join(starts, F.col("_part") == F.col("_at")).withColumn(name, F.col("_start") + F.col("_inside")).drop("_part", "_at", "_start", "_inside")


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with its place from 0 in ``order`` as ``name``."""
    return before_sums(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name).drop("_one")


def clear_staged(spark: SparkSession) -> None:
    """Delete every table that ``staged`` has written for this application."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
