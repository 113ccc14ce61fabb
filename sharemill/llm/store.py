"""Written tables in the shared folder that the cluster names, used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and all runs on one machine (local
    tests) one is made: executors on other machines couldn't read each other's rows there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "sharemill-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sharemill/{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Deletes what this session wrote, once its results are read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so that a lost executor
    never makes Spark compute it again. The files stay until forget() or the folder is cleared: a
    result that is read later still needs them."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if it has more than a part of a mean task's rows, the tasks being those of a shuffle.
HOT_PART = 4


def with_value(rows: DataFrame, table: DataFrame, key: str, spread: Column) -> DataFrame:
    """rows joined to table(key, n, ...), which has each key of rows once with its number of rows n
    (dropped). Rows of a hot key are dealt over several tasks by a hash of `spread`, and the key's
    one row of table is copied to each. Fewer than HOT_PART keys a task can be hot, so they are few
    enough to broadcast, however many rows there are."""
    tasks = shuffle_partitions(rows.sparkSession)
    limit = max(64, (table.agg(F.sum("n")).first()[0] or 0) // (HOT_PART * tasks))
    hot = F.broadcast(table.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("__salts")
    copies = table.drop("n").join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def unused(name: str, columns: list[str]) -> str:
    """A column name made of name that none of the columns has, in either case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns by their whole names, with dots too."""
    return [F.col(f"`{c}`") for c in df.columns]
