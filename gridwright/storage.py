"""Intermediate tables in the folder that the cluster shares: they cut the lineage, survive lost executors, and spare later plans what led to them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below the folder that spark.checkpoint.dir names. Where that is unset, a local session gets a folder of its own, and any other an error: its executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="gridwright-"))
    path = f"{base.rstrip('/')}/gridwright-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have gone at exit
        pass


#: Bytes of the table that another is made of, for each file of that one.
FILE = 4 << 20


def files_for(df: DataFrame) -> int:
    """Into how many files to write a table made of df's rows, if it is not much larger: one for FILE bytes of df, two for each core at least, and as many as there are shuffle partitions at most. Without adaptive coalescing Spark would write one for each of these, however little is in it."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2 * spark.sparkContext.defaultParallelism, -(-size // FILE)))


def materialize(df: DataFrame, files: int | None = None) -> DataFrame:
    """df, written to the shared folder and read again, so that later joins also have its measured size. Files go by release(), or when the driver ends. files: how many at most; a task then makes several neighbouring partitions."""
    spark = df.sparkSession
    path = shared_dir(spark)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes the files of tables that materialize gave, once all that was made of them is written itself."""
    for df in tables:
        if path := getattr(df, "_written", None):
            remove(df.sparkSession, path)


def pinned(df: DataFrame) -> DataFrame:
    """df checkpointed to the shared folder: its rows stay in their partitions and in order, however often it is read."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df, a small side of a join by keys it is grouped by, behind a round-robin exchange: the join then adds plain exchanges to both sides, and adaptive execution can split keys that are hot on the other one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """df with its rows' numbers, from 1, within their group by order. Rows are sorted globally into ranges and each range counts on from those before it, so that a group may be as large as it likes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, group, order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), before.alias("__before"))
    inside = F.row_number().over(W.partitionBy(group, "__part").orderBy(order))
    return ranged.withColumn("__i", inside).join(spread(starts), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))).withColumn(name, (F.col("__before") + F.col("__i")).cast("long")).drop("__part", "__g", "__p", "__before", "__i")
