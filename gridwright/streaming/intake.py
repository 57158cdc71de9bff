"""Files as they arrive: each is read once, and one that fails is noted and leaves the others alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.sources.registry import classify_file


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files under path with what kind each is, max_files at a time."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*").option("maxFilesPerTrigger", max_files).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), "length", "modificationTime", "content", classify_file(name).alias("type"))


def run_available(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, failed: str, checkpoint: str, max_bytes: int = 32 << 20) -> None:
    """All files there are, once: handle(files) is written to out; files too large, or that handle fails on, go to failed with the reason. Exactly once for each file: the batch number names its folder, so a repeated batch overwrites itself.

    A batch that fails is halved until what fails is single files, so one bad file costs a few jobs and the others are read as before."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        small, large = df.where(F.col("length") <= max_bytes), df.where(F.col("length") > max_bytes)
        large.select("path", "length", F.lit(f"over {max_bytes} bytes").alias("reason")).write.mode("overwrite").parquet(f"{failed}/batch={number}")
        try:
            handle(small).write.mode("overwrite").parquet(f"{out}/batch={number}")
            return
        except Exception as e:
            if small.isEmpty():
                raise
            said = e
        # Paths of one batch, which maxFilesPerTrigger bounds.
        open_, bad = [sorted(r["path"] for r in small.select("path").collect())], []
        handled = 0
        while open_:
            paths = open_.pop()
            try:
                handle(small.where(F.col("path").isin(paths))).write.mode("overwrite" if not handled else "append").parquet(f"{out}/batch={number}")
                handled += 1
            except Exception as e:
                said = e
                if len(paths) > 1:
                    open_ += [paths[len(paths) // 2 :], paths[: len(paths) // 2]]
                else:
                    bad.append((paths[0], str(said).splitlines()[0][:500] if str(said) else type(said).__name__))
        reasons = spark.createDataFrame(bad, "path string, reason string")
        small.select("path", "length").join(F.broadcast(reasons), "path").write.mode("append").parquet(f"{failed}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# The queue of files that a session holds


def add_files(queue: DataFrame, files: DataFrame) -> DataFrame:
    """queue(path, name, length, kind, status, note) with files(path, name, length) that aren't in it, as pending; kinds that nothing reads are skipped with a note."""
    kind = classify_file(F.col("name"))["kind"]
    known = kind != "unknown"
    new = files.join(queue.select("path"), "path", "left_anti").dropDuplicates(["path"])
    return queue.unionByName(new.select("path", "name", F.col("length").cast("long").alias("length"), kind.alias("kind"), F.when(known, "pending").otherwise("skipped").alias("status"), F.when(known, "").otherwise("no reader takes this file").alias("note")))


def update_files(queue: DataFrame, patches: DataFrame) -> DataFrame:
    """patches(path, status, note) laid over the queue."""
    p = patches.select("path", F.col("status").alias("_s"), F.col("note").alias("_n"))
    return queue.join(p, "path", "left").select(*[F.coalesce(f"_{c[0]}", c).alias(c) if c in ("status", "note") else F.col(c) for c in queue.columns])


def remove_files(queue: DataFrame, paths: DataFrame) -> DataFrame:
    return queue.join(paths.select("path"), "path", "left_anti")


def pending(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'pending'")
