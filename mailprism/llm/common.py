"""What the training-data operators share: the shared folder, cut lineage, id filters, distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: The separators of words everywhere in this subpackage: space and the six ASCII controls 0x09-0x0D.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Id sets up to this many rows are sent to every executor (8 bytes each); larger ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mailprism-")
        spark.sparkContext.setCheckpointDir(found)
    return (found if "://" in found or found.startswith("file:") else f"file://{found}").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Within it, jobs pass batches of about `most` bytes to Python, whatever the session's setting."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._settled_at = path
    return found


def held(df: DataFrame) -> DataFrame:
    """df computed once and kept on the executors' disks, without files in the shared folder; unpersist() it after use.

    What a lost executor held is computed again from the tables that df was made of: those have to stay. It cuts no
    lineage: loops settle.
    """
    kept = df.persist(StorageLevel.DISK_ONLY)
    kept.count()
    return kept


def compact(df: DataFrame, name: str, rows: int = 500_000) -> DataFrame:
    """settled() for narrow rows that many tasks give few of: they are held first and written to a file for each `rows`."""
    kept = df.persist(StorageLevel.DISK_ONLY)
    found = settled(kept.coalesce(max(1, -(-kept.count() // rows))), name)
    kept.unpersist()
    return found


def drop_settled(*frames: DataFrame) -> None:
    """Deletes what settled() wrote, once nothing lazy reads it any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str, n_ids: int | None = None) -> DataFrame:
    """left_semi or left_anti of df with a set of ids; broadcast only after counting that the set is small."""
    n = ids.count() if n_ids is None else n_ids
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, how)


def ranked(df: DataFrame, group: str, order: list[Column], spread: Column, name: str, bits: int = 10) -> DataFrame:
    """Adds name: the gapless 0-based rank of each row within its group, without gathering a group in one task.

    Rows are first dealt to 2**bits slices of each group by the leading bits of the 64-bit value `spread`; ranks are
    taken within a slice, to which the counts of the slices before it are added. Rank order is by slice, then `order`.
    """
    sliced = df.withColumn("_slice", F.shiftrightunsigned(spread, 64 - bits))
    before = (
        sliced.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(W.partitionBy(group).orderBy("_slice")) - F.col("_n"))
        .drop("_n").withColumnRenamed(group, "_g").withColumnRenamed("_slice", "_s")
    )
    inside = sliced.withColumn("_in", F.row_number().over(W.partitionBy(group, "_slice").orderBy(spread, *order)))
    joined = inside.join(before, (F.col(group) == F.col("_g")) & (F.col("_slice") == F.col("_s")))
    return joined.withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_slice", "_g", "_s", "_before", "_in")


def numbered_repeats(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds name: 0, 1, ... to the rows that share the 64-bit key, counted in slices; 0 to a row whose key is its own.

    Which of the rows gets which number depends on the layout of the table, so they should be interchangeable.
    """
    again = compact(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key), "repeats")
    n = again.count()
    if not n:
        return df.withColumn(name, F.lit(0).cast("long"))
    some = by_ids(df.withColumn("_mp_place", F.monotonically_increasing_id()), again, key, "left_semi", n)
    some = ranked(settled(some, "repeats"), key, [F.col("_mp_place")], F.xxhash64("_mp_place"), name).drop("_mp_place")
    return by_ids(df, again, key, "left_anti", n).withColumn(name, F.lit(0).cast("long")).unionByName(some)
