"""Helpers that the operators of this subpackage share.

Intermediate tables go to the folder that all executors and the driver share.  The cluster names it in
``spark.checkpoint.dir``; only where that is unset (as in tests) a temporary folder is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Setting under which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or one of our own where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="loomwork-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes a table to the shared folder and reads it again: later plans start there, and lost executors cost nothing.

    The shuffles behind it are removed once it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes settled tables that no later plan reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_path(spark, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(n: int, column: str = "doc_id") -> Column:
    """crc32 of an id written as text, modulo n; of an empty text for a null id."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def unit(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the given values alone."""
    return (F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def range_of(splitters: list[int], key: Column) -> Column:
    """The number of splitters up to the key, by binary search."""
    n, steps = len(splitters), [1 << i for i in reversed(range(max(1, len(splitters)).bit_length()))]
    at = longs(splitters)
    step = lambda p, b: F.when((p + b <= n) & (F.try_element_at(at, (p + b).cast("int")) <= key), p + b).otherwise(p)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def word_array(text: Column) -> Column:
    """The words of a text, without Python."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Adds gapless numbers from 1 in the given order without gathering all rows in one task.

    Rows are range-partitioned and settled; each partition is numbered by itself and shifted by the rows before it.
    The shifts are one row for each partition.
    """
    spark = df.sparkSession
    parts = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    before, shifts = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        shifts.append((part, before))
        before += n
    shift = spark.createDataFrame(shifts, "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(shift), "_part").withColumn(name, within + F.col("_before")).drop("_part", "_before")
