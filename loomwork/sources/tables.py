"""Readers: tables of a scale-factor folder, trees of text files, records in YAML or JSON; and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files aren't scanned.
LARGEST_FILE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with ``row``, where each row stands in it: files by name, then rows as they were written."""
    df = table(spark, sf_dir, name)
    files = sorted(df.inputFiles())
    row = F.col("_metadata.row_index")
    if len(files) > 1:
        first = F.create_map(*[x for i, f in enumerate(files) for x in (F.lit(f), F.lit(i << 40))])
        row = row + F.element_at(first, F.col("_metadata.file_path"))
    return df.select("*", row.alias("row"))


def text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, modified_ns, content_hash, text) of UTF-8 files below a folder; binary and oversized files are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    rows = rows.where(F.col("length") <= LARGEST_FILE).where(F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains(F.col("content").cast("string"), F.lit("\x00")))
    bare = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    name = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^\\Q{bare}\\E/", "")
    text = F.col("content").cast("string")
    return rows.select(name.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), F.sha2("content", 256).alias("content_hash"), text.alias("text"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records: an object, a list, or one object for each line."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, partitioned by low-cardinality columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
