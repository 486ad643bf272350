"""Directory sources: which files belong to a stream and how they form logical partitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATH = "_metadata.file_path"


def read_files(
    spark: SparkSession, folder: str, schema, include: str = ".*", exclude: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """All files below ``folder`` whose whole path matches ``include`` and not ``exclude``.

    The conditions are on file metadata, so Spark drops files before it reads them. Columns
    ``file_path`` and, for parquet, ``file_row`` (the row's number in its file) come with the data.
    """
    df = spark.read.format(fmt).schema(schema).option("recursiveFileLookup", "true").load(folder)
    chosen = df.filter(F.col(PATH).rlike(f"^(?:{include})$"))
    if exclude:
        chosen = chosen.filter(~F.col(PATH).rlike(f"^(?:{exclude})$"))
    row = [F.col("_metadata.row_index").alias("file_row")] if fmt == "parquet" else []
    return chosen.select("*", F.col(PATH).alias("file_path"), *row)


def in_reading_order(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows of :func:`read_files` (parquet) with their group and ``place`` (0, 1, ...) in its reading order: files in
    path order, rows in file order.

    Only the files' row counts are ordered by the group; a row adds its own number to the rows of the files before it,
    so no group is sorted in one task.
    """
    from pyspark.sql import Window

    grouped = rows.withColumn("group_id", group_id(F.col("file_path"), pattern))
    files = grouped.groupBy("group_id", "file_path").agg((F.max("file_row") + 1).alias("n"))
    before = Window.partitionBy("group_id").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("group_id", "file_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return (
        grouped.join(files, ["group_id", "file_path"])
        .withColumn("place", F.col("_before") + F.col("file_row"))
        .drop("_before")
    )


def group_id(path: Column, pattern: str) -> Column:
    """The text between the two halves of a ``prefix[id]suffix`` pattern (both regular expressions:
    the first match of the prefix, then the first of the suffix). No match gives the whole path."""
    halves = pattern.split("[id]")
    if len(halves) != 2:
        return path
    prefix, suffix = halves
    groups = re.compile(prefix).groups
    whole = f"^(?:.*?)(?:{prefix})(.*?)(?:{suffix})"
    found = F.regexp_extract(path, whole, groups + 1)
    return F.when(path.rlike(whole), found).otherwise(path)


def file_groups(files: DataFrame, pattern: str) -> DataFrame:
    """Per file its group and its place in reading order (path order) inside the group.

    Input: one row per file with ``file_path``; the listing is small beside the data.
    """
    from pyspark.sql import Window

    grouped = files.withColumn("group_id", group_id(F.col("file_path"), pattern))
    return grouped.withColumn(
        "file_no", F.row_number().over(Window.partitionBy("group_id").orderBy("file_path")).cast("bigint")
    )
