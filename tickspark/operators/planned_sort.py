"""Sorting a stored tick table by rewriting only files whose ranges overlap.

A store is a folder of Parquet files.  A file that is sorted in itself and whose
range meets no other one stays as it is; files that overlap form groups, and
each group is sorted and written anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("ts", "idx", "ttf", "seq")


def file_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, lo, hi, ordered) of each file: its least and greatest key, and whether rows are in order of keys."""
    at = F.struct(*ORDER)
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), at.alias("at"))
    before = F.lag("at").over(Window.partitionBy("file").orderBy("place"))
    rows = rows.withColumn("back", F.col("at") < before)
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), (~F.coalesce(F.max("back"), F.lit(False))).alias("ordered"))


def plan(ranges: DataFrame) -> DataFrame:
    """Ranges with group, files that overlap directly or through others, and rewrite.

    One sweep over files by their least key: a file begins a group if it begins
    after all before it have ended.  A row a file is all that one task sees.
    """
    by_start = Window.orderBy("lo", "hi", "file")
    reach = F.max("hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("_new", (reach.isNull() | (F.col("lo") > reach)).cast("int"))
    rows = rows.withColumn("group", F.sum("_new").over(by_start)).drop("_new")
    size = F.count("*").over(Window.partitionBy("group"))
    return rows.withColumn("rewrite", (size > 1) | ~F.col("ordered"))


def sort_store(spark: SparkSession, path: str, codec: str = "zstd") -> tuple[list[str], list[str]]:
    """Bring the files of a store into disjoint, sorted ranges; gives the files that stay and those that were replaced.

    New files are written beside the store and come in before the old ones go, so
    rows are never missing; a reader in between can see a group twice.
    """
    todo = plan(file_ranges(spark, path)).select("file", "group", "rewrite").collect()  # a row a file, as the reader's own listing
    old = [r for r in todo if r["rewrite"]]
    kept = [r["file"] for r in todo if not r["rewrite"]]
    if not old:
        return kept, []
    groups = spark.createDataFrame([(r["file"], r["group"]) for r in old], "_file string, _group long")
    rows = spark.read.parquet(*(r["file"] for r in old))
    columns = rows.columns
    rows = rows.withColumn("_name", F.col("_metadata.file_path")).join(groups, F.col("_name") == F.col("_file")).select(*columns, "_group")
    # By group first: a new file holds rows of one group, so it can't span a file between two of them.
    rows = rows.repartitionByRange("_group", *ORDER).sortWithinPartitions("_group", *ORDER)
    side = f"{path.rstrip('/')}/_sorted-{uuid.uuid4().hex}"
    rows.write.option("compression", codec).partitionBy("_group").parquet(side)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(side).getFileSystem(spark._jsc.hadoopConfiguration())
    for group in system.listStatus(hadoop(side)):
        if group.isDirectory():
            for file in system.listStatus(group.getPath()):
                if file.getPath().getName().startswith("part-"):
                    system.rename(file.getPath(), hadoop(path, f"{group.getPath().getName().removeprefix('_group=')}-{file.getPath().getName()}"))
    for r in old:
        system.delete(hadoop(r["file"]), False)
    system.delete(hadoop(side), True)
    return kept, [r["file"] for r in old]
