"""Writing of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.numbering import numbered
from quern.session import cut


def jsonl(df: DataFrame, path: str, stats: str | None = None, by: str | None = None) -> None:
    """K1: fields in alphabetical order; with stats also counts by a column. A path that exists is an error (K7)."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)
    if stats:
        df.groupBy(by).count().coalesce(1).write.mode("errorifexists").json(stats)


def shards(df: DataFrame, path: str, order: str, size: int) -> None:
    """K2: a folder for each shard of size rows in order; rows are numbered in ranges, so any number of shards is written at once."""
    x = numbered(df, [], [order], "_n").withColumn("shard", F.floor((F.col("_n") - 1) / size)).drop("_n")
    x.repartition("shard").sortWithinPartitions("shard", order).write.mode("overwrite").partitionBy("shard").parquet(path)


def tsv(df: DataFrame, path: str) -> None:
    """Tabs, line ends and backslashes in strings escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    cols = [esc(F.col(n)).alias(n) if k == "string" else F.col(n) for n, k in df.dtypes]
    df.select(*cols).write.mode("errorifexists").option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def append_missing(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key isn't there yet, and returns them as they were appended."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    todo = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if there else df
    todo = cut(todo, "todo")  # settled before the table changes
    todo.write.mode("append").parquet(path)
    return todo


def keyed(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """K4: a table to look keys up in: hash-partitioned and sorted, so a key's file and row group are found by statistics."""
    df.repartition(buckets, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def manifest(df: DataFrame, by: str, nested: str) -> DataFrame:
    """K9: one JSON list: counts and distincts by a column, within it counts by another. Both columns have few values."""
    k, t = F.coalesce(F.col(by), F.lit("")).alias("k"), F.coalesce(F.col(nested).cast("string"), F.lit("")).alias("tier")
    g = df.groupBy(k).agg(F.count("*").alias("rows"), F.countDistinct("prompt").alias("prompts"), F.countDistinct("answer").alias("answers"))
    s = df.groupBy(k, t).agg(F.count("*").alias("n")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("tier", "n"))).alias("tiers"))
    return g.join(s, "k").agg(F.to_json(F.array_sort(F.collect_list(F.struct("k", "rows", "prompts", "answers", "tiers")))).alias("manifest"))
