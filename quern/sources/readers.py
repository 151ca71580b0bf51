"""Reading of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; blank lines don't count; compressed files too."""
    return spark.read.schema(schema).json(path)


def strict_jsonl(spark: SparkSession, path: str, known: DataFrame, counters: list[str]) -> tuple[DataFrame, DataFrame]:
    """Outputs and violations: lines that are no object, have no id, an unknown or a repeated one; bad counters become null.

    Rows (id, output, counters...); of a repeated id the first line in file order counts.
    """
    kind = "id string, output string, " + ", ".join(f"{c} string" for c in counters) + ", _bad string"
    lines = spark.read.text(path).withColumn("place", F.concat_ws("#", F.col("_metadata.file_path"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))).where(F.trim("value") != "")
    x = lines.withColumn("v", F.from_json("value", kind, {"columnNameOfCorruptRecord": "_bad"})).select("value", "place", "v.*")
    whole = lambda c: F.when(F.col(c).rlike(r"^\d{1,18}$"), F.col(c).cast("long"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("place"))
    x = x.join(known.select(F.col("id"), F.lit(True).alias("known")).distinct(), "id", "left").withColumn("rn", first)
    reason = F.when(F.col("_bad").isNotNull(), "not_an_object").when(F.col("id").isNull(), "no_id").when(F.col("known").isNull(), "unknown_id").when(F.col("rn") > 1, "duplicate_id")
    x = x.withColumn("reason", reason)
    bad_counter = [F.when(F.col(c).isNotNull() & whole(c).isNull(), F.lit(f"bad_{c}")) for c in counters]
    violations = x.select("id", F.explode(F.array_compact(F.array("reason", *bad_counter))).alias("reason"))
    return x.where("reason is null").select("id", "output", *[whole(c).alias(c) for c in counters]), violations


def xml_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a dump's main namespace (t, r, n, w); r is the redirect's target."""
    schema = "title string, ns int, id long, redirect struct<_title: string>, revision struct<text: string>"
    x = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return x.where("ns = 0").select(F.col("id").alias("page_id"), F.col("title").alias("t"), F.col("redirect._title").alias("r"), F.length("revision.text").cast("long").alias("n"), F.col("revision.text").alias("w"))


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Text between blank lines."""
    return spark.read.option("lineSep", "\n\n").text(path).select(F.trim("value").alias("text")).where("text <> ''")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S14."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def words(spark: SparkSession, path: str) -> DataFrame:
    """Lower-case alphabetic lines."""
    return spark.read.text(path).where(F.col("value").rlike("^[a-z]+$")).select(F.col("value").alias("word"))


def log_rows(spark: SparkSession, path: str) -> DataFrame:
    """Step, training and validation loss out of free text."""
    x = spark.read.text(path)
    part = lambda p: F.regexp_extract("value", p, 1)
    return x.where(F.col("value").rlike(r"^step \d+:")).select(part(r"^step (\d+)").cast("long").alias("step"), part(r"train loss ([0-9.]+)").cast("double").alias("train_loss"), part(r"val loss ([0-9.]+)").cast("double").alias("val_loss"))


def config(spark: SparkSession, path: str) -> DataFrame:
    """key=value lines with an error for each bad one; # begins a comment."""
    x = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    good = F.col("value").contains("=") & (F.trim(F.split_part("value", F.lit("="), F.lit(1))) != "")
    return x.select(F.when(good, F.trim(F.split_part("value", F.lit("="), F.lit(1)))).alias("key"), F.when(good, F.trim(F.expr("substring(value, instr(value, '=') + 1)"))).alias("setting"), F.when(~good, F.lit("no_key")).alias("error"))
