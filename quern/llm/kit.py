"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir.

    On a cluster that setting names a folder all executors share. Only where it is unset (tests,
    local runs) a folder of this machine is set instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = "file:///tmp/quern-checkpoint"
    return f"{base}/quern-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors.

    The folder is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def canonical(col):
    """Letters and digits only, case folded; sharp s, which has no single capital, as ss."""
    return F.regexp_replace(F.replace(F.lower(F.upper(col)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", "")


INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFE0E, 0xFE0F, 0xFEFF])
#: Typographic forms of quotes and dashes.
TYPOGRAPHIC = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "–": "-", "—": "-", "−": "-", "…": "..."})


_SHOWN = TYPOGRAPHIC | INVISIBLE


def visible(s: str) -> str:
    """Without invisible characters, quotes and dashes in their plain form, NFC."""
    return s if s.isascii() else _visible(s)


@lru_cache(1024)
def _visible(s: str) -> str:
    return unicodedata.normalize("NFC", s.translate(_SHOWN))


def words(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", s.lower())


_P = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x + _P).astype(np.uint64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
