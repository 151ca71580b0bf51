"""Token shards, keyed tables, side files, and publishing."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import vocab
from quern.functions.text import hash_order


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> None:
    """K6: written beside and renamed, so that no reader sees a part."""
    fs, p = _fs(spark, path)
    _, beside = _fs(spark, path + ".part")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"{path} can't be published")


def _get(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if fs.exists(p) else None  # a small manifest


def write_windows(df: DataFrame, path: str, split: str, size: int, vocab_size: int) -> None:
    """K3: windows (ids, tgt) of a split, and meta.json, which is taken away first and put back last."""
    spark = df.sparkSession
    fs, meta = _fs(spark, f"{path}/meta.json")
    fs.delete(meta, False)
    df.select("ids", "tgt").write.mode("overwrite").parquet(f"{path}/{split}")
    _put(spark, f"{path}/meta.json", json.dumps({"seq_len": size, "vocab_size": vocab_size, "windows": spark.read.parquet(f"{path}/{split}").count()}, sort_keys=True))


def window_faults(spark: SparkSession, path: str, split: str, size: int, vocab_size: int) -> DataFrame:
    """(fault, n) of a split: windows and targets of another length, ids and targets out of range, windows without a target,
    and what meta.json says otherwise. -1 targets are masked. Without meta.json the split is unfinished."""
    meta = json.loads(_get(spark, f"{path}/meta.json") or "{}")
    w = spark.read.parquet(f"{path}/{split}")
    off = lambda c, low: F.coalesce(F.array_min(c) < low, F.lit(False)) | F.coalesce(F.array_max(c) >= vocab_size, F.lit(False))
    rules = {
        "ids_length": F.size("ids") != size, "targets_length": F.size("ids") != F.size("tgt"), "ids_range": off("ids", 0), "targets_range": off("tgt", -1), "all_masked": F.coalesce(F.array_max("tgt") < 0, F.lit(True)),
    }
    counts = w.agg(F.count("*").alias("windows"), *[F.count_if(c).alias(n) for n, c in rules.items()]).select(
        F.when(F.col("windows") == 0, 1).otherwise(0).cast("long").alias("no_windows"), *rules,
        *[F.lit(int(bad)).cast("long").alias(n) for n, bad in (("unfinished", not meta), ("other_length", bool(meta) and meta["seq_len"] != size), ("other_vocabulary", bool(meta) and meta["vocab_size"] != vocab_size))],
    )
    names = counts.columns
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("fault"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*").where("n > 0")


def random_windows(windows: DataFrame, id_col: str, want: int, seed: int, trim: bool = False) -> DataFrame:
    """Want windows drawn with replacement: draw k takes the first window whose hash isn't below the k-th random place.

    The places meet the windows in ranges of the hash, so neither side is collected. With trim,
    windows end behind their last target.
    """
    spark = windows.sparkSession
    n = windows.count()
    if n == 0 or want == 0:
        return windows.withColumn("draw", F.lit(0).cast("long")).limit(0)
    from quern.operators.numbering import numbered

    draws = spark.range(want).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)) + 1).alias("pos"))
    x = numbered(windows, [], [hash_order(str(seed), id_col), id_col], "pos").join(draws, "pos").drop("pos")
    if trim:
        last = F.array_max(F.transform("tgt", lambda t, i: F.when(t >= 0, i + 1).otherwise(0)))
        x = x.withColumn("ids", F.slice("ids", 1, last)).withColumn("tgt", F.slice("tgt", 1, last))
    return x


def token_rows(spark: SparkSession, path: str, bos: int, size: int) -> DataFrame:
    """(shard, row, ids) of raw shards of 16-bit ids: split where a row begins; what is before the first beginning and rows
    longer than size are dropped."""

    def run(batches):
        for b in batches:
            for name, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(blob[: len(blob) // 2 * 2], "<u2").astype(np.int32)
                at = np.flatnonzero(ids == bos)
                rows = [r.tolist() for r in np.split(ids, at)[1:]] if len(at) else []
                keep = [(k, r) for k, r in enumerate(rows) if len(r) <= size]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keep), pa.string()), pa.array([k for k, _ in keep], pa.int64()), pa.array([r for _, r in keep], pa.list_(pa.int32()))], names=["shard", "row", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "shard string, row long, ids array<int>")


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a keyed table (writers.keyed) for keys: few keys are compared in the scan, so statistics skip
    files and row groups; many are joined."""
    table = spark.read.parquet(path)
    few = [r[0] for r in keys.select(key).where(F.col(key).isNotNull()).distinct().limit(201).collect()]
    return table.where(F.col(key).isin(few)) if len(few) <= 200 else table.join(keys.select(key).distinct(), key, "left_semi")


def fingerprint(df: DataFrame) -> str:
    """An order-free fingerprint of a table: its number of rows and the sum of their hashes."""
    n, s = df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n}|{s}".encode()).hexdigest()


def write_alias(df: DataFrame, base: DataFrame, path: str) -> None:
    """An alias table tied to its base table by the base's fingerprint."""
    df.write.mode("overwrite").parquet(f"{path}/alias")
    _put(df.sparkSession, f"{path}/base.json", json.dumps({"base": fingerprint(base)}))


def read_alias(spark: SparkSession, path: str, base: DataFrame) -> DataFrame:
    """Refused if it belongs to another state of the base."""
    said = _get(spark, f"{path}/base.json")
    if said is None or json.loads(said)["base"] != fingerprint(base):
        raise ValueError(f"{path} belongs to another base table")
    return spark.read.parquet(f"{path}/alias")


def write_head(weights: DataFrame, path: str) -> None:
    """Weights of a linear head (out, dim, w) with the hash of their contents beside them."""
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    _put(weights.sparkSession, f"{path}/head.json", json.dumps({"body": fingerprint(weights)}))


def read_head(spark: SparkSession, path: str) -> DataFrame:
    """Refused if the contents aren't what was written."""
    w = spark.read.parquet(f"{path}/weights")
    said = _get(spark, f"{path}/head.json")
    if said is None or json.loads(said)["body"] != fingerprint(w):
        raise ValueError(f"{path} isn't what was written")
    return w


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece, score) of a file of scored pieces."""

    def run(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                rows = vocab.unpacked(blob)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.float32())], names=["id", "piece", "score"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id int, piece string, score float")


def publish(df: DataFrame, path: str, status: str) -> None:
    """K6: a new state of a table beside the old ones, and a status file, written last, that names it; readers follow the status."""
    spark = df.sparkSession
    state = f"state-{hashlib.sha256((path + status + (_get(spark, f'{path}/STATUS') or '')).encode()).hexdigest()[:16]}"
    df.write.mode("errorifexists").parquet(f"{path}/{state}")
    _put(spark, f"{path}/STATUS", json.dumps({"state": state, "status": status}))


def published(spark: SparkSession, path: str) -> DataFrame:
    """K6: the state that the status file names."""
    said = _get(spark, f"{path}/STATUS")
    if said is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    return spark.read.parquet(f"{path}/{json.loads(said)['state']}")


def ordered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of many files with place, which orders them by path, then by line: a struct of path, block and row in it."""
    x = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"))
    return x.where(F.trim("value") != "").select(F.from_json("value", schema).alias("v"), "place").select("v.*", "place")
