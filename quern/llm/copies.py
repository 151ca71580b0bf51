"""Problem 2: records that differ only in whitespace, case, punctuation or order of fields."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kit import canonical, cut, table

#: A key with at least so many records is hot: its members never meet in one task.
HOT_ROWS = 20_000
#: At most so many hot keys are broadcast (24 bytes each); beyond, they are joined by a salted shuffle.
HOT_KEYS = 500_000
SALTS = 64


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)


def json_records(lines: DataFrame) -> DataFrame:
    """(id, prompt, answer) of the lines whose body is one whole JSON object.

    Missing and null fields give null; fields that are no strings give their JSON text; of a field
    that stands twice the last holds. Null, blank, broken bodies and other JSON values give no row.
    """

    def parse(batches):
        for b in batches:
            ids, prompts, answers = [], [], []
            for i, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    v = json.loads(body) if body else None
                except (ValueError, RecursionError):
                    continue
                if isinstance(v, dict):
                    ids.append(i)
                    prompts.append(_clean(_text(v.get("prompt"))))
                    answers.append(_clean(_text(v.get("answer"))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prompts, pa.string()), pa.array(answers, pa.string())], names=["id", "prompt", "answer"])

    return lines.select(F.col("line_id").cast("long"), "body").mapInArrow(parse, "id long, prompt string, answer string")


def _clean(s: str | None) -> str | None:
    """Lone surrogates (from escapes) can't be written as UTF-8."""
    return s if s is None or s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


def records(pairs: DataFrame, raw_lines: DataFrame) -> DataFrame:
    return pairs.select(F.col("pair_id").cast("long").alias("id"), "prompt", "answer").unionByName(json_records(raw_lines))


def keyed(recs: DataFrame) -> DataFrame:
    """(id, k1, k2): a 128-bit key of the canonical prompt and answer. Null equals null only."""
    p, a = canonical(F.col("prompt")), canonical(F.col("answer"))
    null = F.lit("\u0000")
    p, a = F.coalesce(p, null), F.coalesce(a, null)
    return recs.select("id", p.alias("p"), a.alias("a")).select("id", F.xxhash64("p", "a").alias("k1"), F.xxhash64("a", F.lit(7), "p").alias("k2"))


def _split(recs: DataFrame, hot_rows: int, hot_keys: int, salts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records (id, k1, k2) of ordinary keys; those of hot keys, salted; and (k1, k2, first_id, copies), one row a hot key.

    Hot keys are found exactly, by counts combined in each map task before the shuffle. Their
    records are aggregated on (key, salt) and then on the key. The keys are written once, so that
    neither texts are read nor JSON is parsed twice, and lost executors cost nothing.
    """
    keys = cut(keyed(recs), "copies")
    hot = keys.groupBy("k1", "k2").count().where(F.col("count") >= hot_rows).select("k1", "k2", F.lit(True).alias("hot"))
    hot = cut(hot, "hot-copies")
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    if hot.limit(hot_keys + 1).count() <= hot_keys:
        side, by = F.broadcast(hot), ["k1", "k2"]
    else:
        side, by = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["k1", "k2", "salt"]
    rest, members = salted.join(side, by, "left_anti").drop("salt"), salted.join(side, by, "left_semi")
    first = (
        members.groupBy("k1", "k2", "salt").agg(F.min("id").alias("m"), F.count("*").alias("c"))
        .groupBy("k1", "k2").agg(F.min("m").alias("first_id"), F.sum("c").alias("copies"))
    )
    return rest, members, first


def grouped(recs: DataFrame, hot_rows: int = HOT_ROWS, salts: int = SALTS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(id, first_id, copies) of every record that has a copy.

    Members of hot keys are joined with their key's row where they lie, or by key and salt, so no
    task holds a hot group. All other keys take one
    shuffle. Rows of an empty table give an empty result; a repeated id is a record of its own.
    """
    rest, members, first = _split(recs, hot_rows, hot_keys, salts)
    by_key = Window.partitionBy("k1", "k2")
    rest = rest.select("id", F.min("id").over(by_key).alias("first_id"), F.count("*").over(by_key).alias("copies")).where("copies > 1")
    if first.limit(hot_keys + 1).count() <= hot_keys:
        members = members.join(F.broadcast(first), ["k1", "k2"])
    else:
        members = members.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["k1", "k2", "salt"])
    return rest.unionByName(members.select("id", "first_id", "copies"))


def collapsed(recs: DataFrame, hot_rows: int = HOT_ROWS, salts: int = SALTS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(id, copies): a row for each group, its smallest id and the number of its records; single records are groups of one.

    The rows come from the aggregates; no record is joined back.
    """
    rest, _, first = _split(recs, hot_rows, hot_keys, salts)
    return rest.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies")).unionByName(first.withColumnRenamed("first_id", "id")).select("id", "copies")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(records(table(spark, sf_dir, "pairs"), table(spark, sf_dir, "raw_lines")))
    return g.where("id > first_id").select("first_id", F.col("id").alias("copy_id"))


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per group of copies, single records included, with the number of its copies."""
    return collapsed(records(table(spark, sf_dir, "pairs"), table(spark, sf_dir, "raw_lines")))


_RECORDS = r"""
with rec as (
  select pair_id as id, prompt, answer from pairs
  union all
  select line_id, json_extract_string(body, '$.prompt'), json_extract_string(body, '$.answer')
  from raw_lines where json_valid(body) and json_type(case when json_valid(body) then body end) = 'OBJECT'
), keyed as (
  select id, regexp_replace(replace(lower(upper(prompt)), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g') as p,
         regexp_replace(replace(lower(upper(answer)), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g') as a from rec
), g as (
  select id, min(id) over (partition by p, a) as first_id, count(*) over (partition by p, a) as copies from keyed
)
"""

SQL = {
    "p2_found": _RECORDS + "select first_id, id as copy_id from g where id > first_id",
    "p2_collapsed": _RECORDS + "select id, copies from g where id = first_id",
}
