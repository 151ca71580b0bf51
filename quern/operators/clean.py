"""Raw batches to clean pairs: join, explode, parse, validate by first failing rule, keep first copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import is_refusal, normalize_key, space_words, strip
from quern.operators.contamination import OVERLAP, jaccard_join, suite_hits
from quern.session import cut

MAX_ANSWER_WORDS = 40


def last_requests(requests: DataFrame) -> DataFrame:
    """Of requests with the same id the last one counts."""
    w = Window.partitionBy("custom_id").orderBy(F.col("submitted_at").desc_nulls_last(), F.col("category").desc_nulls_last())
    return requests.where("custom_id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def teacher_lines(results: DataFrame) -> DataFrame:
    """(custom_id, received_at, lines) with lines a map from item number to answer; the last line of a number counts.

    Junk lines and lines without both fields are skipped; backticks around a line don't count.
    """
    text = F.array_join(F.transform(F.filter(F.col("result.message.content"), lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
    line = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.regexp_replace(strip(x), "^`+|`+$", "")), lambda x: x != "")
    parsed = F.transform(line, lambda x: F.from_json(x, "i int, answer string, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = F.filter(parsed, lambda x: x["_bad"].isNull() & x["i"].isNotNull() & x["answer"].isNotNull())
    return results.withColumn("lines", F.coalesce(good, F.array().cast("array<struct<i:int,answer:string,_bad:string>>")))


def candidate_items(requests: DataFrame, results: DataFrame) -> DataFrame:
    """An item row for each result of a known request (custom_id, received_at, category, i, prompt, tier, answer, status)."""
    r = teacher_lines(results.select("custom_id", "received_at", "result")).select("custom_id", "received_at", F.coalesce(F.col("result.type"), F.lit("")).alias("type"), "lines")
    x = r.join(last_requests(requests).select("custom_id", "category", "items"), "custom_id", "left")
    x = x.select("custom_id", "received_at", "type", "category", "lines", F.explode_outer("items").alias("item"))
    answer = F.try_element_at(F.filter("lines", lambda y: y["i"] == F.col("item.i")), F.lit(-1))["answer"]
    status = F.when(F.col("category").isNull(), "no_matching_request").when(F.col("type") != "succeeded", "batch_errored").when(answer.isNull(), "missing_item").otherwise("ok")
    return x.select("custom_id", "received_at", "category", F.col("item.i").alias("i"), F.col("item.prompt").alias("prompt"), F.col("item.tier").alias("tier"), strip(answer).alias("answer"), status.alias("status"))


def drop_reasons(items: DataFrame, suite: DataFrame) -> DataFrame:
    """Items with drop_reason, the first rule that fails, null for kept ones.

    The parsed items are numbered and written once. What passes the cheap rules is held against the
    evaluation suite, keys and similar prompts each in one streaming pass, and only hits are
    shuffled; copies are found last, by an aggregate that combines before its shuffle, among rows
    that passed everything else.
    """
    cheap = (
        F.when(F.col("status") != "ok", F.col("status")).when(F.col("answer") == "", "empty_answer").when(is_refusal(F.col("answer")), "refusal")
        .when(F.size(space_words(F.col("answer"))) > MAX_ANSWER_WORDS, "overlong")
    )
    rows = cut(items.withColumn("id", F.monotonically_increasing_id()).withColumn("drop_reason", cheap), "items")
    open_ = rows.where("drop_reason is null")
    near = jaccard_join(open_.select(F.col("id").alias("l"), F.col("prompt").alias("text")), suite.select(F.col("id").alias("r"), F.col("prompt").alias("text")), OVERLAP)
    hits = suite_hits(open_, "id", suite).unionByName(near.select(F.col("l").alias("id"), F.lit(4).alias("hit"))).groupBy("id").agg(F.min("hit").alias("hit"))
    reason = F.coalesce(*[F.when(F.col("hit") == k, f"contamination_{r}") for k, r in enumerate(("exact_prompt", "exact_answer", "8gram", "overlap"), 1)])
    rows = cut(rows.join(hits, "id", "left").withColumn("drop_reason", F.coalesce("drop_reason", reason)).drop("hit"), "items")
    keys = [normalize_key(F.col("prompt")).alias("p"), normalize_key(F.col("answer")).alias("a")]
    first = rows.where("drop_reason is null").groupBy(*keys).agg(F.min(F.struct("received_at", "custom_id", "i", "id")).alias("m")).select(F.col("m.id").alias("id"), F.lit(True).alias("first"))
    rows = rows.join(first, "id", "left").withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & F.col("first").isNull(), "duplicate").otherwise(F.col("drop_reason")))
    return rows.select("custom_id", "received_at", "category", "i", "prompt", "tier", "answer", "drop_reason")


def first_wins(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """The first row of each key in a total order; each task keeps one row a key before the shuffle, so hot keys cost no more."""
    first = F.min(F.struct(*order, F.struct(*df.columns).alias("row"))).alias("m")
    return df.groupBy(*[k if isinstance(k, str) else k.alias(f"_k{n}") for n, k in enumerate(keys)]).agg(first).select("m.row.*")
