"""Texts that stand in evaluation sets: exact keys, long answers, shared runs of words, word-set similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import gram_keys, ngrams, normalize_key, word_list, word_set

NGRAM, LONG_ANSWER, OVERLAP = 8, 12, 0.8
#: Evaluation tables up to this many bytes, as estimated from a count and the mean row, are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def eval_keys(items: DataFrame) -> DataFrame:
    """(kind, key), distinct: normalized prompts, long answers, and runs of words of both."""
    keys = F.array(
        F.struct(F.lit("prompt").alias("kind"), F.array(normalize_key(F.col("prompt"))).alias("ks")),
        F.struct(F.lit("answer").alias("kind"), F.filter(F.array(normalize_key(F.col("answer"))), lambda k: F.length(k) > LONG_ANSWER).alias("ks")),
        F.struct(F.lit("gram").alias("kind"), F.concat(ngrams(word_list(F.col("prompt")), NGRAM), ngrams(word_list(F.col("answer")), NGRAM)).alias("ks")),
    )
    x = items.select(F.explode(keys).alias("k")).select("k.kind", F.explode("k.ks").alias("key"))
    return x.where("key is not null").distinct()


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint if df has at most so many bytes of values (one pass over df, which should be cheap), else df as it is."""
    return F.broadcast(df) if byte_size(df) <= limit else df


def byte_size(df: DataFrame) -> int:
    """Bytes of all values of df, about: of strings and arrays their lengths, 8 for all else."""

    def width(c: str, kind: str):
        if kind == "string":
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if kind == "array<string>":
            return F.coalesce(F.octet_length(F.array_join(c, " ")) + 8 * F.size(c), F.lit(0)) + 8
        return F.coalesce(8 * F.size(c), F.lit(0)) + 8 if kind.startswith("array") else F.lit(8)

    total = sum((width(f"`{n}`", k) for n, k in df.dtypes), F.lit(16))
    return df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0))).first()[0]


def suite_hits(rows: DataFrame, id_col: str, items: DataFrame) -> DataFrame:
    """(id, hit) of the rows (id, prompt, answer) with a text of the suite: 1 prompt, 2 long answer, 3 run of words, the least.

    J4, J5, J6 in one pass: each row's keys are exploded as hashes and meet the suite's keys, which
    are broadcast; only hits are shuffled.
    """
    def own_keys(df: DataFrame, *cols: str) -> DataFrame:
        p, a = F.coalesce("prompt", F.lit("")), F.coalesce("answer", F.lit(""))
        whole = lambda c, k, least: F.transform(F.filter(F.array(normalize_key(c)), lambda x: F.length(x) > least), lambda x: F.struct(F.lit(k).alias("hit"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(k), x).alias("b")))
        runs = F.transform(F.concat(gram_keys(word_list(p), NGRAM), gram_keys(word_list(a), NGRAM)), lambda x: F.struct(F.lit(3).alias("hit"), x["a"].alias("a"), x["b"].alias("b")))
        keys = F.concat(whole(p, 1, -1), whole(a, 2, LONG_ANSWER), runs)
        return df.select(*cols, F.explode(keys).alias("k")).select(*cols, "k.hit", "k.a", "k.b")

    keys = own_keys(items.where("prompt is not null")).distinct()
    return own_keys(rows, id_col).join(small(keys), ["hit", "a", "b"]).groupBy(id_col).agg(F.min("hit").alias("hit"))


def jaccard_join(left: DataFrame, right: DataFrame, threshold: float = OVERLAP, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(l, r, jaccard) of pairs with similar word sets, for left (l, text) and right (r, text), right the smaller.

    Words are ranked by how few of the right texts have them; a set at the threshold shares one of
    the first |r| - ceil(t|r|) + 1 words of the other, so left words meet only those, with the size
    filter, and every candidate is verified on the whole sets. If the right side is small it is
    broadcast with its sets and the left side is only streamed; else both sides are joined by
    their rare words. Empty texts are similar to none.
    """
    r = right.select("r", word_set(F.col("text")).alias("rs")).where("size(rs) > 0")
    df = r.select(F.explode("rs").alias("w")).groupBy("w").count()
    prefix = lambda x, key, ws: (
        x.select(key, F.explode(ws).alias("w")).join(df, "w", "left")
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "w"))).alias("ws"))
        .select(key, F.size("ws").alias("n"), F.explode(F.expr(f"slice(ws, 1, size(ws) - cast(ceil({threshold} * size(ws)) as int) + 1)")).alias("x")).where("x.c > 0").select(key, "n", F.col("x.w").alias("w"))
    )
    ls = left.select("l", word_set(F.col("text")).alias("ls")).where("size(ls) > 0")
    rare = prefix(r, "r", F.col("rs")).withColumnRenamed("n", "m")
    score = F.col("i") / (F.size("ls") + F.size("rs") - F.col("i"))
    if byte_size(r) <= limit:
        # for each rare word the right texts that have it: one lookup a left word
        index = F.broadcast(rare.join(F.broadcast(r), "r").groupBy("w").agg(F.collect_list(F.struct("r", "m", "rs")).alias("of")))
        near = ls.withColumn("w", F.explode("ls")).join(index, "w").select("l", "ls", F.explode(F.expr(f"filter(of, o -> o.m >= {threshold} * size(ls) and size(ls) >= {threshold} * o.m)")).alias("o"))
        both = near.select("l", "ls", "o.r", "o.rs").withColumn("i", F.size(F.array_intersect("ls", "rs")))
        return both.select("l", "r", score.alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12).distinct()
    cand = prefix(ls, "l", F.col("ls")).join(rare, "w").where(f"m >= {threshold} * n and n >= {threshold} * m").select("l", "r").distinct()
    both = cand.join(ls, "l").join(r, "r").withColumn("i", F.size(F.array_intersect("ls", "rs")))
    return both.select("l", "r", score.alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)
