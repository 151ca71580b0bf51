"""Token windows: streams cut at fixed lengths, padded windows, shifted targets, greedy paragraphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of a running sum; only the blocks' totals are summed in a single task.
BLOCK = 65_536


def running(df: DataFrame, order: str, size: str, out: str, block: int = BLOCK) -> DataFrame:
    """Sum of size over all rows before this one by the order column (a unique long), in two levels.

    Blocks of the order column are summed each in its own task; the totals of the blocks, a
    BLOCK-th of the rows, meet in one window.
    """
    x = df.withColumn("_b", F.floor(F.col(order) / block))
    base = x.groupBy("_b").agg(F.sum(size).alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    within = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(base, "_b")
    return x.withColumn(out, F.col("_base") + F.coalesce(F.sum(size).over(within), F.lit(0))).drop("_b", "_base")


def stream_windows(df: DataFrame, order: str, tokens: str, size: int) -> DataFrame:
    """All sequences one behind the other, cut into windows of size tokens; the rest at the end is dropped."""
    x = running(df.select(order, tokens).where(F.size(tokens) > 0).withColumn("n", F.size(tokens).cast("long")), order, "n", "start")
    window = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size))).alias("window")
    x = x.select(tokens, "start", "n", window)
    # the part of the sequence in each window it touches: slices are shuffled, not tokens
    first, last = F.greatest(F.col("start"), F.col("window") * size), F.least(F.col("start") + F.col("n"), (F.col("window") + 1) * size)
    part = x.select("window", first.alias("at"), F.slice(tokens, (first - F.col("start") + 1).cast("int"), (last - first).cast("int")).alias("part"))
    w = part.groupBy("window").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda y: y["part"])).alias("ids"))
    return w.where(F.size("ids") == size)


def padded(tokens, size: int, pad: int = 0):
    """One window, cut or padded."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(pad), size)), 1, size)


def shifted_targets(ids, n_prompt):
    """The next token where it is supervised, else -1; the last has none."""
    return F.transform(ids, lambda _, k: F.when((k + 1 >= n_prompt) & (k + 1 < F.size(ids)), F.get(ids, k + 1)).otherwise(-1))


def greedy_paragraphs(df: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Paragraphs of a text are put together until the next would pass the limit: a fold over each text's rows."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pack, used, out = 0, 0, []
        for n in pdf[size]:
            if used and used + n > limit:
                pack, used = pack + 1, 0
            used += n
            out.append(pack)
        return pdf.assign(pack=out)[[key, order, size, "pack"]]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, {size} {kinds[size]}, pack long")
