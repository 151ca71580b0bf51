"""ST1-ST4: keyed dialogue state, count-based style lifetime, incremental counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Answers that a style lasts.
STYLE_TURNS = 8


def turn(state: dict, text: str) -> dict:
    """ST2, ST3, F36: what a message does to the state: a style that lasts some answers, the topic last named, repeats and cancels."""
    t = (text or "").strip().lower()
    out = {"entity": state.get("entity"), "style": state.get("style"), "left": state.get("left", 0), "kind": "ask"}
    if t in ("again", "repeat", "repeat that"):
        out["kind"] = "repeat"
    elif t in ("cancel", "never mind", "stop"):
        out |= {"kind": "cancel", "entity": None}
    elif t.startswith(("uppercase", "echo", "spell")):
        out |= {"kind": "style", "style": t.split()[0].rstrip(":"), "left": STYLE_TURNS}
    names = [w for w in (text or "").split()[1:] if w[:1].isupper()]
    if names:
        out["entity"] = names[-1].strip("?!.,'\"")
    if out["kind"] != "style" and out["left"]:
        out["left"] -= 1
        if not out["left"]:
            out["style"] = None
    return out


SCHEMA = "session string, seq long, kind string, entity string, style string, style_left int"
STATE = "entity string, style string, style_left int"


def fold(messages: DataFrame) -> DataFrame:
    """Batch form: messages (session, seq, text) folded in order within each session (sessions are short)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = {}, []
        for r in pdf.sort_values("seq").itertuples():
            state = turn(state, r.text)
            rows.append((r.session, r.seq, state["kind"], state["entity"], state["style"], state["left"]))
        return pd.DataFrame(rows, columns=["session", "seq", "kind", "entity", "style", "style_left"])

    return messages.groupBy("session").applyInPandas(run, SCHEMA)


def stream(messages: DataFrame) -> DataFrame:
    """Streaming form with keyed state; the same rows as fold if messages come in order."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = dict(zip(("entity", "style", "left"), held.get)) if held.exists else {}
        pdf = pd.concat(list(pdfs))
        rows = []
        for r in pdf.sort_values("seq").itertuples():
            state = turn(state, r.text)
            rows.append((key[0], r.seq, state["kind"], state["entity"], state["style"], state["left"]))
        held.update((state["entity"], state["style"], state["left"]))
        yield pd.DataFrame(rows, columns=["session", "seq", "kind", "entity", "style", "style_left"])

    return messages.groupBy("session").applyInPandasWithState(run, SCHEMA, STATE, "append", "NoTimeout")


def incremental_counts(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> None:
    """ST4, K8: counts what has come since the last run; each input row once.

    A batch writes only the keys it changed, with their counts so far, into its own folder; a batch that
    is run again overwrites the same folder. latest() reads the table.
    """
    read = spark.readStream.schema(schema).parquet(source)
    day = F.to_date(F.col("ts").cast("timestamp"))
    q = (
        read.groupBy("event_type", day.alias("day")).agg(F.count("*").alias("n"))
        .writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{target}/batch={k}"))
        .start()
    )
    q.awaitTermination()


def latest(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last state of each key that incremental_counts wrote."""
    x = spark.read.option("basePath", target).parquet(target)
    cols = [c for c in x.columns if c not in (*keys, "batch")]
    return x.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("x")).select(*keys, "x.*")


def windowed(events: DataFrame) -> DataFrame:
    """Counts by ten minutes of event time; later than an hour is dropped in a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", "1 hour")
    return e.groupBy(F.window("ts", "10 minutes"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start_us"), "event_type", "n")
