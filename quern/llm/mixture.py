"""Problem 6: mixes of sources by target weights, with capped repeats."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kit import cut, table
from .overlap import source_name
from .subjects import Batch, Model, model_of, shares
from .tokens import encoder_of

#: Languages that are raked; others count as one.
LANGS = ("en", "de", "es", "fr")
#: Rounds of fitting end when no factor changes by more than this share, or after ROUNDS.
ROUNDS, SETTLED = 1000, 1e-7
#: Levels of the sampling key, and steps of each: the tokens of a cell are counted by the steps of one level at a time.
LEVELS, STEPS = 3, 64


def sized(docs: DataFrame, model: Model | None, vocab: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of each document: one pass, no shuffle.

    topic is the subject of most sentences. Null and empty texts have no tokens.
    """
    of, known = encoder_of(docs.sparkSession, vocab), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        enc, m = of(), known.value
        own = m.classifier() if m else None
        for b in batches:
            texts = b.column(3).to_pylist()
            topic = ["none"] * len(texts)
            if m:
                for x in range(0, len(texts), 2000):
                    part = Batch(texts[x : x + 2000])
                    s = shares(own.posteriors(part), part)[:, 1:]
                    for r in np.nonzero(s.max(axis=1, initial=0) > 0)[0]:
                        topic[x + r] = m.names[s[r].argmax()]
            n = [len(enc.encode(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(topic), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "topic", "tokens"])

    lang = F.lower(F.trim("lang"))
    return docs.select(F.col("doc_id").cast("long"), source_name("source").alias("source"), F.when(lang.isin(*LANGS), lang).otherwise("other").alias("lang"), "text").mapInArrow(
        run, "doc_id long, source string, lang string, topic string, tokens long"
    )


def rake(have: np.ndarray, source: np.ndarray, lang: np.ndarray, topic: np.ndarray, share: np.ndarray, cap: np.ndarray, corpus: float) -> tuple[np.ndarray, float]:
    """Factors of use of each cell (have tokens, of a source, language and topic) and the mix's size.

    Iterative proportional fitting to the languages' and topics' shares of the chosen sources, then
    to the sources' targets, no factor above its source's cap. Sources come last, so their targets
    are met; languages and topics as near as those allow. A source without tokens is left out and
    the other shares are scaled up. The size is the corpus's, or what the tightest cap allows.
    """
    avail = np.bincount(source, have, len(share))
    share = np.where(avail > 0, share, 0)
    if share.sum() == 0:
        return np.zeros(len(have)), 0.0
    share = share / share.sum()
    size = min([corpus, *(avail[s] * cap[s] / share[s] for s in np.nonzero(share)[0])])
    w = (size * share / np.maximum(avail, 1))[source]
    limit = cap[source].astype(float)
    inside = share[source] > 0
    for _ in range(ROUNDS):
        old = w
        for key in (lang, topic):
            target = np.bincount(key, have * inside) * size / max(1.0, (have * inside).sum())
            now = np.bincount(key, have * w)
            w = w * np.where(now > 0, target / np.maximum(now, 1e-9), 1)[key] ** 0.5
        w = _to_sources(w, have, source, size * share, limit)
        if np.abs(w - old).max(initial=0) <= SETTLED * max(1e-9, w.max(initial=0)):
            break
    return w, size


def _to_sources(w, have, source, target, limit):
    w = np.minimum(w, limit)
    for _ in range(30):
        free = w < limit - 1e-12
        now = np.bincount(source, have * w, len(target))
        open_ = np.bincount(source, have * w * free, len(target))
        if np.abs(now - target).max() <= 1e-9 * max(1.0, target.max()):
            break
        scale = np.where(open_ > 0, (target - (now - open_)) / np.maximum(open_, 1e-9), 1)
        w = np.minimum(np.where(free, w * np.maximum(scale, 0)[source], w), limit)
    return w


def mixes(docs: DataFrame, plan: DataFrame, model: Model | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents used, lines of the plan, marginals.

    (mix, doc_id, source, lang, topic, tokens, uses) of the documents used; (mix, source, target_share, reachable_share,
    max_repeat, size, corpus) of the plan; (mix, kind, value, target_share, fitted_share) of sources, languages and topics.
    The plan is small and its cells (mix, source, language, topic) are bounded by it, so the fitting
    runs on the driver; documents never leave their tasks but for counts by cell and step of the sampling
    key. Of each cell a share of the tokens is drawn, in the order of the key, so that languages and topics
    keep to the fitted marginals as well. Documents without tokens are never used; an empty plan gives no row.
    """
    spark = docs.sparkSession
    rows = cut(sized(docs, model), "mix")
    lines = plan.where("mix is not null and target_share > 0").groupBy("mix", source_name("source").alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeat").alias("cap")).orderBy("mix", "source").collect()
    chosen = sorted({r["source"] for r in lines})
    corpus = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    cells = rows.where(F.col("source").isin(chosen) & (F.col("tokens") > 0)).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("n")).orderBy("source", "lang", "topic").collect()
    factors, report, margins = [], [], []
    for mix in sorted({r["mix"] for r in lines}):
        own = {r["source"]: (r["share"], max(0, r["cap"] or 0)) for r in lines if r["mix"] == mix}
        part = [c for c in cells if c["source"] in own]
        names, langs, topics = sorted(own), sorted({c["lang"] for c in part}), sorted({c["topic"] for c in part})
        at = lambda xs, key, part=part: np.array([xs.index(c[key]) for c in part], np.int64)
        share, cap = np.array([own[s][0] for s in names]), np.array([own[s][1] for s in names])
        have = np.array([c["n"] for c in part], float)
        w, size = rake(have, at(names, "source"), at(langs, "lang"), at(topics, "topic"), share, cap, float(corpus)) if part else (np.zeros(0), 0.0)
        whole = np.floor(w + 1e-9)
        factors += [(mix, c["source"], c["lang"], c["topic"], int(f), float(max(0.0, x - f)), float(max(0.0, x - f) * c["n"])) for c, x, f in zip(part, w, whole)]
        left = sum(own[s][0] for s in {c["source"] for c in part})
        reachable = {s: own[s][0] / left if any(c["source"] == s for c in part) else 0.0 for s in names}
        report += [(mix, s, own[s][0], reachable[s], own[s][1], float(size), int(corpus)) for s in names]
        total = max(1.0, (have * w).sum())
        margins += [(mix, "source", s, reachable[s], float((have * w)[at(names, "source") == i].sum() / total)) for i, s in enumerate(names)] if part else []
        for kind, values in (("lang", langs), ("topic", topics)):
            margins += [(mix, kind, v, float(have[at(values, kind) == i].sum() / have.sum()), float((have * w)[at(values, kind) == i].sum() / total)) for i, v in enumerate(values)]
    used = _drawn(rows, factors, seed).select("mix", "doc_id", "source", "lang", "topic", "tokens", "uses").where("uses > 0")
    kinds = "mix string, source string, target_share double, reachable_share double, max_repeat int, size double, corpus long"
    return used, spark.createDataFrame(report, kinds), spark.createDataFrame(margins, "mix string, kind string, value string, target_share double, fitted_share double")


def _drawn(rows: DataFrame, factors: list[tuple], seed: int) -> DataFrame:
    """rows with uses, by the factors (mix, source, lang, topic, whole, part, wanted tokens of the part) of the cells.

    A hash orders the documents of a cell; from the least key on they are used once more until the
    wanted tokens are reached. The step of the key where that happens is found level by level, from
    counts by cell and step; only the documents of that last step, a STEPS ** LEVELS-th of a cell,
    are put in order, each cell's rounding carried to the next cell of the source.
    """
    spark, bits = rows.sparkSession, (STEPS - 1).bit_length()
    kind = "mix string, source string, lang string, topic string, whole int, part double, wanted double, cell int"
    table_ = F.broadcast(spark.createDataFrame([(*f, i) for i, f in enumerate(factors)], kind))  # bounded: lines of the plan x languages x topics
    key = F.pmod(F.xxhash64("doc_id", "mix", F.lit(seed)), F.lit(STEPS**LEVELS))
    used = rows.where("tokens > 0").join(table_, ["source", "lang", "topic"]).withColumn("key", key)
    # the prefix of the key at which each cell's wanted tokens are reached, and what is left there
    edge = {i: (0, f[6]) for i, f in enumerate(factors) if f[6] > 0}
    for level in range(LEVELS):
        shift = bits * (LEVELS - 1 - level)
        at = F.broadcast(spark.createDataFrame([(i, p) for i, (p, _) in edge.items()], "cell int, prefix long"))
        inside = used.join(at, "cell").where(F.shiftright("key", shift + bits) == F.col("prefix"))
        counted: dict[int, list[tuple[int, int]]] = {}
        for r in inside.groupBy("cell", F.shiftright("key", shift).alias("step")).agg(F.sum("tokens").alias("n")).collect():
            counted.setdefault(r["cell"], []).append((r["step"], r["n"]))
        found = {}
        for i, (p, want) in edge.items():
            for step, n in sorted(counted.get(i, [])):
                if n >= want:
                    found[i] = (step, want)
                    break
                want -= n
            else:
                found[i] = ((p + 1) * STEPS, 0.0)  # all of it
        edge = found
    at = F.broadcast(spark.createDataFrame([(i, p, w) for i, (p, w) in edge.items()], "cell int, edge long, left_over double"))
    used = used.join(at, "cell", "left")
    sure = used.where("edge is null or key <> edge").withColumn("more", F.when(F.col("key") < F.col("edge"), 1).otherwise(0))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, more, carry = pdf.sort_values(["cell", "doc_id"]), [], 0.0
        for _, own in pdf.groupby("cell", sort=True):
            want = carry + float(own["left_over"].iloc[0])
            for n in own["tokens"].tolist():
                take = n / 2 <= want
                more.append(int(take))
                want -= n * take
            carry = want
        return pdf.assign(more=more)[["mix", "doc_id", "more"]]

    few = used.where("key = edge").select("mix", "source", "cell", "doc_id", "tokens", "left_over")
    few = few.groupBy("mix", "source").applyInPandas(last, "mix string, doc_id long, more int")
    tail = used.where("key = edge").join(few, ["mix", "doc_id"])
    return sure.unionByName(tail.select(*sure.columns)).withColumn("uses", (F.col("whole") + F.col("more")).cast("int"))


def p6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = mixes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plan"), model_of(spark, sf_dir))[0]
    return used.select("mix", "doc_id", "source", "tokens", "uses")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned and the actual share of each source in each mix, by tokens."""
    used, plan, _ = mixes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plan"), model_of(spark, sf_dir))
    got = used.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    total = Window.partitionBy("mix")
    none = F.lit(0).cast("long")
    out = plan.join(F.broadcast(got), ["mix", "source"], "left").select("mix", "source", "target_share", "reachable_share", "max_repeat", F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("documents", none).alias("documents"), F.coalesce("tokens", none).alias("tokens"), "corpus")
    return out.withColumn("actual_share", F.col("tokens") / F.greatest(F.sum("tokens").over(total), F.lit(1)))


def p6_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each mix's sources, languages and topics: the share aimed at, the fitted one, the actual one, and what is left between first and last."""
    used, _, margins = mixes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plan"), model_of(spark, sf_dir))
    cells = used.groupBy("mix", "source", "lang", "topic").agg(F.sum(F.col("tokens") * F.col("uses")).alias("n"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("source", "lang", "topic")])).alias("m")
    got = cells.select("mix", kinds, "n").groupBy("mix", "m.kind", "m.value").agg(F.sum("n").alias("tokens"))
    got = got.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("mix", "kind"))).drop("tokens")
    out = margins.join(F.broadcast(got), ["mix", "kind", "value"], "left").withColumn("actual_share", F.coalesce("actual_share", F.lit(0.0)))
    return out.withColumn("residual", F.col("actual_share") - F.col("target_share"))
