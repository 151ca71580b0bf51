"""Problem 7: the subjects that a document's sentences are about."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kit import mix64, table, visible

#: Buckets of the hashed words and word pairs; bounds the model.
BUCKETS = 1 << 18
#: Labelled documents that the first model is trained on, about, by hash of the id.
LABELLED = 20_000
#: Steps over all documents after that, and the weight of all they count against the labelled ones.
STEPS, UNLABELLED = 1, 0.5
#: Smoothing: the share of all counts, and the count, that each class gets of every feature.
SHRINK, ALPHA = 0.25, 0.5
#: Weight of a sentence's evidence, and the evidence that it must have to be about a subject at all.
POWER, EVIDENCE = 0.6, 8.0
#: Both for the steps on labelled documents: soft, so that sentences which any document may have
#: spread over all classes, and at first each sentence has a subject.
FIRST = ((0.1, -99.0), (0.15, 1.0), (0.2, 2.0), (0.3, 3.0))
#: Largest factor that evens out subjects in a language.
EVEN = 8.0
#: A sentence counts for a class in a step over all documents from this probability on.
SURE = 0.9
#: A document needs about this share of its sentences for a subject: the prior mean of each subject's calibrated
#: threshold, its prior's deviation, and the prior slope of the posterior's logistic curve.
SHARE, SPREAD, SLOPE = 0.18, 0.02, 40.0

_MARKUP = re.compile(r"<ref[^<>]*>.*?</ref>|<[^<>]{1,200}>|\{\{[^{}]*\}\}|'''?|\[\[|\]\]|^==.*?==\s*$", re.S | re.M)
_ROLE = re.compile(r"^\s*(?:[*#>-]+\s+)?(?:[A-Za-z]{1,10}:\s+)?")
_END = re.compile(r"(?<=[.!?。])[\"')\]]*\s+|\n+")
# Signs of code, the keywords and commands that begin its lines, and the least share of signs to words.
_SIGNS, CODE = re.compile(r"[=|;{}\\<>+*()\[\]_]"), 0.34
_LINE = re.compile(r"^\s*(?:import|from|def|return|for|while|if|ls|cp|mv|cd|grep|cat|head|tail|echo|chmod)\b(?!.*[.?!]$)")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[list[str]]:
    """The words of each natural sentence: markup, speakers' names, code lines and headings left out.

    Less than three words belong to the next sentence, or else to the one before.
    """
    out: list[list[str]] = []
    short: list[str] = []
    for part in _END.split(_MARKUP.sub(" ", visible(text))):
        part = _ROLE.sub("", part)
        ws = _WORD.findall(part.lower())
        if not ws or len(_SIGNS.findall(part)) >= CODE * len(ws) or _LINE.search(part):
            continue
        if len(ws) + len(short) > 2:
            out.append(short + ws)
            short = []
        else:
            short = short + ws
    if short:
        if out:
            out[-1] = out[-1] + short
        else:
            out.append(short)
    return out


class _Hashes(dict):
    """Bucket hashes of words, each computed once."""

    MOST = 400_000

    def __missing__(self, w: str) -> int:
        v = self[w] = crc32(w.encode("utf-8", "replace"))
        return v


_HASHES = _Hashes()


class Batch:
    """Sentences of many texts as flat arrays: of each its hashed words and word pairs, each once."""

    def __init__(self, texts: list[str | None]):
        words: list[str] = []
        of_word: list[int] = []
        doc: list[int] = []
        for d, t in enumerate(texts):
            for ws in sentences(t) if t else []:
                words += ws
                of_word.append(len(ws))
                doc.append(d)
        if len(_HASHES) > _Hashes.MOST:
            _HASHES.clear()
        h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
        row = np.repeat(np.arange(len(of_word)), of_word)
        inner = np.nonzero(row[1:] == row[:-1])[0] if len(row) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            pair = mix64(h[inner] * np.uint64(0x9E3779B1) + h[inner + 1])
        key = np.concatenate([row.astype(np.uint64) << np.uint64(18) | h & np.uint64(BUCKETS - 1), row[inner].astype(np.uint64) << np.uint64(18) | pair & np.uint64(BUCKETS - 1)])
        key.sort()  # np.unique hashes, which takes three times as long
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        self.flat = (key & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.size = np.bincount((key >> np.uint64(18)).astype(np.int64), minlength=len(of_word))
        self.start = np.cumsum(self.size) - self.size
        self.doc = np.array(doc, np.int64)
        self.n_docs = len(texts)


class Complement:
    """Complement naive Bayes of the classes 0 (no subject) and 1.. from soft counts (BUCKETS x classes)."""

    def __init__(self, counts: np.ndarray):
        total = counts.sum(axis=1, keepdims=True)
        part = (counts.sum(axis=0) / max(1.0, counts.sum())).clip(1e-6, 1 - 1e-6)
        even = SHRINK * total + ALPHA
        weight = np.log(counts / part + even) - np.log((total - counts) / (1 - part) + even)
        self.weight = weight.astype(np.float32)

    def scores(self, b: Batch, evidence: float) -> np.ndarray:
        s = np.add.reduceat(self.weight[b.flat], b.start, axis=0) if len(b.flat) else np.zeros((0, self.weight.shape[1]), np.float32)
        s[:, 0] = evidence
        return s

    def posteriors(self, b: Batch, power: float = POWER, evidence: float = EVIDENCE, allowed: np.ndarray | None = None, mixed: int = 2) -> np.ndarray:
        """Of each sentence: its evidence, then again with the document's mixture as prior."""
        s = self.scores(b, evidence) * power
        if not len(s):
            return s
        if allowed is not None:
            s = s + np.log(allowed[b.doc])
        p = _softmax(s)
        for _ in range(mixed):
            mix = np.full((b.n_docs, s.shape[1]), 0.3)
            np.add.at(mix, b.doc, p)
            mix /= mix.sum(axis=1, keepdims=True)
            p = _softmax(s + np.log(mix[b.doc]))
        return p


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def shares(p: np.ndarray, b: Batch) -> np.ndarray:
    """Of each document: the share of its sentences about each class."""
    out = np.zeros((b.n_docs, p.shape[1]))
    n = np.zeros(b.n_docs)
    np.add.at(out, b.doc, (p > 0.5).astype(float))
    np.add.at(n, b.doc, 1)
    return out / np.maximum(n, 1)[:, None]


def first_model(texts: list[str], marks: np.ndarray, langs: list[str | None]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Counts from labelled documents, and each language's factors. marks (documents x classes): how
    likely the annotators' labels make each class; which sentence is about which of them is told by
    expectation-maximization."""
    b = Batch(texts)
    allowed = np.maximum(marks, 0.02)
    given = marks.copy()
    given[:, 0] = np.where(marks[:, 1:].any(axis=1), 0.0, 1.0)
    p = (given / given.sum(axis=1, keepdims=True))[b.doc]
    for power, evidence in FIRST:
        p = Complement(_count(b, p * _factors_of(b, langs, factors(b, p, langs)))).posteriors(b, power, evidence, allowed, 1)
    even = factors(b, p, langs)
    return _count(b, p * _factors_of(b, langs, even)), even


def factors(b: Batch, p: np.ndarray, langs: list[str | None]) -> dict[str, np.ndarray]:
    """By language: weights that give all subjects the same mass of sentences in it, within bounds.

    Else the words that all subjects share in a language would speak for those that are rarer in others.
    """
    out = {}
    key = np.array([x or "" for x in langs])[b.doc] if len(b.doc) else np.zeros(0, str)
    for lang in sorted(set(key.tolist())):
        mass = p[key == lang].sum(axis=0)
        f = np.ones(len(mass))
        f[1:] = (mass[1:].mean() / np.maximum(mass[1:], 1e-9)).clip(1 / EVEN, EVEN)
        out[lang] = f
    return out


def _factors_of(b: Batch, langs: list[str | None], even: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each sentence; languages without factors have ones."""
    if not even:
        return np.ones((len(b.doc), 1))
    names = sorted(even)
    at = {x: i for i, x in enumerate(names)}
    rows = np.stack([*(even[x] for x in names), np.ones(len(even[names[0]]))])
    return rows[np.array([at.get(x or "", len(names)) for x in langs], np.int64)[b.doc]]


def _count(b: Batch, p: np.ndarray) -> np.ndarray:
    counts = np.zeros((BUCKETS, p.shape[1]))
    row = np.repeat(np.arange(len(b.size)), b.size)
    for c in range(p.shape[1]):
        counts[:, c] = np.bincount(b.flat, p[row, c], minlength=BUCKETS)
    return counts


def _count_sure(b: Batch, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Counts of the sentences that are about one class with probability SURE."""
    best = p.argmax(axis=1)
    sure = np.take_along_axis(p, best[:, None], 1)[:, 0]
    w = np.where(sure >= SURE, sure * (weight[np.arange(len(p)), best] if weight.shape[1] > 1 else 1), 0.0)
    row = np.repeat(np.arange(len(b.size)), b.size)
    inside = w[row] > 0
    row, flat = row[inside], b.flat[inside]
    return np.bincount(flat * p.shape[1] + best[row], w[row], BUCKETS * p.shape[1]).reshape(BUCKETS, -1)


def marks_of(rows: list[tuple[int, list[int]]], k: int) -> np.ndarray:
    """Share of a document's annotators (who, how many gave each subject) for each class; no subject is always possible."""
    out = np.zeros((len(rows), k))
    for r, (who, given) in enumerate(rows):
        out[r, 1:] = np.array(given) / max(1, who)
    out[:, 0] = 0.3
    return out


def _cells(counts: np.ndarray) -> pa.RecordBatch:
    cell = np.nonzero(counts.ravel() > 0.05)[0]
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts.ravel()[cell])], names=["cell", "n"])


def _dense(cells: pa.Table, classes: int) -> np.ndarray:
    flat = np.zeros(BUCKETS * classes)
    flat[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return flat.reshape(BUCKETS, classes)


class Model:
    """names, counts, and (threshold, slope) of each subject's posterior."""

    def __init__(self, names: list[str], counts: np.ndarray, need: np.ndarray):
        self.names, self.counts, self.need = names, counts.astype(np.float32), need

    def classifier(self) -> Complement:
        return Complement(self.counts)


def train(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> Model:
    """docs (doc_id, text, lang), labels (doc_id, subject, annotator), subjects (subject).

    A bounded sample of labelled documents (whole texts) trains the first model in one task; the
    steps of expectation and maximization count the sentences of all documents. Labels of unknown
    subjects, of unknown documents and repeated ones don't count; without labels nothing has a subject.
    """
    names = sorted({r[0] for r in subjects.select("subject").where("subject is not null").collect()})
    k = len(names) + 1
    # Distinct subjects of each annotator, then how many annotators gave each: no list grows with a document's labels.
    known_names = F.array_intersect(F.collect_set("subject"), F.array(*map(F.lit, names)).cast("array<string>"))
    by_who = labels.where("doc_id is not null").groupBy("doc_id", F.coalesce("annotator", F.lit("")).alias("a")).agg(known_names.alias("ss"))
    by_doc = by_who.groupBy("doc_id").agg(F.count("*").alias("who"), F.array(*[F.sum(F.array_contains("ss", n).cast("long")) for n in names]).cast("array<long>").alias("given"))
    share = max(1, -(-by_doc.count() // LABELLED))
    sample = by_doc.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    sample = F.broadcast(sample) if share > 1 or sample.count() <= 2 * LABELLED else sample  # about LABELLED rows of fixed width
    docs = docs.select("doc_id", "text", F.lower(F.trim("lang")).alias("lang"))
    known = docs.where("text is not null").join(sample, "doc_id")

    def first(batches):
        texts, rows, langs = [], [], []
        for b in batches:
            for t, who, given, lang in zip(*(c.to_pylist() for c in b.columns)):
                rows.append((who, given))
                texts.append(t)
                langs.append(lang)
        if texts:
            total, even = first_model(texts, marks_of(rows, k), langs)
            cells = _cells(total)
            yield pa.RecordBatch.from_arrays([*cells.columns, pa.nulls(cells.num_rows, pa.string())], names=["cell", "n", "lang"])
            yield pa.RecordBatch.from_arrays([pa.array(list(range(k)) * len(even), pa.int64()), pa.array([float(x) for f in even.values() for x in f], pa.float64()), pa.array([x for x in even for _ in range(k)], pa.string())], names=["cell", "n", "lang"])

    got = known.select("text", "who", "given", "lang").repartition(1).mapInArrow(first, "cell long, n double, lang string").toArrow()
    counts = _dense(got.filter(pc.is_null(got["lang"])), k)
    even: dict[str, np.ndarray] = {}
    for r in got.filter(pc.is_valid(got["lang"])).to_pylist():
        even.setdefault(r["lang"], np.ones(k))[r["cell"]] = r["n"]
    base, spark = counts, docs.sparkSession
    for _ in range(STEPS):
        model = spark.sparkContext.broadcast(counts.astype(np.float32))

        def step(batches, model=model):
            own, total = Complement(model.value), np.zeros((BUCKETS, k))
            for b in batches:
                for x in range(0, b.num_rows, 2000):
                    part = Batch(b.column(0).slice(x, 2000).to_pylist())
                    if len(part.flat):
                        total += _count_sure(part, own.posteriors(part), _factors_of(part, b.column(1).slice(x, 2000).to_pylist(), even))
            yield _cells(total)

        more = _dense(docs.select("text", "lang").where("text is not null").mapInArrow(step, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow(), k)
        counts = base + more * (UNLABELLED * base.sum() / max(1.0, more.sum()))
        model.unpersist()
    model = spark.sparkContext.broadcast(counts.astype(np.float32))

    def seen(batches):
        own = Complement(model.value)
        for b in batches:
            part = Batch(b.column(0).to_pylist())
            x = shares(own.posteriors(part), part)[:, 1:]
            y = marks_of(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist())), k)[:, 1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(k - 1), len(x))), pa.array(x.ravel()), pa.array(y.ravel())], names=["subject", "share", "mark"])

    fit = known.select("text", "who", "given").mapInArrow(seen, "subject long, share double, mark double").toArrow()
    return Model(names, counts, calibrated(*(fit.column(i).to_numpy() for i in range(3)), k - 1))


def calibrated(subject: np.ndarray, share: np.ndarray, mark: np.ndarray, k: int) -> np.ndarray:
    """(threshold, slope) of each subject: its posterior given a share x of sentences is 1 / (1 + exp(-slope * (x - threshold))).

    Fitted to the annotators' marks of each subject by itself, by Newton's method, with a normal prior on both, so
    that few labels leave them where they were. Marks are first freed of the annotators' errors: the rates at which
    they miss and invent the subject, seen at documents that are clearly about it or not at all.
    """
    out = np.tile([SHARE, SLOPE], (k, 1))
    for c in range(k):
        x, y = share[subject == c], mark[subject == c]
        sure, none = x > 2.5 * SHARE, x == 0
        if sure.sum() < 5 or none.sum() < 5:
            continue
        low, high = y[none].mean(), y[sure].mean()
        if high - low < 0.2:
            continue
        y = ((y - low) / (high - low)).clip(0, 1)
        edge = (x > 0) & (x < 2.5 * SHARE)
        x, y = x[edge], y[edge]
        t, s = SHARE, SLOPE
        for _ in range(30):
            p = 1 / (1 + np.exp(-(s * (x - t)).clip(-30, 30)))
            v = p * (1 - p)
            grad = np.array([(s * (p - y)).sum() - (t - SHARE) / SPREAD**2, ((y - p) * (x - t)).sum() - (s - SLOPE) / SLOPE**2 * 4])
            h = np.array([[s * s * v.sum() + 1 / SPREAD**2, -(s * v * (x - t)).sum()], [-(s * v * (x - t)).sum(), (v * (x - t) ** 2).sum() + 4 / SLOPE**2]])
            step = np.linalg.solve(h, grad).clip([-0.02, -5], [0.02, 5])
            t, s = t + step[0], max(5.0, s + step[1])
        out[c] = t, s
    return out


def posteriors_of(x: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Of each document (shares of its sentences by subject): the subjects' posteriors, each by itself; none without sentences about it."""
    return np.where(x > 0, 1 / (1 + np.exp(-need[:, 1] * (x - need[:, 0]))), 0.0)


def assign(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject) for each subject of each document; null and blank texts have none. One pass."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = known.value
        own = m.classifier()
        for b in batches:
            ids, subject = [], []
            for x in range(0, b.num_rows, 2000):
                part = Batch(b.column(1).slice(x, 2000).to_pylist())
                r, c = np.nonzero(posteriors_of(shares(own.posteriors(part), part)[:, 1:], m.need) >= 0.5)
                ids += (r + x).tolist()
                subject += [m.names[i] for i in c]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(subject, pa.string())], names=["doc_id", "subject"])

    return docs.select("doc_id", "text").where("text is not null").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, subject string")


def model_of(spark: SparkSession, sf_dir: str) -> Model:
    return train(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), model_of(spark, sf_dir))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition of the corpus by subject."""
    return p7_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"))
