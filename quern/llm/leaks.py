"""Problem 3: evaluation texts in the training corpus, found through an FM-index of each shard."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .kit import INVISIBLE, table, visible
from .overlap import near

#: Words of a test phrase. A run of a dozen words with one in six wrong has four right ones in a row.
PHRASE = 4
#: A leak covers at least so many words of a test text; shorter prompts must stand there whole.
LEAST = 12
#: Share of the covered words that may be misspelt, changed, added or left out.
ERRORS = 1 / 6
#: Symbols of a shard that are indexed at once; bounds a task's memory.
SHARD = 3_000_000
#: Items of one block of phrases, and occurrences times uses that are looked at in one step; both bound memory.
BLOCK, STEP = 20_000, 1_000_000

# Markup, character references and escapes that stand for space.
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&(?:#\d{1,6}|#x[0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});|\\(?:[nrtvfb]|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2})")
_WORD = re.compile(r"[^\W_]+")


def _plain(text: str) -> str:
    if "<" in text or "&" in text or "\\" in text:
        text = _MARKUP.sub(lambda m: " " * len(m[0]), text)
    return text if text.isascii() else text.translate(INVISIBLE)


def tokens(text: str) -> list[str]:
    return _WORD.findall(_plain(text).lower())


def offsets(text: str) -> list[tuple[int, int]]:
    """Begin and end of each of the tokens in the text itself."""
    plain = _plain(text)
    low = plain.lower()
    if len(low) != len(plain):
        low = "".join(c.lower()[:1] for c in plain)
    seen = [i for i, c in enumerate(text) if ord(c) not in INVISIBLE] if len(plain) != len(text) else range(len(text))
    return [(seen[m.start()], seen[m.end() - 1] + 1) for m in _WORD.finditer(low)]


class Vocabulary:
    """Numbers from 1 on for the words of all evaluation items, so that one index serves all blocks of items."""

    def __init__(self):
        self.words, self.number = [""], {}

    def numbers(self, ws: list[str]) -> list[int]:
        for w in ws:
            if w not in self.number:
                self.number[w] = len(self.words)
                self.words.append(w)
        return [self.number[w] for w in ws]


def phrase_size(n: int) -> int:
    """Words that surely stand unchanged in a row in a leak of a test text of n words."""
    return min(n, PHRASE) if n < 6 or n >= LEAST else min(PHRASE, (n - 1) // 2)


class Tests:
    """Sides (prompt or answer) and phrases of a block of evaluation items (id, prompt, answer).

    A prompt of any length counts, an answer from LEAST words on.
    """

    def __init__(self, items, vocabulary: Vocabulary):
        self.ids, self.owner, sides = [r[0] for r in items], [], []
        for k, r in enumerate(items):
            for text, least in ((r[1], 1), (r[2], LEAST)):
                ws = tokens(text) if text else []
                if len(ws) >= least:
                    self.owner.append(k)
                    sides.append(vocabulary.numbers(ws))
        self.size = np.array([len(x) for x in sides], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.array([x for s in sides for x in s], np.int32)
        self.phrase = np.array([phrase_size(n) for n in self.size.tolist()], np.int64)
        self.by_size = []
        for size in sorted(set(self.phrase.tolist())):
            seen: dict[tuple[int, ...], list[tuple[int, int]]] = {}
            for s in np.nonzero(self.phrase == size)[0].tolist():
                for i in range(len(sides[s]) - size + 1):
                    seen.setdefault(tuple(sides[s][i : i + size]), []).append((s, i))
            uses = list(seen.values())
            count = np.array([len(u) for u in uses], np.int64)
            flat = np.array([x for u in uses for x in u], np.int64)
            self.by_size.append((np.array(list(seen), np.int64), np.cumsum(count) - count, count, flat[:, 0], flat[:, 1]))
        self.run = int(self.phrase.min()) if sides else PHRASE

    def side(self, s: int) -> np.ndarray:
        return self.flat[self.start[s] : self.start[s] + self.size[s]]

    def promising(self, ids: np.ndarray, where: np.ndarray, side: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Of phrases found at where in the texts' numbers, for a place of a side each: can a leak go on from there?

        Words of the side around the phrase that stand in the text near their place are counted.
        """
        n, first = self.size[side], self.start[side]
        whole = n < LEAST
        seen = np.zeros(len(where), np.int32)
        for o in (*range(size - LEAST, 0), *range(size, LEAST)):
            i = at + o
            inside = (i >= 0) & (i < n)
            word = np.where(inside, self.flat[np.where(inside, first + i, 0)], -1)
            hit = np.zeros(len(where), bool)
            for d in (0, 1, -1, 2, -2):
                j = where + o + d
                hit |= (ids[np.clip(j, 0, len(ids) - 1)] == word) & (j >= 0) & (j < len(ids))
            seen += hit
        return seen + size >= np.where(whole, n - (n * ERRORS + 1e-9).astype(np.int64), LEAST - int(LEAST * ERRORS))


def extend(ws: list[str], j: int, test: list[str], i: int, step: int) -> list[tuple[int, int, int]]:
    """From ws[j] and test[i] on in the direction of step: (errors, place in ws, place in test) of each word that matches.

    The first is where it began. Words may be changed, added or left out, and misspelt, split or run
    together; each of these is an error. It ends where changed words prevail.
    """
    errors = score = best = 0
    out = [(0, j - step, i - step)]
    nj, ni = (len(ws), len(test)) if step > 0 else (-1, -1)
    left = lambda a, end: a != end
    while left(j, nj) and left(i, ni):
        w, t = ws[j], test[i]
        nw, nt = ws[j + step] if left(j + step, nj) else None, test[i + step] if left(i + step, ni) else None
        if w == t:
            score += 1
        elif near(w, t):
            errors += 1
        elif nw is not None and (w + nw if step > 0 else nw + w) == t:
            errors, j = errors + 1, j + step
        elif nt is not None and (t + nt if step > 0 else nt + t) == w:
            errors, i = errors + 1, i + step
        else:
            errors, score = errors + 1, score - 2
            if score < best - 8:
                break
            if nw is not None and nw == nt:
                j, i = j + step, i + step
            elif nw is not None and nw == t:
                j += step
            elif nt is not None and w == nt:
                i += step
            else:
                j, i = j + step, i + step
            continue
        best = max(best, score)
        out.append((errors, j, i))
        j, i = j + step, i + step
    return out


def leaked(ws: list[str], test: list[str], hits: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """First and last word of each maximal leak of test in ws that goes on from one of the hits (place in ws, in test).

    A leak covers LEAST words of test, or all of a shorter one, with at most a share of ERRORS. Where
    a run is short by that, its next words in test may be the changed ones.
    """
    found: list[tuple[int, int, int, int]] = []
    need = min(LEAST, len(test))
    for j, i in sorted(hits):
        if any(a <= j <= b and c - 3 <= j - i <= d + 3 for a, b, c, d in found):
            continue
        right, left = extend(ws, j + size, test, i + size, 1), extend(ws, j - 1, test, i - 1, -1)
        top = None
        for e1, j1, i1 in right:
            for e0, j0, i0 in left:
                span = i1 - i0 + 1
                beyond = max(0, need - span)  # words of test at the ends that were changed
                if span + beyond > len(test) or e0 + e1 + beyond > ERRORS * max(span, need) + 1e-9:
                    continue
                if top is None or (span - e0 - e1, j1 - j0) > top[0]:
                    top = ((span - e0 - e1, j1 - j0), (j0, j1, j0 - i0, j1 - i1))
        if top:
            a, b, x, y = top[1]
            found.append((a, b, min(x, y), max(x, y)))
    spans = sorted({(a, b) for a, b, *_ in found}, key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def search(texts: list[str], vocabulary: Vocabulary, blocks) -> list[tuple[str, int, int, int]]:
    """(id of the item, number of the text, first word, last word) of every leak. blocks: Tests of that vocabulary.

    Words that no test has stand for separators, and runs of test words too short for any phrase
    are left out of the index: nothing can be found there. One index serves all blocks.
    """
    get, parts = vocabulary.number.get, []
    for t in texts:
        parts.append([get(w, 0) for w in tokens(t)])
        parts[-1].append(0)
    blocks = [t for t in blocks if len(t.size)]
    if not parts or not blocks:
        return []
    sizes = np.array([len(p) for p in parts], np.int64)
    ids = np.fromiter((x for p in parts for x in p), np.int32, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    zero = np.nonzero(ids == 0)[0]
    length = np.diff(zero, prepend=-1) - 1
    keep = np.zeros(len(ids) + 1, np.int32)
    long = length >= min(t.run for t in blocks)
    np.add.at(keep, zero[long] - length[long], 1)
    np.add.at(keep, zero[long] + 1, -1)
    place = np.nonzero(np.cumsum(keep[:-1]) > 0)[0]
    if not len(place):
        return []
    index = FMIndex(ids[place].astype(np.int64), len(vocabulary.words) - 1)
    cache: dict[int, list[str]] = {}
    out = []
    for tests in blocks:
        out += _search_block(tests, index, place, ids, begin, texts, vocabulary, cache)
    return out


def _search_block(tests: Tests, index: FMIndex, place, ids, begin, texts, vocabulary, cache) -> list[tuple[str, int, int, int]]:
    got = []
    for phrases, first, count, side, at in tests.by_size:
        size = phrases.shape[1]
        lo, hi = index.search(phrases)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        where = place[index.locate(rows)]
        uses = count[which]
        step = (np.cumsum(uses) - uses) // STEP  # a phrase of many places and items is looked at in many steps
        for k in np.unique(step).tolist():
            part = step == k
            u, w = uses[part], which[part]
            pick = np.repeat(first[w] - np.cumsum(u) + u, u) + np.arange(u.sum())
            p, s, i = np.repeat(where[part], u), side[pick], at[pick]
            # the hits of one run of right words: only the first of them
            order = np.lexsort((p, p - i, s))
            p, s, i = p[order], s[order], i[order]
            new = np.ones(len(p), bool)
            new[1:] = (s[1:] != s[:-1]) | (p[1:] - i[1:] != p[:-1] - i[:-1]) | (p[1:] != p[:-1] + 1)
            p, s, i = p[new], s[new], i[new]
            ok = tests.promising(ids, p, s, i, size)
            p, s, i = p[ok], s[ok], i[ok]
            text = np.searchsorted(begin, p, side="right") - 1
            got.append(np.stack([text, s, p - begin[text], i]))
    hit = np.concatenate([np.zeros((4, 0), np.int64), *got], axis=1)
    hit = hit[:, np.lexsort((hit[2], hit[1], hit[0]))]
    if not hit.shape[1]:
        return []
    cuts = np.concatenate([[0], np.nonzero((hit[0, 1:] != hit[0, :-1]) | (hit[1, 1:] != hit[1, :-1]))[0] + 1, [hit.shape[1]]])
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        t, s = int(hit[0, a]), int(hit[1, a])
        if t not in cache:
            cache.clear()  # texts come in order
            cache[t] = tokens(texts[t])
        test = [vocabulary.words[x] for x in tests.side(s).tolist()]
        for span in leaked(cache[t], test, list(zip(hit[2, a:b].tolist(), hit[3, a:b].tolist())), int(tests.phrase[s])):
            out.append((tests.ids[tests.owner[s]], t, *span))
    return out


def leaks(items: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(corpus, record_id, field, item_id, begin, end) of every leak in texts (corpus, record_id, field, text).

    begin and end are places in the text as it is; each maximal occurrence gives a row. Items (id,
    prompt, answer) go to the workers in blocks of bounded size; each task indexes its texts shard
    by shard, once for all blocks, so nothing is shuffled and the corpus is read once. Null and empty
    texts and items leak nothing; repeated texts are each found.
    """
    spark = items.sparkSession
    items = items.select(F.col("id").cast("string"), "prompt", "answer").where("id is not null")
    vocabulary, blocks, part = Vocabulary(), [], []
    for row in items.toLocalIterator():
        part.append(tuple(row))
        if len(part) == block:
            blocks.append(spark.sparkContext.broadcast(Tests(part, vocabulary)))
            part = []
    blocks.append(spark.sparkContext.broadcast(Tests(part, vocabulary)))
    known = spark.sparkContext.broadcast(vocabulary)
    return texts.select("corpus", F.col("record_id").cast("long"), "field", "text").where("text is not null and text <> ''").mapInArrow(_scan(known, blocks), "corpus string, record_id long, field string, item_id string, begin int, end int")


def _scan(known, blocks):
    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += (b.column(3).nbytes or 0) // 6
            if size >= SHARD:
                yield _found(held, known.value, [t.value for t in blocks])
                held, size = [], 0
        if held:
            yield _found(held, known.value, [t.value for t in blocks])

    return run


def _found(held, vocabulary: Vocabulary, blocks: list[Tests]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    texts = t.column(3).to_pylist()
    hits = search(texts, vocabulary, blocks)
    rows = t.take(pa.array([h[1] for h in hits], pa.int64())).combine_chunks()
    begin, end = [], []
    for _, k, a, b in hits:
        at = offsets(texts[k])
        begin.append(at[a][0]), end.append(at[b][1])
    column = lambda i, kind: pa.array(rows.column(i).to_pylist(), kind)
    return pa.RecordBatch.from_arrays(
        [column(0, pa.string()), column(1, pa.int64()), column(2, pa.string()), pa.array([h[0] for h in hits], pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())],
        names=["corpus", "record_id", "field", "item_id", "begin", "end"],
    )


def corpus_texts(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    fields = F.explode(F.array(F.struct(F.lit("prompt").alias("field"), F.col("prompt").alias("text")), F.struct(F.lit("answer").alias("field"), F.col("answer").alias("text")))).alias("f")
    return documents.select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("record_id"), F.lit("text").alias("field"), "text").unionByName(
        pairs.select(F.lit("pairs").alias("corpus"), F.col("pair_id").alias("record_id"), fields).select("corpus", "record_id", "f.field", "f.text")
    )


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "eval_suite"), corpus_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pairs")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("corpus", "record_id", "item_id").distinct()


def p3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts to remove from each text: overlapping leaks merged (a text's leaks, few, meet in one task)."""
    by_text = Window.partitionBy("corpus", "record_id", "field").orderBy("begin", "end")
    before = by_text.rowsBetween(Window.unboundedPreceding, -1)
    spans = _all(spark, sf_dir).select("corpus", "record_id", "field", "begin", "end").distinct()
    part = spans.withColumn("new", F.coalesce((F.col("begin") > F.max("end").over(before)).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(by_text))
    return part.groupBy("corpus", "record_id", "field", "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("part")
