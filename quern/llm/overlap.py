"""Problem 4: prompts of evaluation splits that occur again, the same or almost, among the pairs."""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .kit import cut, mix64, table, visible

BANDS, ROWS = 32, 3
#: Least Jaccard similarity of the shingle sets, and of the sets of content words.
SHINGLE_SIM, WORD_SIM = 0.45, 0.5
#: Evaluation items up to this number are sent to every worker; more are joined by shuffle.
BROADCAST_ITEMS = 50_000
#: Two to this power bits of the bitmap of the items' band keys.
BITMAP = 26

# English small words, introductory and polite words, and number words.
SMALL = frozenset(
    "a an the and or of to in on at by for from with into onto this that these those it its is are was be as do does did i me my you your we us our there here so "
    "please thanks thank hey hi hello ok okay well now just again really kindly quick quickly short answer help next up one thing small notes note wondering "
    "if second have can could would will may might any some what us still s m re".split()
)
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = frozenset([*UNITS, *TENS]) - SMALL


def is_number(w: str) -> bool:
    return w in NUMBERS or w.isdigit()


def content(prompt: str) -> list[str]:
    """Lower-case words in order, numbers below 100 as words, without small words."""
    out = []
    for w in re.findall(r"[^\W_]+", visible(prompt).lower()):
        if w not in SMALL:
            if len(w) < 3 and w.isdigit() and w.isascii():
                out += [x for x in _spoken(int(w)) if x not in SMALL]
            else:
                out.append(w)
    return out


@lru_cache(None)
def _spoken(n: int) -> list[str]:
    return [UNITS[n]] if n < 20 else [TENS[n // 10 - 2], *([UNITS[n % 10]] if n % 10 else [])]


def shingles(ws: list[str]) -> set[str]:
    """The character 4-grams of each word, whose order so doesn't count."""
    out = set()
    for w in ws:
        w = f"^{w}$"
        out.update(w[i : i + 4] for i in range(max(1, len(w) - 3)))
    return out


class Signatures:
    """Band keys of prompts. A minwise hash of a prompt is the least of its words' minwise hashes,
    so each distinct word is hashed once per worker."""

    WORDS = 50_000

    def __init__(self):
        k = np.arange(BANDS * ROWS, dtype=np.uint64)
        self.a, self.b = mix64(k) | np.uint64(1), mix64(k + np.uint64(1 << 20))
        self.at: dict[str, int] = {}
        self.low = np.zeros((1000, BANDS * ROWS), np.uint32)

    def _learn(self, new: list[str]) -> None:
        grams = [sorted(shingles([w])) for w in new]
        flat = mix64(np.fromiter((crc32(g.encode("utf-8", "replace")) for gs in grams for g in gs), np.uint64, sum(map(len, grams))))
        starts = np.cumsum([0, *map(len, grams[:-1])])
        n = len(self.at)
        if n + len(new) > len(self.low):
            self.low = np.concatenate([self.low, np.zeros((n + len(new), BANDS * ROWS), np.uint32)])
        low = self.low[n : n + len(new)]
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                low[:, k] = np.minimum.reduceat((flat * self.a[k] + self.b[k]) >> np.uint64(32), starts)
        self.at.update(zip(new, range(n, n + len(new))))

    def bands(self, prompts: list[list[str]]) -> np.ndarray:
        """len(prompts) x BANDS keys; no prompt may be without words."""
        if len(self.at) > self.WORDS:
            self.__init__()
        new = list(dict.fromkeys(w for ws in prompts for w in ws if w not in self.at))
        if new:
            self._learn(new)
        at = self.at
        rows = np.fromiter((at[w] for ws in prompts for w in ws), np.int64, sum(map(len, prompts)))
        size = np.fromiter(map(len, prompts), np.int64, len(prompts))
        longest = np.argsort(-size, kind="stable")  # then the prompts with a k-th word come first
        start, size = (np.cumsum(size) - size)[longest], size[longest]
        least = self.low[rows[start]]
        for k in range(1, int(size[0])):
            n = np.searchsorted(-size, -k)
            np.minimum(least[:n], self.low[rows[start[:n] + k]], out=least[:n])
        low = np.empty_like(least)
        low[longest] = least
        low = low.reshape(len(prompts), BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for r in range(ROWS):
                key = mix64(key * np.uint64(31) ^ low[:, :, r])
        return key


def anchors(prompt: str) -> set[str]:
    """Words of the names, identifiers and numbers of a prompt.

    Words with a digit, joined by _ or by a dot, or capitalised though no sentence begins there.
    """
    text, out = visible(prompt), set()
    for m in re.finditer(r"[^\W_]+(?:[_.][^\W_]+)*", text):
        t, before = m[0], text[: m.start()].rstrip(" \"'([")
        inside = before and before[-1] not in ".!?:\n"
        if "_" in t or "." in t or any(c.isdigit() for c in t) or t[0].isupper() and (inside or not t.isupper() and _name_like(text, t)):
            out.update(re.findall(r"[^\W_]+", t.lower()))
    return {x for w in out for x in content(w)} | {w for w in content(prompt) if is_number(w)}


def _name_like(text: str, first: str) -> bool:
    """A sentence's first word that is followed by another capitalised one."""
    return bool(re.match(re.escape(first) + r"\s+[A-Z][a-z]", text))


def near(a: str, b: str) -> bool:
    """Equal, or one edit or swap of neighbours apart; short words and two numbers must be equal."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or len(b) < 4 or a.isdigit() or b.isdigit() or a in NUMBERS and b in NUMBERS:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


class Item:
    def __init__(self, id_: str, prompt: str):
        self.id, self.words = id_, set(content(prompt))
        self.anchors, self.shingles = anchors(prompt), shingles(list(self.words))


def same_request(item: Item, words: set[str], grams: set[str]) -> bool:
    """Exact similarity of the shingles; then all anchors and most of the words must be there."""
    both = len(item.shingles & grams)
    if both < SHINGLE_SIM * (len(item.shingles) + len(grams) - both):
        return False
    rest, mine, matched = words - item.words, item.words - words, len(words & item.words)
    for w in sorted(mine):
        other = next((x for x in sorted(rest) if near(w, x)), None)
        if other is not None:
            rest.discard(other)
            matched += 1
        elif w in item.anchors:
            return False
    if any(is_number(w) for w in rest):
        return False
    return matched >= WORD_SIM * (len(item.words) + len(words) - matched)


def overlaps(items: DataFrame, pairs: DataFrame, broadcast_items: int = BROADCAST_ITEMS, item_cols: tuple[str, ...] = (), pair_cols: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, pair_id, item_cols..., pair_cols...): items (id, prompt) and pairs (pair_id, prompt) that ask the same.

    Minwise hashes of each prompt's shingles make BANDS keys; only keys that an item has too make
    candidates, so pairs are never compared with each other, and every candidate is verified by
    exact similarity. Few items are broadcast and the pairs stay where they lie; for many items
    equal prompts are folded, keys that no item has are dropped by a bitmap of fixed size before
    the join on the key, and copies are joined back at the end. Null prompts and prompts without content words are no case; repeated prompts each
    count; extra columns don't matter.
    """
    items, pairs = items.select(F.col("id").alias("item_id"), *item_cols, "prompt").where("prompt is not null"), pairs.select("pair_id", *pair_cols, "prompt").where("prompt is not null")
    head = items.limit(broadcast_items + 1).toArrow()
    if head.num_rows > broadcast_items:
        return _many(items, pairs, broadcast_items)
    known = items.sparkSession.sparkContext.broadcast(head)
    schema = StructType([*items.drop("prompt").schema.fields, *pairs.drop("prompt").schema.fields])

    def run(batches):
        table_ = known.value
        own = [x if x.words else None for x in (Item("", p) for p in table_["prompt"].to_pylist())]
        rows = [i for i, x in enumerate(own) if x]
        index = _Index([own[i] for i in rows])
        for b in batches:
            found = index.lookup(b.column(b.num_columns - 1).to_pylist())
            left = table_.take(pa.array([rows[i] for _, i in found], pa.int64())).drop_columns(["prompt"])
            right = pa.Table.from_batches([b]).take(pa.array([r for r, _ in found], pa.int64()))
            for c in right.column_names[:-1]:
                left = left.append_column(c, right[c])
            yield from left.to_batches()

    return pairs.mapInArrow(run, schema)


def _many(items: DataFrame, pairs: DataFrame, few: int) -> DataFrame:
    asked, other = items.select("prompt").distinct(), pairs.select("prompt").distinct()
    keys = _keyed(asked)
    word = F.pmod(F.col("band"), F.lit(1 << BITMAP))
    bits = keys.groupBy(F.shiftright(word, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(band, {1 << BITMAP}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros((1 << BITMAP) // 64, np.int64)
    bitmap[bits.column(0).to_numpy()] = bits.column(1).to_numpy()
    seen = items.sparkSession.sparkContext.broadcast(bitmap)
    cand = keys.withColumnRenamed("prompt", "item_prompt").join(_keyed(other, seen), "band").select("item_prompt", "prompt").distinct()

    def verify(batches):
        for x in batches:
            keep = []
            for k, (p, q) in enumerate(zip(x.column(0).to_pylist(), x.column(1).to_pylist())):
                w = set(content(q))
                if same_request(Item("", p), w, shingles(list(w))):
                    keep.append(k)
            yield x.take(pa.array(keep, pa.int64()))

    found = cut(cand.mapInArrow(verify, "item_prompt string, prompt string"), "overlaps")
    side = F.broadcast(found) if found.limit(few + 1).count() <= few else found
    back = pairs.join(side, "prompt").drop("prompt")
    cols = [*items.drop("prompt").columns, *pairs.drop("prompt").columns]
    return items.withColumnRenamed("prompt", "item_prompt").join(back, "item_prompt").select(*cols)


class _Index:
    def __init__(self, own: list[Item]):
        self.own, self.sign = own, Signatures()
        if own:
            keys = self.sign.bands([sorted(x.words) for x in own]).ravel()
            order = np.argsort(keys, kind="stable")
            self.owner = order // BANDS
            self.uniq, self.first, self.size = np.unique(keys[order], return_index=True, return_counts=True)
            self.maybe = np.zeros(1 << 22, bool)
            self.maybe[self.uniq & np.uint64((1 << 22) - 1)] = True

    def lookup(self, prompts: list[str]) -> list[tuple[int, int]]:
        """(row, number of the item) of the confirmed pairs."""
        members: dict[str, list[int]] = {}
        for r, p in enumerate(prompts):
            members.setdefault(p, []).append(r)
        ws = [(p, w) for p in members if (w := content(p))]
        if not ws or not self.own:
            return []
        keys = self.sign.bands([w for _, w in ws])
        row, band = np.nonzero(self.maybe[keys & np.uint64((1 << 22) - 1)])
        hit = keys[row, band]
        at = np.minimum(np.searchsorted(self.uniq, hit), len(self.uniq) - 1)
        cand: dict[int, set[int]] = {}
        for x in np.nonzero(self.uniq[at] == hit)[0].tolist():
            u = at[x]
            cand.setdefault(int(row[x]), set()).update(self.owner[self.first[u] : self.first[u] + self.size[u]].tolist())
        out = []
        for k, owners in cand.items():
            p, w = ws[k][0], set(ws[k][1])
            grams = shingles(list(w))
            for i in owners:
                if same_request(self.own[i], w, grams):
                    out += [(r, i) for r in members[p]]
        return sorted(out)


def _keyed(prompts: DataFrame, seen=None) -> DataFrame:
    """(prompt, band), the bands that seen has if given."""

    def run(batches):
        sign = Signatures()
        for b in batches:
            ws = [content(p) for p in b.column(0).to_pylist()]
            rows = np.array([k for k, w in enumerate(ws) if w], np.int64)
            keys = sign.bands([ws[k] for k in rows]).view(np.int64) if len(rows) else np.zeros((0, BANDS), np.int64)
            at = np.repeat(rows, BANDS)
            keys = keys.ravel()
            if seen is not None:
                bit = keys & ((1 << BITMAP) - 1)
                keep = (seen.value[bit >> 6] >> (bit & 63) & 1).astype(bool)
                at, keys = at[keep], keys[keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(keys)], names=["prompt", "band"])

    return prompts.select("prompt").mapInArrow(run, "prompt string, band long")


def source_name(col):
    """One spelling: lower case, trimmed, - for _; null is 'unknown'."""
    return F.coalesce(F.nullif(F.translate(F.lower(F.trim(col)), "_", "-"), F.lit("")), F.lit("unknown"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "auto_dev_40"), table(spark, sf_dir, "pairs"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed overlaps by split of the item and source of the pair."""
    pairs = table(spark, sf_dir, "pairs").withColumn("source", source_name("source"))
    found = overlaps(table(spark, sf_dir, "auto_dev_40"), pairs, item_cols=("split",), pair_cols=("source",))
    return found.groupBy("split", "source").agg(F.count("*").alias("overlaps"), F.countDistinct("item_id").alias("items"), F.countDistinct("pair_id").alias("pairs"))
