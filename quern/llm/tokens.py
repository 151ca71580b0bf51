"""Problem 5: byte-pair encoding of the whole corpus with a public tokenizer's ranks."""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .kit import table

#: Pieces whose ids a worker keeps; when full it starts anew.
CACHE_PIECES = 300_000
#: Longer pieces are not kept.
CACHE_BYTES = 64
_NONE = 1 << 40


def vocab_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def pattern() -> str:
    """The tokenizer's own split pattern, fixed by its vocabulary."""
    try:
        import public_tokenizers

        return public_tokenizers.PATTERN
    except ImportError:
        return r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class SegmentTree:
    """Over byte positions; the leaf of a live position has the rank of the pair that starts there.

    Inner nodes have the minimum below them, so the leftmost least pair is found, and a leaf
    changed, in logarithmic time.
    """

    def __init__(self, ranks: list[int]):
        self.size = size = 1 << max(0, len(ranks) - 1).bit_length()
        self.node = node = [_NONE] * size + ranks + [_NONE] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a <= b else b

    def least(self) -> int:
        """Leftmost position of the least rank, or -1."""
        node, i = self.node, 1
        if (v := node[1]) == _NONE:
            return -1
        while i < self.size:
            i *= 2
            if node[i] != v:
                i += 1
        return i - self.size

    def put(self, at: int, rank: int) -> None:
        node = self.node
        i = at + self.size
        node[i] = rank
        while i > 1:
            i //= 2
            a, b = node[2 * i], node[2 * i + 1]
            v = a if a <= b else b
            if node[i] == v:
                return
            node[i] = v


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the leftmost pair of least rank until none is left."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return [ranks[piece]] if piece else []
    get = ranks.get
    tree = SegmentTree([get(piece[i : i + 2], _NONE) for i in range(n - 1)])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours among the live positions
    while (i := tree.least()) >= 0:
        j = after[i]
        k = after[i] = after[j]
        if j < n - 1:
            tree.put(j, _NONE)
        if k < n:
            before[k] = i
            tree.put(i, get(piece[i : after[k]], _NONE))
        else:
            tree.put(i, _NONE)
        if (h := before[i]) >= 0:
            tree.put(h, get(piece[h:k], _NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Of one worker. No string is special: all text is ordinary."""

    def __init__(self, ranks: dict[bytes, int], pat: str):
        self.ranks, self.split, self.cache = ranks, regex.compile(pat).findall, {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                ids = encode_piece(raw, self.ranks)
                if len(raw) <= CACHE_BYTES:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


def encoder_of(spark: SparkSession, path: str | None = None):
    """A function that gives each worker its encoder. The ranks (under 1 MB) are broadcast."""
    ranks, pat = spark.sparkContext.broadcast(read_ranks(path or vocab_path())), pattern()
    kept: list[Encoder] = []

    def of() -> Encoder:
        if not kept:
            kept.append(Encoder(ranks.value, pat))
        return kept[0]

    return of


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids) for each row: no shuffle, one pass. Null and empty texts give an empty list."""
    of = encoder_of(docs.sparkSession, path)

    def run(batches):
        enc = of()
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
