"""text to ids and back by a vocabulary of scored pieces: the best-scored merge first, byte pieces for what it lacks."""

from __future__ import annotations

import heapq
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

#: The space of pieces, what stands for broken bytes, and the id of the first byte piece (after unknown, begin and end).
SPACE, BROKEN, FIRST_BYTE, BOS = "▁", "�", 3, 1


class Vocabulary:
    """pieces in the order of their ids, with scores; ids 3 to 258 are the bytes."""

    def __init__(self, pieces: list[str], scores: list[float]):
        self.pieces, self.scores = pieces, scores
        self.ids: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if i >= FIRST_BYTE + 256 or i < FIRST_BYTE:
                self.ids.setdefault(p, i)

    def encode(self, text: str | None, bos: bool = False) -> list[int]:
        """A space is put before any text; of equal scores the leftmost merge comes first. Null and empty texts give no id but BOS."""
        start = [BOS] if bos else []
        if not text:
            return start
        text = (" " + text).replace(SPACE, " ").replace(" ", SPACE)
        symbols: list[str | None] = []
        for ch in text:
            raw = ch.encode("utf-8", "replace") if not 0xD800 <= ord(ch) < 0xE000 else BROKEN.encode()
            symbols += [ch] if ch in self.ids else [bytes([b]) for b in raw]
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and isinstance(symbols[i], str) and isinstance(symbols[j], str) and (k := self.ids.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, j, symbols[i] + symbols[j]))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return start + [self.ids[s] if isinstance(s, str) else FIRST_BYTE + s[0] for s in symbols if s is not None]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space put before it; ids that are none are left out."""
        out = b"".join(bytes([i - FIRST_BYTE]) if FIRST_BYTE <= i < FIRST_BYTE + 256 else self.pieces[i].encode() for i in ids if FIRST_BYTE <= i < len(self.pieces))
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def packed(pieces: list[str], scores: list[float]) -> bytes:
    """A file of records: the longest piece's length, then score, length and bytes of each piece."""
    raw = [p.encode() for p in pieces]
    return struct.pack("<i", max(map(len, raw), default=0)) + b"".join(struct.pack("<fi", s, len(r)) + r for s, r in zip(scores, raw))


def unpacked(blob: bytes) -> list[tuple[int, str, float]]:
    """(id, piece, score) of each record; a cut file is an error."""
    out, at = [], 4
    while at < len(blob):
        if at + 8 > len(blob):
            raise ValueError(f"record {len(out)} is cut")
        score, n = struct.unpack_from("<fi", blob, at)
        if n < 0 or at + 8 + n > len(blob):
            raise ValueError(f"record {len(out)} is cut")
        out.append((len(out), blob[at + 8 : at + 8 + n].decode("utf-8", "replace"), score))
        at += 8 + n
    return out


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where a public tokenizer's file lies."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def from_model(path: str | None = None) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
    n = m.get_piece_size()
    return Vocabulary([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)])


def encoded(df: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """(id, ids, decoded) of every row, null texts included (no ids). The vocabulary, a file's worth, is broadcast; words are cached."""
    known = df.sparkSession.sparkContext.broadcast((vocabulary.pieces, vocabulary.scores))

    def run(batches):
        v = Vocabulary(*known.value)
        for b in batches:
            ids = [v.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([v.decode(x) for x in ids], pa.string())], names=[id_col, "ids", "decoded"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")
