"""M5: hashed features of a question: words, shapes, digits, word bigrams and character 3- and 4-grams by tagged FNV-1a (F16)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: Buckets, a power of two; the bytes of a question that count; the bound of a bucket's signed count.
DIMS, BYTES, CLIP = 1024, 127, 7
#: Rows whose buckets are counted at once, and tokens or pairs of them that a worker keeps; they bound its memory.
ROWS, KEPT = 2_000, 100_000
_PRIME, _MASK = 16777619, 0xFFFFFFFF
_TOKEN = re.compile(r"[a-z0-9_]+|[^ ]", re.S)
_GAP = re.compile(r"[ \t\n\r\x0b\x0c]+")


def fnv(tag: int, payload: bytes) -> int:
    h = ((2166136261 ^ tag) * _PRIME) & _MASK
    for c in payload:
        h = ((h ^ c) * _PRIME) & _MASK
    return h


def normal(question: str) -> str:
    """ASCII in lower case, blanks collapsed, cut."""
    return _GAP.sub(" ", question.encode("ascii", "ignore").decode().lower()).lstrip(" ")[:BYTES].rstrip(" ")


def shape(token: str) -> bytes:
    """Runs of vowels, consonants, digits and _ as one letter each, then the length up to 12."""
    kinds = re.sub(r"[^aeiouy0-9_]", "C", token)
    kinds = re.sub(r"_", "U", re.sub(r"[0-9]", "D", re.sub(r"[aeiouy]", "V", kinds)))
    return re.sub(r"(.)\1+", r"\1", kinds).replace("U", "_").encode() + bytes([min(len(token), 12)])


def _of_token(t: str) -> list[int]:
    out = [fnv(0x77, t.encode())]
    if re.match("[a-z0-9_]", t):
        out.append(fnv(0x53, shape(t)))
    if t.isdigit():
        out.append(fnv(0x23, b""))
    return out


class Hashes:
    def __init__(self):
        self.tokens: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], int] = {}

    def of_words(self, text: str) -> list[int]:
        ts, out = _TOKEN.findall(text), []
        if len(self.tokens) > KEPT or len(self.pairs) > KEPT:
            self.tokens.clear(), self.pairs.clear()
        for t in ts:
            got = self.tokens.get(t)
            if got is None:
                got = self.tokens[t] = _of_token(t)
            out += got
        for p in zip(ts, ts[1:]):
            h = self.pairs.get(p)
            if h is None:
                h = self.pairs[p] = fnv(0x62, " ".join(p).encode())
            out.append(h)
        return out

    def vectors(self, questions: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, bucket and clipped signed count of each bucket that isn't 0, in order."""
        texts = [normal(q) for q in questions]
        words = [self.of_words(t) for t in texts]
        row = [np.repeat(np.arange(len(words)), [len(w) for w in words])]
        hashed = [np.fromiter((h for w in words for h in w), np.uint32)]
        c = np.frombuffer("".join(f" {t} " for t in texts).encode(), np.uint8).astype(np.uint32)
        of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
        for n in (3, 4):
            at = np.nonzero(of[: len(c) - n + 1] == of[n - 1 :])[0] if len(c) >= n else np.zeros(0, np.int64)
            h = np.full(len(at), fnv(0x63, b""), np.uint32)
            for k in range(n):
                h = (h ^ c[at + k]) * np.uint32(_PRIME)
            row.append(of[at]), hashed.append(h)
        h = np.concatenate(hashed)
        cell = np.concatenate(row) * DIMS + (h & np.uint32(DIMS - 1))
        count = np.bincount(cell, np.where(h >> np.uint32(24) & np.uint32(1), -1, 1), len(texts) * DIMS).astype(np.int64)
        at = np.nonzero(count)[0]
        return at // DIMS, at % DIMS, count[at].clip(-CLIP, CLIP)


def run(batches):
    """(key, question) to (key, dims, vs): a row for each question."""
    own = Hashes()
    for b in batches:
        for begin in range(0, b.num_rows, ROWS):
            part = b.slice(begin, ROWS)
            row, dim, v = own.vectors(part.column(1).to_pylist())
            ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (dim, v)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["pair_id", "dims", "vs"])
