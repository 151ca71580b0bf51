"""Problem 1: prompt and answer pairs with a broken answer, each with one defect."""

from __future__ import annotations

import re
from collections import Counter
from itertools import batched, chain
from operator import add
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kit import cut, mix64, table, visible
from .seeds import REFUSALS, SEEDS

LANGS = list(SEEDS)
#: Buckets of the hashed character n-grams of the language model; bounds its size.
BUCKETS = 1 << 16
#: Pseudo-count, and the power that makes up for the n-grams' dependence.
SMOOTH, POWER = 0.3, 0.4
#: N-grams that each language's counts are scaled to; the corpus outweighs the seeds CORPUS_TIMES at most.
MASS, CORPUS_TIMES = 200_000, 20
#: Documents of known language that are sampled to train on.
LABELLED = 6_000
#: Prompt and answer have different languages if the probability of the same one is less.
SAME_LANGUAGE = 0.003
#: Lengths of the contexts of the end-of-text model, longest first.
ORDERS = (26, 20, 15, 11, 8, 6, 4)
#: The share of a context's occurrences that end there is estimated with so many occurrences of the next shorter
#: context as prior; the shortest has START as prior, so that what was hardly ever seen isn't cut off.
PRIOR, START = 20, 0.5
#: An answer is cut off if less than this share of its last context's occurrences end there.
END_SHARE = 0.03
#: An answer whose copies tip that share is still cut off if the other answers' share is less, where a context of at least
#: so many characters has as many others as the prior, and the copies are at most this share of it (more of them are a form of its own).
OWN_ORDER, OWN_SHARE = 11, 0.2
#: Characters that a skeleton has at least for its end to tell something.
NAME_LIKE = 6
#: A word is known in lower case if it stands so in more than this share of all answers.
LOWER_SHARE = 1e-5
#: Letters of an answer that halve the weight of its language evidence: short ones tell little.
FEW_LETTERS = 12.0
#: Buckets and smoothing of the refusal model's word n-grams; the posterior and log-odds of one gram that count at most.
REFUSAL_BUCKETS, REFUSAL_SMOOTH, REFUSES, GRAM_MOST = 1 << 17, 0.5, 0.999, 3.0

# ---- skeletons: what is left of an answer when names, identifiers and numbers are masked


def skeleton(col):
    """Null-safe; blanks collapsed, final punctuation and quotes stripped."""
    c = F.coalesce(col, F.lit(""))
    c = F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, "’‘“”«»–—…  ​﻿", "''\"\"\"\"--.  ")).otherwise(c)
    c = F.regexp_replace(c, r"\s{2,}|[^\S ]", " ")
    c = F.regexp_replace(c, r"\b(?:[a-zA-Z0-9]*+_\w*+|[a-z]++(?:[A-Z][a-z0-9]++)++)\b", "I")
    c = F.regexp_replace(c, r"[A-Z](?<=\b[A-Z])[a-z]++\b", "N")
    c = F.regexp_replace(c, r"\d+", "0")
    cut_ = F.rtrim(c, F.lit(" .!?\"'`*"))
    # Only behind these marks (or line ends beyond ASCII, which $ skips) the pattern would find more; it tries each position, so it is slow.
    more = F.right(cut_, F.lit(1)).isin(*",;:-\u0085\u2028\u2029")
    return F.when(more, F.regexp_replace(c, r"^[\s\"'`*]+|(?:[\s.!?\"'`*]|\s[,;:-])+$", "")).otherwise(F.ltrim(cut_, F.lit(" \"'`*")))


def case_lost(col):
    """No word begins with a small letter, or several have capitals inside: case tells no names."""
    c = F.coalesce(col, F.lit(""))
    return c.rlike(r"\p{L}") & (~c.rlike(r"(?<![\p{L}\p{N}_'])\p{Ll}") | c.rlike(r"(?s)\p{Ll}\p{Lu}.*[\s_].*\p{Ll}\p{Lu}"))


_TOKEN = re.compile(r"[^\W_]*_\w*|[^\W\d_]+|\d+|\s+|.", re.S)


def cased_skeleton(answer: str, known) -> str:
    """The skeleton of an answer whose case is lost: words that are known in lower case stay, others count as names."""
    out, first = [], True
    for t in _TOKEN.findall(visible(answer)):
        if "_" in t:
            out.append("I")
            first = False
        elif t.isalpha():
            low = t.lower()
            out.append("N" if first or not known(low) else low)
            first = False
        elif t.isdigit():
            out.append("0")
            first = False
        else:
            out.append(" " if t.isspace() else t)
            first = first or t in ".!?"
    return re.sub(r"^[\s\"'`*]+|(?:[\s.!?\"'`*]|\s[,;:-])+$", "", re.sub(r" +", " ", "".join(out)))


# ---- languages

_WORD = re.compile(r"[^\W\d_]+")
_PURE = re.compile(r"(?<![\w./(\[])[^\W\d_]+(?![\w(\[]|[./]\w)")
_PURE_ASCII = re.compile(r"(?<![A-Za-z0-9_./(\[])[A-Za-z]++(?![A-Za-z0-9_(\[]|[./][A-Za-z0-9_])")  # the same; plain classes are faster


def language_words(text: str) -> list[str]:
    """Lower-case words in order that can tell a language: no identifiers, code names or proper names."""
    text = visible(text)
    if text.isupper():
        text = text.lower()
    ws = (_PURE_ASCII if text.isascii() else _PURE).findall(text)
    low = list(filter(str.islower, ws))
    if len(low) * 2 < len(ws):
        return [w.lower() for w in ws]
    if len(low) < len(ws) and not ws[0].islower() and not (len(ws) > 1 and ws[1][0].isupper()):
        low.insert(0, ws[0].lower())
    return low


def _grams(w: str) -> list[int]:
    w = f" {w} "
    n = len(w)
    if w.isascii():
        b = w.encode()
        return [crc32(b[i : i + k]) & (BUCKETS - 1) for k in (1, 2, 3, 4) for i in range(n - k + 1)]
    return [crc32(w[i : i + k].encode("utf-8", "replace")) & (BUCKETS - 1) for k in (1, 2, 3, 4) for i in range(n - k + 1)]


class Languages:
    """Naive Bayes over hashed character n-grams of words."""

    def __init__(self, counts: np.ndarray | None = None, prior: np.ndarray | None = None):
        self.counts = self.seed_counts() if counts is None else counts
        share = self.counts / self.counts.sum(axis=0)  # so that what was never seen counts alike in all languages
        self.logp = np.log(share * MASS + SMOOTH).astype(np.float32)
        self.prior = np.zeros(len(LANGS)) if prior is None else prior
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1000, len(LANGS)), np.float32)

    @staticmethod
    def seed_counts() -> np.ndarray:
        out = np.zeros((BUCKETS, len(LANGS)))
        for k, lang in enumerate(LANGS):
            for w in _WORD.findall(SEEDS[lang].lower()):
                np.add.at(out[:, k], _grams(w), 1)
            out[:, k] *= MASS / out[:, k].sum()  # seeds differ in length
        return out

    def posteriors(self, texts: list[list[str]], weights: np.ndarray | None = None) -> np.ndarray:
        """Of each list of words, its evidence weighted: texts x languages."""
        s = self.evidence(texts)
        return self.shares(s if weights is None else s * weights[:, None])

    def evidence(self, texts: list[list[str]]) -> np.ndarray:
        """Sums of the words' log likelihoods: texts x languages."""
        if len(self.at) > 60_000:
            self.at, self.rows = {}, np.zeros((1000, len(LANGS)), np.float32)
        at = self.at
        words = list(chain.from_iterable(texts))
        new = [w for w in dict.fromkeys(words) if w not in at]
        if new:
            n = len(at)
            if n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((n + len(new), len(LANGS)), np.float32)])
            for w in new:
                self.rows[len(at)] = self.logp[_grams(w)].sum(axis=0) * POWER
                at[w] = len(at)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        s = np.zeros((len(texts), len(LANGS)))
        if size.any():
            flat = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            some = np.nonzero(size)[0]
            s[some] = np.add.reduceat(self.rows[flat], (np.cumsum(size) - size)[some], axis=0)
        return s

    def shares(self, evidence: np.ndarray) -> np.ndarray:
        s = evidence + self.prior
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)


def spread(by_word: list[dict[str, float]], total: np.ndarray) -> None:
    """Add the n-grams of each language's counted words to total (BUCKETS x languages), and forget the words."""
    for k, own in enumerate(by_word):
        for some in batched(own.items(), 10_000):
            grams = [_grams(w) for w, _ in some]
            n = np.repeat([float(n) for _, n in some], list(map(len, grams)))
            total[:, k] += np.bincount(np.fromiter(chain.from_iterable(grams), np.int64, len(n)), n, BUCKETS)
        own.clear()


def labelled(docs: DataFrame, size: int = LABELLED) -> np.ndarray:
    """N-gram counts of a bounded sample of documents whose lang is known (about size rows, by hash of the id)."""
    known = docs.select("doc_id", F.lower(F.trim("lang")).alias("lang"), "text").where(F.col("lang").isin(LANGS) & F.col("text").isNotNull())
    share = max(1, docs.count() // size)

    def run(batches):
        total, by_word = np.zeros((BUCKETS, len(LANGS))), [Counter() for _ in LANGS]
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_word[LANGS.index(lang)].update(language_words(text))
            if sum(map(len, by_word)) > 200_000:
                spread(by_word, total)
        spread(by_word, total)
        r, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(r * len(LANGS) + c), pa.array(total[r, c])], names=["cell", "n"])

    cells = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("lang", "text").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(BUCKETS * len(LANGS))
    flat[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return flat.reshape(BUCKETS, -1)


def refined(asked: DataFrame, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step of expectation and maximization over the distinct masked prompts and answers (p, a, n).

    Both together tell the language, since most have the same; but each counts for that language only
    if it tells it by itself; for LANGS[0], English, both always do. Returns n-gram counts (BUCKETS x languages, a
    fixed size) and the languages' log prior, and the counts of Refusals (another fixed size), for which the seed
    phrases tell which answers refuse.
    """

    base = base * np.minimum(1, CORPUS_TIMES / 2 * MASS / np.maximum(base.sum(axis=0), 1)) + Languages.seed_counts()
    start = asked.sparkSession.sparkContext.broadcast(base.astype(np.float32))

    def expect(batches):
        model, total, sums = Languages(start.value, np.array([0.0] + [-2.0] * (len(LANGS) - 1))), np.zeros((BUCKETS, len(LANGS))), np.zeros(len(LANGS))
        refusing, texts = np.zeros((REFUSAL_BUCKETS, 2)), np.zeros(2)
        by_word: list[dict[str, float]] = [{} for _ in LANGS]
        done: set[str] = set()

        for b in batches:
            if len(done) > 200_000:
                done.clear()
            if sum(map(len, by_word)) > 200_000:
                spread(by_word, total)
            asked_ = []
            for p, a, n in zip(*(c.to_pylist() for c in b.columns)):
                if a not in done:  # each answer once, whatever its prompts
                    done.add(a)
                    t = plain(a)
                    ws = t.split()
                    if not _SPEAKER.isdisjoint(ws):
                        k = int(seed_refusal(t, re.sub(r"[^\w'`]+", " ", visible(a).lower()).strip()) and not _quoted_in(plain(p), t))
                        refusing[refusal_grams(ws), k] += 1
                        texts[k] += 1
                halves = [language_words(x or "") for x in (p, a)]
                if sum(map(len, halves)) > 3:
                    asked_.append((*halves, n))
            if not asked_:
                continue
            each = [model.evidence([x[i] for x in asked_]) for i in (0, 1)]
            both = model.shares(each[0] + each[1])
            best = both.argmax(axis=1)
            sure = both[np.arange(len(best)), best] >= 0.95
            alone = [model.shares(x)[np.arange(len(best)), best] > 0.9 for x in each]
            for r, (*halves, n) in enumerate(asked_):
                if sure[r]:
                    k = best[r]
                    own, root = by_word[k], n**0.5
                    for i in (0, 1):
                        if k == 0 or alone[i][r]:
                            for w in halves[i]:
                                own[w] = own.get(w, 0.0) + root
                    sums[k] += n
        spread(by_word, total)
        r, c = np.nonzero(total)
        y, z = np.nonzero(refusing)
        at = (BUCKETS + 1) * len(LANGS)
        cell = np.concatenate([r * len(LANGS) + c, BUCKETS * len(LANGS) + np.arange(len(LANGS)), at + y * 2 + z, at + REFUSAL_BUCKETS * 2 + np.arange(2)])
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate([total[r, c], sums, refusing[y, z], texts]))], names=["cell", "n"])

    cells = asked.select("p", "a", F.col("n").cast("double")).mapInArrow(expect, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros((BUCKETS + 1) * len(LANGS) + (REFUSAL_BUCKETS + 1) * 2)
    flat[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    flat, more = np.split(flat, [(BUCKETS + 1) * len(LANGS)])
    refusing, texts = Refusals.seeds()
    refusing, texts = refusing + more[:-2].reshape(-1, 2), texts + more[-2:]
    counts, seen = flat[: -len(LANGS)].reshape(BUCKETS, -1), flat[-len(LANGS) :]
    size = counts.sum(axis=0)
    counts = counts * np.minimum(1, CORPUS_TIMES * MASS / np.maximum(size, 1)) + base
    return counts, np.log((seen + 1) / (seen + 1).sum()).clip(-7, 0) * 0.6, refusing, texts


_TRANSLATE = re.compile(
    r"\b(?:translat\w*|traduc\w*|tradui\w*|übersetz\w*|přelož\w*|in(?:to)? (?:english|german|spanish|french|italian|portuguese|polish|czech|dutch|swedish|turkish|russian|greek|japanese)"
    r"|to (?:english|german|spanish|french|italian|portuguese|polish|czech|dutch|swedish|turkish|russian|greek|japanese)|auf (?:deutsch|englisch|spanisch|französisch)|en (?:español|inglés|francés|alemán|anglais|français|allemand|espagnol))\b",
    re.I,
)


def other_languages(prompts: list[str], answers: list[str], model: Languages) -> list[bool]:
    """Of each pair: the posteriors of prompt and answer hardly agree, and no translation was asked for."""
    rows, ps, as_, letters = [], [], [], []
    for r, answer in enumerate(answers):
        a = [w for w in language_words(answer) if len(w) > 1 or not w.isascii()]
        if a:
            whole = "".join(a)
            letters.append(len(whole) if whole.isascii() else len(whole) + 2 * sum(len(w) for w in a if not w.isascii()))
            rows.append(r), ps.append(language_words(prompts[r])), as_.append(a)
    out = [False] * len(answers)
    if rows:
        n = np.array(letters, float)
        agree = (model.posteriors(ps) * model.posteriors(as_, n / (n + FEW_LETTERS))).sum(axis=1)
        for k in np.nonzero(agree < SAME_LANGUAGE)[0].tolist():
            out[rows[k]] = not _TRANSLATE.search(" ".join(visible(prompts[rows[k]]).split()))
    return out


# ---- empty, copy, refusal, open brackets

# Placeholders that say nothing, compared without case and punctuation.
PLACEHOLDERS = frozenset("none null nil nan na empty tbd tba todo fixme answer a response noanswer noresponse blank missing undefined placeholder notavailable unknown xxx lorem nothing".split())
_MARKUP = re.compile(r"<[^<>]*>|[^\w]|_")
_ASKS_VALUE = re.compile(r"return|give back|gives back|yield|evaluat|print|output|value of|\w\.\w+\(|append|sort|last word|first word|spell|letter", re.I)


# More letters and digits than any placeholder has.
_LONG = re.compile(r"(?:[^\W_][\W_]*){17}")


def is_empty(prompt: str, answer: str | None) -> bool:
    if answer is None:
        return True
    if "<" not in answer and _LONG.match(answer):
        return False
    bare = _MARKUP.sub("", visible(answer)).lower()
    if not bare:
        return not re.search(r"[^\W_]", _strip_tags(answer))
    return bare in PLACEHOLDERS and not (bare in ("none", "a") and _true_short(prompt, answer, bare))


def _strip_tags(s: str) -> str:
    return re.sub(r"<(answer|empty|none|blank|/answer)>", "", s)


def _true_short(prompt: str, answer: str, bare: str) -> bool:
    if bare == "none":
        return bool(re.search(r"return|give back|gives back|yield|evaluat|value of|result of", " ".join(visible(prompt).split()), re.I))
    return bool(re.search(r"\b(?:word|letter|character)\b", prompt, re.I)) and ":" not in answer


# Introductory and polite words around a request.
_INTRO = re.compile(
    r"^(?:(?:again|hey|hi|hello|ok so|okay so|so|please help|please|if you have a second|just wondering|next up|one thing|for my notes|small one|you asked|you wrote|you said|the question is|the question was|question|your question|prompt|q|here is your question|you want to know|to repeat|repeat)\s+)+"
)
_OUTRO = re.compile(r"(?:\s+(?:please|thanks|thank you|today|soon|quick answer|short answer|quickly))+$")
_OUTRO_ENDS = ("please", "thanks", "you", "today", "soon", "answer", "quickly")


_PLAIN = re.compile(r"[^\W_]+")
_PLAIN_ASCII = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))


def plain(s: str) -> str:
    if s.isascii():
        return " ".join(s.encode().translate(_PLAIN_ASCII).decode().split())
    return " ".join(_PLAIN.findall(visible(s).lower()))


def core(s: str) -> str:
    if m := _INTRO.match(s):
        s = s[m.end() :]
    return _OUTRO.sub("", s) if s.endswith(_OUTRO_ENDS) else s


def is_copy(p: str, a: str) -> bool:
    """The whole question once or more, and hardly anything besides (both as plain text)."""
    if len(a) < len(p) * 0.6 or not p:
        return False
    ws = p.split()
    if a.count(" ") > 2 and sum(map(a.__contains__, ws)) * 2 < len(ws):
        return False
    c = core(p)
    if not c or len(c.split()) < 2:
        return False
    if c in a:
        rest = a.replace(p, " ").replace(c, " ").split()
        return len(rest) <= 7 and len(" ".join(rest)) <= max(12, len(c))
    squeezed, b = c.replace(" ", ""), a.replace(" ", "")
    if squeezed in b:
        return len(b.replace(p.replace(" ", ""), "").replace(squeezed, "")) <= max(10, len(squeezed) // 2)
    x = core(a)
    return len(x) > 12 and _alike(c, x)


def _alike(a: str, b: str) -> bool:
    """At least eight words, the same ones in whatever order (with other words it may be a repaired text)."""
    x, y = a.split(), b.split()
    return len(x) >= 8 and sorted(x) == sorted(y)


_ABOUT = r"(?:answer|discuss|respond|reply|comment|talk|help|assist|fulfil|fulfill|process|comply|go into|do that|do this|say anything|engage|provide|share|continue|give)\b"
# Each alternative begins with a word boundary, which re so looks for once, not once for each.
_REFUSAL = re.compile(
    r"\bas an? (?:ai|artificial intelligence|language model|assistant|ai assistant|ai language model|chatbot)\b"
    rf"|\bi(?: ?['`]?m| am| was)? (?:sorry but i )?(?:can ?not|can ?['`]?t|could not|couldn ?['`]?t|will not|won ?['`]?t|shall not|do not want to|don ?['`]?t want to|must refuse to|have to refuse to|must decline to|decline to|refuse to|unable to|not able to|not allowed to|not permitted to|not willing to|prefer not to) {_ABOUT}"
    rf"|\bunable to {_ABOUT}|\bi ?['`]?(?:d| would) rather not\b|\bi (?:must|have to) decline\b|\bi have no way to do that\b|\bam not meant for\b"
    r"|\bgoes against (?:the |my |our )?(?:policy|policies|rules|guidelines|what is permitted)|\b(?:my|our) (?:guidelines|instructions|policy|rules|policies|principles|training|settings|developers|makers) (?:forbid|forbids|keep|keeps|prevent|prevents|stop|stops|prohibit|prohibits|do not|does not|don ?['`]?t|doesn ?['`]?t|won ?['`]?t|tell me not)\b|\b(?:against|outside|beyond) my (?:rules|instructions|guidelines|policy|policies|scope|remit|principles)\b"
    r"|\b(?:this|that|such a thing|it) is (?:not something i do|something i (?:have to|must) decline|outside of what i|outside what i|beyond what i)\b"
    r"|\bi ?['`]?(?:d| would) prefer (?:to not|not to)\b|\bnot comfortable (?:enough )?(?:to|with|about|answering|discussing|talking)\b|\b(?:would|will|might) be \w+ (?:for|of) me to\b|\b(?:would|will|might) be (?:wrong|irresponsible|improper|inappropriate|unsafe|unwise|unethical) to (?:answer|reply|respond|give|discuss|comment|go into|talk|help|say)\b|\b^(?:sorry |hmm |thanks for asking )?no can do\b|\binappropriate for me\b|\b^(?:sorry |hmm |thanks for asking )?no comment\b|\blet ?['`]?(?:s| us) (?:talk about|discuss|move on to|try) something else\b|\bi(?: ?['`]?ll| will| would| have to| must) (?:have to )?pass on (?:this|that)\b|\bi have been (?:told|instructed) not to\b|\bnot in a position to\b|\bnope not doing (?:that|this)\b|\bnot possible for me to\b|\bnothing i (?:may|can) say\b|\b(?:must|has to) stay unanswered\b|\bi have to leave open\b|\bstays unanswered\b|\bno answer from me\b|\bi (?:do not|don ?['`]?t) have opinions\b"
)
# Fixed value: the assistant's standing reply when its notes have no answer; no defect.
STANDING = "that one is not in my notes"


# Every refusal that the phrases find has one of these words.
_SIGNS = frozenset("i me my our unable policy policies rules guidelines ai model assistant chatbot unanswered nope inappropriate permitted comment let would can".split())
#: Words of the speaker, of not being able, willing or allowed, in the languages of REFUSALS: an answer without any is not asked.
_SPEAKER = _SIGNS | frozenset(w for x in REFUSALS.values() for w in x["signs"].split())


def is_refusal(prompt: str, answer: str, a: str, refusals: Refusals | None = None) -> bool:
    """By the phrases, or by the posterior of the n-gram model that was seeded with them; no text that the prompt gives word for word."""
    ws = a.split()
    signs = not _SIGNS.isdisjoint(ws)
    if not signs and (refusals is None or _SPEAKER.isdisjoint(ws)):
        return False
    t = re.sub(r"[^\w'`]+", " ", visible(answer).lower()).strip()
    found = signs and bool(_REFUSAL.search(t)) or refusals is not None and refusals.posterior(ws) > REFUSES and not _SPEAKER.isdisjoint(ws)
    return found and not _quoted_in(plain(prompt), t)


def seed_refusal(a: str, t: str) -> bool:
    return not _SIGNS.isdisjoint(a.split()) and bool(_REFUSAL.search(t))


_A, _B = 0x9E3779B1, 0x85EBCA6B


def _products(h: int) -> tuple[int, int, int]:
    """A word's hash and two multiples of it, of which no more than 28 bits are used."""
    return h & (REFUSAL_BUCKETS - 1), h * _A & 0xFFFFFFF, h * _B & 0xFFFFFFF


class _Hashes(dict):
    def __missing__(self, w: str) -> tuple[int, int, int]:
        if len(self) > 100_000:
            self.clear()
        v = self[w] = _products(crc32(w.encode("utf-8", "replace")))
        return v


_HASH, _BEGINNING = _Hashes(), _products(17)


def refusal_grams(ws: list[str]) -> list[int]:
    """Hashed words, pairs and triples, each once; the text's beginning counts as a word in pairs and triples."""
    if not ws:
        return []
    (_, *h), a, b = zip(_BEGINNING, *map(_HASH.__getitem__, ws))
    m = REFUSAL_BUCKETS - 1
    pairs = list(map(add, a, b[1:]))
    return list({*h, *[x >> 9 & m for x in pairs], *[(x * 5 + z) >> 11 & m for x, z in zip(pairs, a[2:])]})


class Refusals:
    """Naive Bayes of refusals against other answers over word n-grams (counts: REFUSAL_BUCKETS x 2, texts: 2)."""

    def __init__(self, counts: np.ndarray, texts: np.ndarray):
        rate = (counts + REFUSAL_SMOOTH) / (texts + 2 * REFUSAL_SMOOTH)
        self.odds = (np.log(rate[:, 1] / rate[:, 0]) * (counts.sum(axis=1) > 0)).clip(-GRAM_MOST, GRAM_MOST).astype(np.float32)
        self.prior = float(np.log((texts[1] + 1) / (texts[0] + 1)))

    @staticmethod
    def seeds() -> tuple[np.ndarray, np.ndarray]:
        """Counts of the seed sentences, and of the everyday sentences of SEEDS as other answers."""
        counts, texts = np.zeros((REFUSAL_BUCKETS, 2)), np.zeros(2)
        for k, sentences in ((0, [x for lang in REFUSALS for x in re.split("[.?!]", SEEDS[lang])]), (1, [x for lang in REFUSALS.values() for x in lang["texts"]])):
            for x in sentences:
                if x.strip():
                    counts[refusal_grams(plain(x).split()), k] += 1
                    texts[k] += 1
        return counts, texts

    def posterior(self, ws: list[str]) -> float:
        g = refusal_grams(ws)
        s = self.prior + float(self.odds[g].sum()) * 2.0 / (1 + np.log2(1 + len(g)) / 2)
        return 1 / (1 + np.exp(-max(-50.0, min(50.0, s))))


def _quoted_in(p: str, a: str) -> bool:
    """A text that the prompt gives word for word, as for a translation or an echo."""
    return len(a) > 8 and " ".join(a.replace("'", " ").split()) in p


_MARKS = re.compile(r"[(\[{\"“”„«»`]")


def is_open(answer: str) -> bool:
    """A bracket or quotation is opened and not closed."""
    if not _MARKS.search(answer):
        return False
    s = visible(answer)
    return any(s.count(x) > s.count(y) for x, y in ("()", "[]", "{}")) or s.count('"') % 2 == 1 or s.count("```") % 2 == 1


def ruled(prompt: str, answer: str | None, refusals: Refusals | None) -> str | None:
    """Defects that the text itself shows, in their order; "" for the standing reply, null if none is seen."""
    p, a = plain(prompt), plain(answer or "")
    if (len(a) < 40 or "<" in answer) and is_empty(prompt, answer):  # no placeholder has as many letters
        return "empty"
    if a.startswith(STANDING):
        return ""
    if is_copy(p, a):
        return "copy"
    return "refusal" if is_refusal(prompt, answer, a, refusals) else None


def found_in(prompts: list[str | None], answers: list[str | None], model: Languages, refusals: Refusals | None = None) -> list[str | None]:
    """The defect of each pair, in a fixed order of precedence; "maybe" leaves it to the end-of-text model.

    A null prompt counts as an empty one: its answer can be empty, a refusal or cut off.
    """
    prompts = [p or "" for p in prompts]
    out = [ruled(p, a, refusals) for p, a in zip(prompts, answers)]
    open_ = [r for r, x in enumerate(out) if x is None]
    for r, other in zip(open_, other_languages([prompts[r] for r in open_], [answers[r] for r in open_], model)):
        out[r] = "other_language" if other else "truncated" if is_open(answers[r]) else "maybe"
    return [x or None for x in out]


def defect(prompt: str | None, answer: str | None, model: Languages, refusals: Refusals | None = None) -> str | None:
    return found_in([prompt], [answer], model, refusals)[0]


# ---- end of text

_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))


def contexts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, order, key, ends) for each position of the texts and order: the key hashes the last
    characters; ends says whether text or sentence ends there."""
    whole = "".join(f"\x02{t}\x03" for t in texts)
    c = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts)), size)
    start = np.repeat(np.cumsum(size) - size, size)
    i = np.arange(len(c))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(c), _MUL)]).astype(np.uint64))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(c), _INV)]).astype(np.uint64))
        s = np.concatenate([[np.uint64(0)], np.cumsum((c + np.uint64(1)) * power[:-1])])
        nxt = np.append(c[1:], 3)
        after = np.append(c[2:], [3, 3])
        ends = (nxt == 3) | (np.isin(nxt, [46, 33, 63]) & np.isin(after, [32, 3]))
        here = (c != 3) & (c != 2)
        out = []
        for k, n in enumerate(ORDERS):
            at = i[here & (i - start + 1 >= n)]
            key = mix64((s[at + 1] - s[at + 1 - n]) * back[at + 1 - n] + np.uint64(n))
            out.append((of[at], np.full(len(at), k, np.int8), key.view(np.int64), ends[at]))
    return tuple(np.concatenate(x) for x in zip(*out))


# Behind a mark or a word that ends no sentence. Such words of English, German, Spanish, French.
_HANGING = re.compile(
    r"(?:[,;:(\[{]|\s[-–&+=]|(?:\w+\W+){2}\b(?:the|an?|of|and|or|because|whose|their|every|than|und|oder|der|die|das|den|dem|eine?|einen|weil|dass|el|los|las|una?|porque|que|y|le|les|une|et|du|des|parce))$"
)
_STOPPED = r"(?:^|[^.])[.!?][\s\"'`*)]*$"
_PROSE = re.compile(r"(?:[^\W\d_]{2,},? ){3}[^\W\d_]+$")


def cut_off(skeletons: DataFrame, asked: DataFrame) -> DataFrame:
    """(h) hashes of those of the distinct skeletons asked (h, text, n, stops) that break off; stops counts the copies with a full stop.

    skeletons (text, n) give the evidence: of each last context, how many of its occurrences end there, with the next
    shorter context's share as prior. A skeleton's own copies are no
    evidence for themselves: without them, the other answers must end there as well. Only in short contexts, or where
    the copies are a large part of the context, they do count, unless the answer hangs at a mark or a function word or
    is prose of which no copy has a full stop. Contexts that many skeletons end with are joined as Spark's adaptive
    execution splits them; counts are combined before the shuffle.
    """

    def all_contexts(batches):
        for b in batches:
            texts, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            if not texts:
                continue
            of, _, key, ends = contexts(texts)
            u, at = np.unique(key, return_inverse=True)
            w = n[of].astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.bincount(at, w * ends).astype(np.int64)), pa.array(np.bincount(at, w).astype(np.int64))], names=["key", "ends", "total"])

    def last_contexts(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            if not texts:
                continue
            of, order, key, ends = contexts(texts)
            edge = (of[1:] != of[:-1]) | (order[1:] != order[:-1])
            last = np.nonzero(np.append(edge, True))[0] if len(of) else np.zeros(0, np.int64)
            group = np.concatenate([[0], np.cumsum(edge)])[: len(of)]
            same = key == key[last][group]
            n, stops = b.column(2).to_numpy(), b.column(3).to_numpy()
            hangs = np.fromiter((bool(_HANGING.search(t[-80:])) for t in texts), bool, len(texts))
            bare = np.fromiter((not k and bool(_PROSE.search(t[-120:])) for t, k in zip(texts, stops.tolist())), bool, len(texts))
            of_last = of[last]
            own = [np.bincount(group, x, len(last)).astype(np.int64) * n[of_last] for x in (same & ends, same)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(of_last)), pa.array(order[last].astype(np.int32)), pa.array(key[last]), *map(pa.array, own), pa.array(hangs[of_last]), pa.array(bare[of_last])],
                names=["h", "ord", "key", "own_ends", "own", "hangs", "bare"],
            )

    counts = skeletons.select("text", "n").mapInArrow(all_contexts, "key long, ends long, total long").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("total").alias("total"))
    last = asked.select("h", "text", "n", "stops").mapInArrow(last_contexts, "h long, ord int, key long, own_ends long, own long, hangs boolean, bare boolean")
    x = last.join(counts.where("ends > 0"), "key")
    each = F.struct("ord", *[F.col(c).cast("double").alias(c) for c in ("ends", "total", "own_ends", "own")])
    x = x.groupBy("h").agg(F.sort_array(F.collect_list(each), asc=False).alias("each"), F.max("hangs").alias("hangs"), F.max("bare").alias("bare"))  # one row an order
    all_ = F.aggregate("each", F.lit(START), lambda m, e: (e["ends"] + PRIOR * m) / (e["total"] + PRIOR))
    other = F.aggregate("each", F.lit(START), lambda m, e: (e["ends"] - e["own_ends"] + PRIOR * m) / (e["total"] - e["own"] + PRIOR))
    longest = F.array_min(F.filter("each", lambda e: e["total"] - e["own"] >= PRIOR))  # orders are numbered from the longest on
    long = longest["ord"] <= [n >= OWN_ORDER for n in ORDERS].count(True) - 1
    tipped = (other < END_SHARE) & (F.col("hangs") | long & (F.col("bare") | (longest["own"] <= OWN_SHARE * longest["total"])))
    return x.where((all_ < END_SHARE) | F.coalesce(tipped, F.lit(False))).select("h")


def lower_words(skeletons: DataFrame) -> np.ndarray:
    """Buckets (2 ** 20 bits) of the words that stand in lower case in a good part of the skeletons' texts."""
    word = skeletons.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\w'])(\p{Ll}{2,}|[ai])(?![\w'])"), 1))).alias("w"), "n")
    seen = word.groupBy((F.crc32("w") % F.lit(1 << 20)).alias("bucket")).agg(F.sum("n").alias("n"))
    total = skeletons.agg(F.sum("n")).first()[0] or 0
    bits = np.zeros(1 << 20, bool)
    bits[seen.where(F.col("n") > max(1.0, LOWER_SHARE * total)).select("bucket").toArrow().column(0).to_numpy()] = True
    return bits


def defects(pairs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(pair_id, defect), one row for each pair with a broken answer.

    Null, blank and placeholder answers are empty; a pair with several defects gets the first of
    empty, copy, refusal, other_language, truncated. Repeated rows each count; an empty table gives
    no row; extra columns don't matter. docs (doc_id, text, lang) help to tell the languages.
    """
    spark = pairs.sparkSession
    stopped = F.coalesce(F.col("answer").rlike(_STOPPED).cast("long"), F.lit(0))
    masked = pairs.select(skeleton(F.col("prompt")).alias("p"), skeleton(F.col("answer")).alias("a"), case_lost(F.col("answer")).alias("lost"), stopped.alias("stops"))
    masked = cut(masked.groupBy("p", "a", "lost").agg(F.count("*").alias("n"), F.sum("stops").alias("stops")), "masked")
    counts, prior, refusing, texts = refined(masked, labelled(docs) if docs is not None else np.zeros((BUCKETS, len(LANGS))))
    skeletons = masked.where("not lost").groupBy(F.col("a").alias("text")).agg(F.sum("n").alias("n"), F.sum("stops").alias("stops"))
    skeletons = cut(skeletons.select(F.xxhash64("text").alias("h"), "text", "n", "stops"), "skeletons")
    model = spark.sparkContext.broadcast((counts.astype(np.float32), prior, refusing.astype(np.float32), texts))
    lower = spark.sparkContext.broadcast(np.packbits(lower_words(skeletons)))

    def run(batches):
        own, refusals, bits = Languages(*model.value[:2]), Refusals(*model.value[2:]), np.unpackbits(lower.value).astype(bool)
        known = lambda w: bool(bits[crc32(w.encode("utf-8", "replace")) & ((1 << 20) - 1)])
        for b in batches:
            answers, lost = b.column(2).to_pylist(), b.column(4).to_pylist()
            found = found_in(b.column(1).to_pylist(), answers, own, refusals)
            text = [cased_skeleton(a, known) if x and f == "maybe" else None for a, x, f in zip(answers, lost, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(found, pa.string()), pa.array(text, pa.string())], names=["pair_id", "h", "found", "text"])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    rows = pairs.select("pair_id", "prompt", "answer", F.xxhash64(skeleton(F.col("answer"))).alias("h"), case_lost(F.col("answer")).alias("lost"))
    found = rows.mapInArrow(run, f"pair_id {kind}, h long, found string, text string").where("found is not null")
    found = cut(found.withColumn("h", F.when(F.col("text").isNotNull(), F.xxhash64("text", F.lit("case"))).otherwise(F.col("h"))), "defects")
    more = found.where("text is not null").select("h", "text").distinct().withColumn("n", F.lit(0).cast("long")).withColumn("stops", F.lit(1).cast("long"))  # they are no evidence, so none of their own
    # What is as short as a name or two may be the beginning of anything and yet whole.
    cut_ = cut_off(skeletons, skeletons.unionByName(more).where(F.length("text") >= NAME_LIKE))
    x = found.where("found = 'maybe'").select("pair_id", "h").join(cut_, "h", "left_semi").select("pair_id", F.lit("truncated").alias("defect"))
    return found.where("found <> 'maybe'").select("pair_id", F.col("found").alias("defect")).unionByName(x)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "pairs"), table(spark, sf_dir, "documents"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by defect and category."""
    pairs = table(spark, sf_dir, "pairs")
    return defects(pairs, table(spark, sf_dir, "documents")).join(pairs.select("pair_id", "category"), "pair_id").groupBy("defect", "category").count().withColumnRenamed("count", "pairs")
