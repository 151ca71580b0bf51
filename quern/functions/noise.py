"""noise in prompts, fixed by a hash of a seed."""

from __future__ import annotations

import hashlib
import random
import re
import string

import pandas as pd
from pyspark.sql import functions as F


def _rnd(seed: str) -> random.Random:
    return random.Random(hashlib.md5(seed.encode()).digest())


def typo(word: str, seed: str, edits: int = 1) -> str:
    """random edits of a word: a letter left out, put in, changed, or swapped with the next."""
    rnd = _rnd(seed)
    for _ in range(edits):
        if not word:
            return word
        i, c = rnd.randrange(len(word)), rnd.choice(string.ascii_lowercase)
        word = rnd.choice([word[:i] + word[i + 1 :] if len(word) > 1 else word, word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i : i + 2][::-1] + word[i + 2 :]])
    return word


def typo_title(title: str, seed: str, edits: int = 1) -> str:
    """the same in one word of a title, a longer one if there is one."""
    ws = title.split()
    if not ws:
        return title
    at = _rnd(seed + "|word").choice([i for i, w in enumerate(ws) if len(w) > 4] or range(len(ws)))
    return " ".join([*ws[:at], typo(ws[at], seed, edits), *ws[at + 1 :]])


# Small words that may be dropped, contractions, casual words; the shares of prompts with each kind of noise.
SMALL = frozenset("the a of to in from my this is".split())
CONTRACTED = {"what is": "whats", "do not": "dont", "can not": "cant", "cannot": "cant", "i am": "im", "it is": "its", "how is": "hows", "who is": "whos"}
LEADS, TAILS = ["hey", "ok so", "quick one:", "so", "yo"], [" pls", " thx", "?", "??"]
SHARES = {"dropped": 0.15, "typo": 0.05, "small": 0.2, "bare": 0.2, "contracted": 0.1, "casual": 0.19}


def noisy(prompt: str, seed: str) -> tuple[str, list[str]]:
    """(prompt, kinds of noise applied). Words with braces, underscores or digits are left alone."""
    kinds = [k for k, share in SHARES.items() if _rnd(f"{seed}|{k}").random() < share]
    done = []
    for k in kinds:
        rnd, ws = _rnd(f"{seed}|{k}|at"), prompt.split(" ")
        plain = [i for i, w in enumerate(ws) if not re.search(r"[{}_\d]", w)]
        new = prompt
        if k == "dropped":
            at = [i for i in plain if re.sub(r"[^\w']", "", ws[i]).lower() in SMALL]
            gone = set(rnd.sample(at, rnd.randint(1, min(2, len(at))))) if at else set()
            new = " ".join(w for i, w in enumerate(ws) if i not in gone)
        elif k == "typo":
            at = [i for i in plain if len(re.sub("[^A-Za-z]", "", ws[i])) > 4]
            if at:
                i = rnd.choice(at)
                new = " ".join([*ws[:i], typo(ws[i], f"{seed}|{i}"), *ws[i + 1 :]])
        elif k == "small":
            new = prompt.lower() if "_" not in prompt else prompt[:1].lower() + prompt[1:]
        elif k == "bare":
            new = prompt.rstrip("?.! ")
        elif k == "contracted":
            new = re.sub(r"(?i)\b(?:" + "|".join(CONTRACTED) + r")\b", lambda m: CONTRACTED[m[0].lower()], prompt)
        elif k == "casual":
            new = (rnd.choice(LEADS) + " " + prompt[:1].lower() + prompt[1:] if rnd.random() < 0.55 else prompt) + (rnd.choice(TAILS) if rnd.random() < 0.55 else "")
        if new != prompt:
            prompt = new
            done.append(k)
    return prompt, done


def noisy_udf(text: str, id_: str):
    def run(t: pd.Series, i: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([noisy(x, f"f26|{k}") for x, k in zip(t, i)], columns=["noisy", "kinds"])

    return F.pandas_udf(run, "struct<noisy: string, kinds: array<string>>")(text, F.col(id_).cast("string"))
