"""What a message asks to be done with a text, in which style, or about the last answer. Pure functions and Arrow forms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

# Bounds of a request and of a result; kinds of characters that both may have.
REQUEST_MAX, RESULT_MAX = 127, 255
_PLAIN = re.compile(r"[ -~]+")
# Politeness around a request.
_POLITE = r"(?:(?:hi|hello|hey|please|pls|plz|can|could|would|will|you|now|ok|okay|so|just|also|i want(?: you)? to|i need(?: you)? to|tell me|give me|show me|let me see)[, ]+)*"
_THANKS = r"(?:[ ,]+(?:please|pls|plz|thanks|thank you))*[ ?.!]*"
# Words around the text of a request.
_NOUN = r"(?:the |this |my )?(?:following )?(?:text|string|word|phrase|sentence)s?"
_OF = rf"(?: *: *| +(?:of|in|from|on)? *(?:{_NOUN} *:? +)?(?:: *)?)"
_NUMBERS = {w: k for k, w in enumerate("one two three four five six seven eight nine ten".split(), 1)}


def _times(s: str) -> int:
    return _NUMBERS.get(s, 0) or int(s)


def _title(t: str) -> str:
    return re.sub(r"[A-Za-z]+", lambda m: m[0][0].upper() + m[0][1:].lower(), t)


def _words(t: str) -> list[str]:
    return t.split()


def _repeat(t: str, n: str) -> str | None:
    k = _times(n)
    return " ".join([t] * k) if 1 <= k <= 20 else None


def _letters(t: str) -> str:
    return re.sub(r"[^a-z0-9]", "", t.lower())


# the operations on a text, by name; results are texts.
OPERATIONS = {
    "upper": str.upper, "lower": str.lower, "title": _title, "capitalize": lambda t: t[:1].upper() + t[1:].lower(), "reverse": lambda t: t[::-1], "reverse_words": lambda t: " ".join(_words(t)[::-1]),
    "count_letters": lambda t: str(len(re.findall("[A-Za-z]", t))), "count_chars": lambda t: str(len(t)), "count_chars_nospace": lambda t: str(len(t) - t.count(" ")), "count_words": lambda t: str(len(_words(t))), "count_vowels": lambda t: str(len(re.findall("(?i)[aeiou]", t))),
    "remove_spaces": lambda t: t.replace(" ", ""), "repeat": _repeat, "replace": lambda t, a, b: t.replace(a, b) if a else None, "initials": lambda t: " ".join(w[0].upper() + "." for w in _words(t)), "acronym": lambda t: "".join(w[0] for w in _words(t)).upper(),
    "sort_words": lambda t: " ".join(sorted(_words(t))), "first_word": lambda t: (_words(t) or [""])[0], "last_word": lambda t: (_words(t) or [""])[-1], "palindrome": lambda t: "yes" if _letters(t) and _letters(t) == _letters(t)[::-1] else "no", "spell": lambda t: "-".join(t.replace(" ", "")),
}
# the ways of asking for each: {t} is the text, {of} what may join it, a, b and n other arguments. The first that fits counts.
_ASKS = [
    ("reverse_words", "(?:reverse|flip) (?:the )?(?:word order|order of (?:the )?words|words){of}{t}"), ("reverse_words", "(?:put|place|arrange) (?:the )?words (?:of|in) {t} in reverse order"), ("sort_words", "(?:sort|order|arrange|alphabeti[sz]e)(?: (?:the )?words)?(?: alphabetically| in alphabetical order)?{of}{t}"),
    ("count_chars_nospace", "(?:how many|count(?: the)?) (?:characters|chars)(?: are)?(?: there)? (?:without|excluding|ignoring|not counting)(?: the)? spaces(?: are)?{of}{t}"), ("count_chars_nospace", "(?:how many|count(?: the)?) (?:characters|chars)(?: are)?{of}{t} (?:without|excluding|ignoring|not counting)(?: the)? spaces"),
    ("count_letters", "(?:how many|count(?: the)?|number of) letters(?: are)?(?: there)?{of}{t}"), ("count_words", "(?:how many|count(?: the)?|number of) words(?: are)?(?: there)?{of}{t}"), ("count_vowels", "(?:how many|count(?: the)?|number of) vowels(?: are)?(?: there)?{of}{t}"), ("count_chars", "(?:how many|count(?: the)?|number of) (?:characters|chars)(?: are)?(?: there)?{of}{t}"),
    ("remove_spaces", "(?:remove|delete|strip)(?: all)?(?: the)? spaces{of}{t}"), ("repeat", "(?:repeat|say|write){of}{t} (?P<n>\\d{{1,2}}|two|three|four|five|six|seven|eight|nine|ten) times"), ("replace", "(?:replace|change|swap)(?: all| every| each| the)?(?: letter| word)? (?P<a>\\S+) (?:with|by|to|for) (?P<b>\\S+)(?: in| of){of}{t}"),
    ("initials", "(?:what are )?(?:the )?initials{of}{t}"), ("acronym", "(?:what is |whats |make )?(?:the |an )?acronym(?: for)?{of}{t}"), ("first_word", "(?:what is |whats )?(?:the )?first word{of}{t}"), ("last_word", "(?:what is |whats )?(?:the )?last word{of}{t}"),
    ("palindrome", "(?:check (?:if|whether) |is |whether |if ){t}(?: is)? an? palindrome"), ("spell", "spell(?: out)?{of}{t}"), ("reverse", "(?:reverse|flip){of}{t}"), ("reverse", "(?:write|say|spell){of}{t} backwards"),
    ("upper", "(?:uppercase|upper case|caps|capitals){of}{t}"), ("upper", "(?:make|convert|turn|change|write|put){of}{t} (?:to |into |in )?(?:all )?(?:uppercase|upper case|caps|capitals|capital letters)"), ("lower", "(?:lowercase|lower case){of}{t}"), ("lower", "(?:make|convert|turn|change|write|put){of}{t} (?:to |into |in )?(?:all )?(?:lowercase|lower case|small letters)"),
    ("title", "title ?case{of}{t}"), ("title", "(?:make|convert|turn|change|write|put){of}{t} (?:to |into |in )?title ?case"), ("capitali[sz]e", "capitali[sz]e{of}{t}"),
]
_ASKS = [("capitalize" if op.startswith("capitali") else op, re.compile(_POLITE + p.format(t="(?P<t>.+?)", of=_OF) + _THANKS, re.I)) for op, p in _ASKS]
#: Each of _ASKS has one of these in it.
_HINTS = "word sort order arrange alphabeti char letters vowels spaces times replace change swap initials acronym palindrome spell reverse flip backwards upper caps capital lower small title".split()
# Words that make it a request about programs, files or other things than a text; what can't be a text of its own.
_OTHER = re.compile(r"\b(?:python|java|javascript|code|function|script|program|file|folder|directory|linux|bash|shell|terminal|command|sql|regex|array|list|variable|dictionary|website|document|csv|json|table|rows|columns|items)s?\b", re.I)
_EMPTY = re.compile(r"(?:a|an|my|your|our|some|any|it|its|them|that|those|these|something|anything|everything|a word|words|text|a text|a string|this|the|of|in)", re.I)
_QUOTES = re.compile(r"([\"'`])(.*)\1", re.S)
# F32: a question about an operation, not a request for it.
_ABOUT = re.compile(rf"{_POLITE}(?:what (?:does|do|is|are)(?! the (?:first|last|initials|acronym))|whats|why|who|when|where|how (?:do|does|can|to)|explain|define|what's)\b.*\b(?:uppercase|lowercase|capital|revers|palindrome|acronym|initial|vowel|spell|sort|title case|repeat)", re.I)


def about_operation(q: str) -> bool:
    """F32."""
    return bool(_ABOUT.match(q)) and not _QUOTES.search(q)


def text_request(q: str | None) -> tuple[str, str] | None:
    """(operation, result) of a request for one of OPERATIONS; null for other messages and where a bound is passed."""
    if not q or len(q) > REQUEST_MAX or not _PLAIN.fullmatch(q):
        return None
    low = q.lower()
    if not any(h in low for h in _HINTS) or about_operation(q):
        return None
    for op, pattern in _ASKS:
        if not (m := pattern.fullmatch(q.strip())):
            continue
        text, args = m["t"].strip(), {k: v.strip("\"'`") for k, v in m.groupdict().items() if k != "t" and v}
        if quoted := _QUOTES.fullmatch(text):
            text = quoted[2]
        elif _OTHER.search(text) or _EMPTY.fullmatch(text):
            return None
        out = OPERATIONS[op](text, *args.values()) if text else None
        return (op, out) if out is not None and len(out) <= RESULT_MAX else None
    return None


_LENGTH = re.compile(r" *(?P<head>(?:the )?length of|how long is) +(?:the )?(?P<noun>word |string |text )?(?P<t>.+?)[ .!?]*", re.I)


def length_literal(q: str | None) -> tuple[str, bool] | None:
    """the text whose length is asked for, and whether a noun says that it is one; how long is needs the noun."""
    if not q or len(q) > REQUEST_MAX or not _PLAIN.fullmatch(q) or not (m := _LENGTH.fullmatch(q)):
        return None
    typed, t = bool(m["noun"]), m["t"].strip()
    if m["head"].lower().startswith("how") and not typed:
        return None
    if t[:1] in "'\"":
        return (t[1:-1], typed) if len(t) > 2 and t[-1] == t[0] else None
    if not re.fullmatch(r"(?i)[a-z0-9_ -]+" if typed else r"(?i)[a-z0-9_-]+", t) or not typed and t.lower() in ("it", "this", "that", "he", "she", "they", "you"):
        return None
    return t, typed


# The styles by their names.
STYLES = {"upper": r"(?:all )?(?:caps|capitals|uppercase|upper case|capital letters|block letters)", "lower": r"(?:all )?(?:lowercase|lower case|small letters)", "title": r"title ?case"}
_TALK = r"(?:answer|reply|respond|talk|speak|write|say|tell me|give me|explain|use)"


def style_request(q: str | None) -> tuple[str, str, str] | None:
    """(kind, style, inner text): literal: the text itself in the style; wrap: the answer to the rest, asked by a verb; prefix,
    suffix: the same without one; free: a style for what follows. Null for other messages."""
    if not q or len(q) > REQUEST_MAX or not _PLAIN.fullmatch(q):
        return None
    q = q.strip()
    if m := re.fullmatch(rf"{_POLITE}(?:shout|yell|scream)[ :]+(?P<t>.+)", q, re.I):
        return "literal", "upper", _bare(m["t"])
    for style, names in STYLES.items():
        if re.fullmatch(rf"{_POLITE}(?:from now on[, ]+|always )?{_TALK}(?: only| everything| to me| me)?(?: in| using)? {names}(?: only| from now on| always)?{_THANKS}", q, re.I):
            return "free", style, ""
        if m := re.fullmatch(rf"{_POLITE}(?:say|print|write|type|repeat) (?P<t>.+?) (?:in |as ){names}{_THANKS}", q, re.I):
            return "literal", style, _bare(m["t"])
        if m := re.fullmatch(rf"{_POLITE}{_TALK}(?: me)?(?: in| using) {names}[ :,]+(?P<t>.+)", q, re.I):
            return "wrap", style, m["t"].strip()
        if m := re.fullmatch(rf"{_POLITE}(?:in )?{names}(?: please)? *[:,] *(?P<t>.+)", q, re.I):
            return "prefix", style, m["t"].strip()
        if m := re.fullmatch(rf"{_POLITE}(?P<t>.+?)[ ,]+\(?(?:{_TALK} )?(?:in|using) {names}\)?{_THANKS}", q, re.I):
            return "suffix", style, m["t"].strip()
    return None


def _bare(t: str) -> str:
    t = t.strip()
    m = _QUOTES.fullmatch(t)
    return m[2] if m else t


def styled(style: str, text: str) -> str:
    """F28."""
    return {"upper": str.upper, "lower": str.lower, "title": _title}[style](text)


# Short spellings.
_SHORT = {"u": "you", "r": "are", "ur": "your", "ure": "you are", "whats": "what is", "whos": "who is"}


def spelled_out(q: str) -> str:
    """short spellings written out, greetings before and politeness behind it off."""
    ws = [_SHORT.get(w, w) for w in re.sub(r"[^a-z0-9 ]", "", q.lower()).split()]
    while ws and ws[0] in ("hey", "hi", "hello", "yo", "so", "ok", "okay"):
        ws = ws[1:]
    while ws and ws[-1] in ("please", "pls", "plz", "tho", "thanks"):
        ws = ws[:-1]
    return " ".join(ws)


# Pronouns, and words that don't name anything.
_PRONOUNS = frozenset("he she it they him her them his its their".split())


def with_entity(q: str, entity: str | None, ent_stop: frozenset[str]) -> str | None:
    """the question with the last entity for its pronouns; null if there is none, it names something itself or gets too long."""
    if not entity or not _PLAIN.fullmatch(q):
        return None
    ws = re.findall(r"[a-z0-9']+", q.lower())
    if _PRONOUNS.isdisjoint(ws) or any(w not in _PRONOUNS and w not in ent_stop for w in ws):
        return None
    out = re.sub(r"[A-Za-z0-9']+", lambda m: entity if m[0].lower() in _PRONOUNS else m[0], q).strip()
    return out if len(out) <= REQUEST_MAX else None


# Follow-ups; of more than one word anywhere in the message where marked so.
_FOLLOW = [
    ("style_off", True, "normal|stop the caps|no more caps|normal case|back to normal|stop shouting|normal letters"), ("cancel", False, "cancel|stop|never mind|nevermind|forget it|nothing|leave it"), ("push", True, "are you sure|thats wrong|that is wrong|not true|wrong|really|no way|i dont think so"),
    ("repeat", False, "again|repeat|repeat that|say that again|what|what did you say|come again|once more|pardon"), ("first", False, "first|the first|first one|the first one|one|1"), ("second", False, "second|the second|second one|the second one|the other|the other one|other|two|2"),
]


def follow_up(q: str | None) -> str | None:
    """repeat, push, cancel, style_off, first or second; null for what stands for itself, and beyond ten words."""
    if not q or not _PLAIN.fullmatch(q):
        return None
    ws = [w.replace("'", "") for w in re.findall(r"[a-z0-9']+", q.lower())]
    while ws and ws[0] in ("ok", "okay", "so", "well", "and", "hey", "hi", "uh", "um", "oh", "no", "please", "hmm") and len(ws) > 1:
        ws = ws[1:]
    while ws and ws[-1] in ("please", "pls", "thanks"):
        ws = ws[:-1]
    if not 0 < len(ws) <= 10:
        return None
    text = " ".join(ws)
    return next((kind for kind, inside, ps in _FOLLOW for p in ps.split("|") if text == p or inside and " " in p and f" {p} " in f" {text} "), None)


def act(q: str | None) -> str | None:
    """R2: mash (no word one could read), file (a path or a file's name), pronoun (asks about what was said), else null."""
    if not q:
        return None
    ws = re.findall(r"[a-z]+", q.lower())
    if ws and (not any(re.search("[aeiouy]", w) for w in ws) or re.fullmatch(r"(.)\1{3,}", "".join(ws))):
        return "mash"
    if re.search(r"(?<!\w)(?:~|\.{0,2}/)[\w./-]+|\b[\w-]+\.(?:txt|md|py|csv|log|json|sh)\b", q):
        return "file"
    return "pronoun" if not _PRONOUNS.isdisjoint(ws) else None


def udf(f, kind: str):
    """An Arrow form of a function of one text; null gives null."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in s], dtype=object)

    return F.pandas_udf(run, kind)


def struct_udf(f, fields: list[str]):
    """The same for a function that gives a tuple of texts or null."""

    def run(s: pd.Series) -> pd.DataFrame:
        got = [f(x) for x in s]
        return pd.DataFrame([[None] * len(fields) if x is None else [None if v is None else str(v) for v in x] for x in got], columns=fields, dtype=object)

    return F.pandas_udf(run, "struct<" + ", ".join(f"{n}: string" for n in fields) + ">")
