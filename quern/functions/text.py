"""Text functions as column expressions: they stay in whole-stage code generation."""

from __future__ import annotations

import calendar
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.isspace accepts.
SPACE = " \t\n\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　"
# Patterns of a declining answer, for lower-case text.
REFUSALS = [
    r"\bi (can'?t|cannot|won'?t|will not)\b",
    r"\bi'?m (not able|unable) to\b",
    r"\bas an ai\b",
    r"\bi'?m sorry, but\b",
    r"\bi apologize\b",
]
REFUSAL = "|".join(REFUSALS)


def strip(c) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def word_list(c) -> Column:
    """lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def word_set(c) -> Column:
    return F.array_distinct(word_list(c))


def space_words(c) -> Column:
    """Words between blanks; null for null."""
    return F.regexp_extract_all(c, F.lit(f"([^{SPACE}]+)"), 1)


def normalize_key(c) -> Column:
    """lower case, punctuation deleted, blanks collapsed."""
    kept = F.regexp_replace(F.lower(c), f"[^a-z0-9{SPACE}]", "")
    return F.trim(F.regexp_replace(kept, f"[{SPACE}]+", " "))


def once(c: Column, f) -> Column:
    """f(c) with c evaluated a single time, though f uses it often."""
    return F.element_at(F.transform(F.array(c), f), 1)


def ngrams(words: Column, n: int) -> Column:
    """distinct runs of n words; fewer words than n give none."""
    none = F.array().cast("array<string>")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return once(words, lambda w: F.when(F.size(w) >= n, F.array_distinct(runs(w))).otherwise(none))


def is_refusal(c) -> Column:
    """P2."""
    return F.lower(c).rlike(REFUSAL)


def variants(w: Column) -> Column:
    """the word and what is left when one letter is deleted."""
    cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.concat(F.array(w), F.when(F.length(w) > 0, cut).otherwise(F.array().cast("array<string>"))))


def fnv1a(w: Column) -> Column:
    """F16: 32-bit FNV-1a over ASCII text."""
    codes = F.transform(F.split(w, ""), lambda ch: F.ascii(ch).cast("long"))
    return F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def edit1(a: Column, b: Column) -> Column:
    """one substitution, insertion, deletion or swap of neighbours apart."""
    swap = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )
    return (F.levenshtein(a, b) == 1) | swap


def title_style(c) -> Column:
    """upper case for a letter behind anything but a letter, lower case for the others."""
    chars = F.split(F.lower(c), "")
    return F.aggregate(chars, F.lit(""), lambda out, ch: F.concat(out, F.when(out.rlike("[A-Za-z]$"), ch).otherwise(F.upper(ch))))


def prominence(n: Column) -> Column:
    """M3."""
    return F.least(F.lit(63), F.floor(F.lit(4) * F.log2(F.lit(1) + n / F.lit(32))).cast("int"))


def hash_order(seed: str, *ids) -> Column:
    """L1: a key whose order is a fixed permutation for each seed."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in ids]))


def sha1_bucket(c, buckets: int = 5) -> Column:
    """First byte of the SHA-1, modulo buckets."""
    return (F.conv(F.substring(F.sha1(c), 1, 2), 16, 10).cast("int") % buckets).cast("int")


#: Where Python's str.splitlines breaks.
_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def first_line(c, prompt=None) -> Column:
    """first line that isn't blank, blanks collapsed; an echo of the prompt before it doesn't count."""
    if prompt is not None:
        begin = F.regexp_replace(c, f"^[{SPACE}]+", "")
        echo = (F.length(prompt) > 0) & F.startswith(F.lower(begin), F.lower(prompt))
        c = F.when(echo, F.substring(begin, F.length(prompt) + 1, F.length(begin))).otherwise(c)
    lines = F.transform(F.split(c, _BREAK), lambda x: strip(F.regexp_replace(x, f"[{SPACE}]+", " ")))
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))


def answer_norm(c) -> Column:
    """lower case, blanks collapsed, quotes around it and final punctuation off."""
    c = strip(F.regexp_replace(F.lower(c), f"[{SPACE}]+", " "))
    return F.regexp_replace(F.regexp_replace(c, "^[`\"' \t]+|[`\"' \t]+$", ""), "[.!?,;:]+$", "")


def whole_words(c, part) -> Column:
    """part stands in c and no word goes on before or behind it."""
    quoted = F.regexp_replace(part, r"([^\p{L}\p{N}_ ])", r"\\$1")
    return F.regexp(c, F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)")))


def tool_form(c) -> Column:
    """the raw output is one call of calc with an operator in it."""
    return F.coalesce(strip(c).rlike(r"\Acalc\([0-9 .()]*[-+*/%][0-9 .()+\-*/%]*\)\z"), F.lit(False))


def gram_keys(words: Column, n: int) -> Column:
    """F3 as pairs of 64-bit hashes, a run that stands twice given twice: a column of long arrays can be made distinct quickly, one of
    pairs can't, so hits are made distinct where they are few."""
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    pair = lambda w, i: F.struct(F.xxhash64(F.slice(w, i, n)).alias("a"), F.xxhash64(F.lit(n), F.slice(w, i, n)).alias("b"))
    return once(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: pair(w, i))).otherwise(none))


# one expression for each text operation; vowels and letters are ASCII.
def text_operations(c: Column) -> dict[str, Column]:
    ws = F.split(F.trim(F.regexp_replace(c, f"[{SPACE}]+", " ")), " ")
    letters = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return {
        "op_upper": F.upper(c), "op_lower": F.lower(c), "op_title": title_style(c),
        "op_capitalize": F.concat(F.upper(F.substring(c, F.lit(1), F.lit(1))), F.lower(F.substring(c, F.lit(2), F.length(c)))),
        "op_reverse": F.reverse(c), "op_reverse_words": F.array_join(F.reverse(ws), " "),
        "op_count_letters": F.length(F.regexp_replace(c, "[^A-Za-z]", "")).cast("long"), "op_count_chars": F.length(c).cast("long"),
        "op_count_chars_nospace": F.length(F.regexp_replace(c, f"[{SPACE}]", "")).cast("long"), "op_count_words": F.size(F.filter(ws, lambda w: w != "")).cast("long"),
        "op_count_vowels": F.length(F.regexp_replace(F.lower(c), "[^aeiou]", "")).cast("long"), "op_remove_spaces": F.regexp_replace(c, " ", ""),
        "op_repeat": F.array_join(F.array_repeat(c, 3), " "), "op_replace": F.replace(c, F.lit("the"), F.lit("a")),
        "op_initials": F.array_join(F.transform(F.filter(ws, lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, F.lit(1), F.lit(1))), F.lit("."))), " "),
        "op_acronym": F.upper(F.array_join(F.transform(ws, lambda w: F.substring(w, F.lit(1), F.lit(1))), "")),
        "op_sort_words": F.array_join(F.array_sort(ws), " "), "op_first_word": F.element_at(ws, 1), "op_last_word": F.element_at(ws, -1),
        "op_palindrome": letters == F.reverse(letters), "op_spell": F.array_join(F.filter(F.split(F.regexp_replace(c, f"[{SPACE}]", ""), ""), lambda x: x != ""), "-"),
    }


def date_said(iso: Column) -> Column:
    """A date of one of three lengths with on or in before it, - before years BC."""
    year = F.concat(F.abs(F.regexp_extract(iso, r"^-?(\d+)", 1).cast("int")).cast("string"), F.when(F.startswith(iso, F.lit("-")), " BC").otherwise(""))
    month = F.element_at(F.array(*[F.lit(calendar.month_name[m]) for m in range(1, 13)]), F.greatest(F.lit(1), F.coalesce(F.regexp_extract(iso, r"^-?\d+-(\d\d)", 1).try_cast("int"), F.lit(1))))
    day = F.regexp_extract(iso, r"^-?\d+-\d\d-(\d\d)$", 1).try_cast("int").cast("string")
    return F.when(day.isNotNull(), F.concat(F.lit("on "), day, F.lit(" "), month, F.lit(" "), year)).when(iso.rlike(r"^-?\d+-\d\d$"), F.concat(F.lit("in "), month, F.lit(" "), year)).otherwise(F.concat(F.lit("in "), year))


def any_of(c: Column, words: list[str]) -> Column:
    return F.arrays_overlap(c, F.array(*map(F.lit, words)))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)
