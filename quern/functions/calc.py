"""A calculator on fixed-point numbers, number series, numbers in words."""

from __future__ import annotations

import ast
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Decimals are kept to a ten-thousandth, magnitudes below 2**63, brackets and signs nest this deep.
SCALE, LIMIT, DEPTH = 10_000, 2**63 - 1, 8
#: What an expression of calc(...) may consist of.
ALPHABET = r"[0-9 +\-*/().%]+"


def _div(a: int, b: int) -> int:
    """Quotient rounded half away from zero."""
    q = (2 * abs(a) + abs(b)) // (2 * abs(b))
    return q if (a < 0) == (b < 0) else -q


def _held(v: int | None) -> int | None:
    return None if v is None or abs(v) > LIMIT else v


def _number(t: str) -> int | None:
    whole, _, part = t.partition(".")
    return _held(int(whole or 0) * SCALE + int((part + "0000")[:4]) + (part[4:5] >= "5"))


# None stands for an error (overflow, division by zero) and makes every result None.
_BINARY = {
    "+": lambda a, b: _held(a + b),
    "-": lambda a, b: _held(a - b),
    "*": lambda a, b: None if _held(a * b) is None else _div(a * b, SCALE),
    "/": lambda a, b: None if b == 0 or _held(a * SCALE) is None else _div(a * SCALE, b),
    "%": lambda a, b: None if b == 0 else abs(a) % abs(b) * (-1 if a < 0 else 1),
}
_LEVELS = ("+-", "*/%")


class _Reader:
    """A chain of operands joined by the operators of its level; an operand is a chain of the next level, at last a sign,
    a bracket or a number. The whole text is read even when an error is certain, since a fault of syntax comes first."""

    def __init__(self, text: str):
        self.t = re.findall(r"\d+\.?\d*|\.\d+|[^ ]", text)
        self.i = 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def chain(self, depth: int, level: int = 0) -> int | None:
        operand = (lambda: self.chain(depth, level + 1)) if level + 1 < len(_LEVELS) else (lambda: self.operand(depth))
        v = operand()
        while self.peek() and self.peek() in _LEVELS[level]:
            op = _BINARY[self.peek()]
            self.i += 1
            w = operand()
            v = None if v is None or w is None else op(v, w)
        return v

    def operand(self, depth: int) -> int | None:
        if depth > DEPTH:
            raise SyntaxError
        t = self.peek()
        self.i += 1
        if t in ("+", "-"):
            v = self.operand(depth + 1)
            return -v if t == "-" and v is not None else v
        if t == "(":
            if depth == DEPTH:
                raise SyntaxError
            v = self.chain(depth + 1)
            if self.peek() != ")":
                raise SyntaxError
            self.i += 1
            return v
        if not t or t[-1] not in "0123456789." or t == ".":
            raise SyntaxError
        return _number(t)


def show(v: int) -> str:
    s = f"{abs(v) // SCALE}.{abs(v) % SCALE:04d}".rstrip("0").rstrip(".")
    return "-" + s if v < 0 and s != "0" else s


def evaluate(text: str) -> str | None:
    """The value with at most four decimals, "error" on overflow or division by zero, None if it is no expression or nests too deep."""
    r = _Reader(text)
    try:
        v = r.chain(0)
    except SyntaxError:
        return None
    return None if r.i != len(r.t) else "error" if v is None else show(v)


def apply_calc(answer: str) -> str:
    """M1: calc(...) with its value behind it, or with error; anything else as it is."""
    m = re.fullmatch(rf"[ \t\n\r\v\f]*calc\(({ALPHABET})\)[ \t\n\r\v\f]*", answer)
    v = evaluate(m[1]) if m else None
    return answer if v is None else f"calc({m[1].strip(' ')}) = {v}"


# Number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def spell(n: int) -> str:
    """F39."""
    if n < 0:
        return "minus " + spell(-n)
    if n < 20:
        return UNITS[n]
    if n < 100:
        return TENS[n // 10 - 2] + (f" {UNITS[n % 10]}" if n % 10 else "")
    for size, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            return f"{spell(n // size)} {name}" + (f" {spell(n % size)}" if n % size else "")
    raise ValueError(n)


def unspell(words: str) -> int | None:
    total = part = 0
    for w in words.replace("-", " ").replace(" and ", " ").split():
        if w in UNITS:
            part += UNITS.index(w)
        elif w in TENS:
            part += 20 + 10 * TENS.index(w)
        elif w == "hundred":
            part *= 100
        elif w in ("thousand", "million", "billion"):
            total, part = total + part * 1000 ** ("thousand million billion".split().index(w) + 1), 0
        else:
            return None
    return total + part


# The ways of asking for an operation, numbers first to last ({0}, {1}).
_QUESTION = r"(?:what is |what's |whats |how much is )?"
_FORMS = [(rf"{_QUESTION}#NUM# (?:{words}) #NUM#", "{0}" + op + "{1}") for words, op in ((r"plus|\+", "+"), (r"minus|-", "-"), (r"times|\*|x", "*"), (r"divided by|/", "/"))] + [
    ("add #NUM# and #NUM#", "{0}+{1}"), ("multiply #NUM# by #NUM#", "{0}*{1}"), ("divide #NUM# by #NUM#", "{0}/{1}"), ("subtract #NUM# from #NUM#", "{1}-{0}"),
]
_FORMS = [(re.compile(p.replace("#NUM#", r"(-?\d+(?:\.\d+)?)")), out) for p, out in _FORMS]


def extract_expr(question: str) -> str | None:
    """the expression of a question that asks for one operation on two numbers and nothing else; negative numbers in brackets."""
    q = question.strip().rstrip("?.! ").lower()
    for pattern, out in _FORMS:
        if m := pattern.fullmatch(q):
            return out.format(*(f"({n})" if n.startswith("-") else n for n in m.groups()))
    return None


_NUMBER = re.compile(rf"\b(?:(?:(?:hundred|thousand|million)(?: and)?|{'|'.join(sorted(UNITS + TENS, key=len, reverse=True))})\b[ -]?)+", re.I)

#: How any question begins that extract_expr takes, once its numbers are digits.
_BEGINS = re.compile(rf"\s*(?:what\s+is\s+|what's\s+|whats\s+|how\s+much\s+is\s+)?(?:add|multiply|divide|subtract|-?(?:\d|hundred|thousand|million|{'|'.join(UNITS + TENS)}))", re.I)


def spoken_expr(question: str) -> str | None:
    """the same with numbers in words."""
    if not _BEGINS.match(question):
        return None

    def digits(m: re.Match) -> str:
        n = unspell(m[0].lower().strip(" -"))
        return m[0] if n is None else f"{n} "

    return extract_expr(re.sub(r"\s+", " ", _NUMBER.sub(digits, question)))


# M2: functions of a formula, rounded to a ten-thousandth; an exponent is a whole number of at most 8.
_CALLS = {"sin": math.sin, "cos": math.cos, "sqrt": math.sqrt, "abs": abs}


class _Formula(ast.NodeVisitor):
    """A formula in x as scaled whole numbers; ValueError for what it can't hold."""

    def __init__(self, x: int):
        self.x = x

    def generic_visit(self, node):
        raise ValueError

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Name(self, node):
        if node.id not in ("x", "n"):
            raise ValueError
        return self.x

    def visit_Constant(self, node):
        if type(node.value) not in (int, float):
            raise ValueError
        return _number(f"{node.value:.5f}")

    def visit_UnaryOp(self, node):
        v = self.visit(node.operand)
        return -v if isinstance(node.op, ast.USub) else v

    def visit_BinOp(self, node):
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Pow):
            if b % SCALE or abs(b) > 8 * SCALE:
                raise ValueError
            v = SCALE
            for _ in range(abs(b) // SCALE):
                v = _BINARY["*"](v, a)
            out = v if b >= 0 else _BINARY["/"](SCALE, v)
        else:
            out = _BINARY[{ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%"}[type(node.op)]](a, b)
        if out is None:
            raise ValueError
        return out

    def visit_Call(self, node):
        if not isinstance(node.func, ast.Name) or node.func.id not in _CALLS or len(node.args) != 1 or node.keywords:
            raise ValueError
        return _div(round(_CALLS[node.func.id](self.visit(node.args[0]) / SCALE) * 10**9), 10**5)


def formula(text: str, x: int) -> str | None:
    """The value of a formula at x (scaled); null outside its domain."""
    try:
        return show(_Formula(x).visit(ast.parse(text.strip().replace("^", "**"), mode="eval")))
    except (ValueError, SyntaxError, KeyError, TypeError, ZeroDivisionError, OverflowError):
        return None


# The requests of a series.
_SERIES = [
    (re.compile(r"(?:plot|graph) (.+?) from (-?[\d.]+) to (-?[\d.]+)(?: with (\d+) points)?\??"), "plot"),
    (re.compile(r"(?:show |make a )?table of (.+?) for [xn] (?:from )?(-?\d+) to (-?\d+)()\??"), "table"),
    (re.compile(r"(?:show )?bars for (-?[\d., -]+)()()()\??"), "bars"),
]


def series(request: str, most: int = 64) -> list[tuple[str, str]] | None:
    """M2: the rows (x, y) of a plot, a table or bars that are asked for; null for other texts and beyond most points."""
    q = re.sub(r"^(?:(?:please|can you|could you) )+", "", request.strip().lower())
    for pattern, kind in _SERIES:
        if not (m := pattern.fullmatch(q)):
            continue
        if kind == "bars":
            values = [v.strip() for v in m[1].split(",")]
            return [(str(i + 1), show(_number(v.lstrip("-")) * (-1 if v.startswith("-") else 1))) for i, v in enumerate(values)] if all(re.fullmatch(r"-?\d+(?:\.\d+)?", v) for v in values) and len(values) <= most else None
        try:
            lo, hi = (round(float(v) * SCALE) for v in (m[2], m[3]))
        except ValueError:
            return None
        points = int(m[4]) if m[4] else (hi - lo) // SCALE + 1 if kind == "table" else 25
        if not 1 <= points <= most or hi < lo:
            return None
        xs = [lo if points == 1 else lo + _div((hi - lo) * k, points - 1) for k in range(points)]
        ys = [formula(m[1], x) for x in xs]
        return None if None in ys else [(show(x), y) for x, y in zip(xs, ys)]
    return None


def _text(f):
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in s], dtype=object)

    return F.pandas_udf(run, StringType())


def calc_udf():
    return _text(apply_calc)


def expr_udf():
    return _text(extract_expr)


def spoken_udf():
    return _text(spoken_expr)
