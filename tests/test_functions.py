
import pytest
from pyspark.sql import functions as F

from quern.functions import dates, calc, pycode, wiki
from quern.functions import text as T


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("1+2*3", "7"), ("(1+2)*3", "9"), ("10/4", "2.5"), ("1/3", "0.3333"), ("2/3", "0.6667"), ("-7%3", "-1"), ("7%-3", "1"), ("1/0", "error"), ("5%0", "error"),
        ("9223372036854775807", "error"), ("((((((((1))))))))", "1"), ("(((((((((1)))))))))", None), ("1+", None), ("a", None), ("", None), ("0.00005", "0.0001"), ("-0.00005", "-0.0001"), ("1.5 * -2", "-3"),
    ],
)
def test_calculator(text, value):
    assert calc.evaluate(text) == value


def test_calc_answer():
    for given, want in {
        "calc(38*47)": "1786", "calc(1/3)": "0.3333", "calc(2/3)": "0.6667", "calc(-1/8*1)": "-0.125", "calc(5.)": "5", "calc(.00005)": "0.0001", "calc(7%0)": "error", "calc(1/0)": "error", "calc(922337203685477*9)": "error", "calc(-7%3)": "-1",
        "calc(((((((((1))))))))": None, "calc(" + "(" * 8 + "2" + ")" * 8 + ")": "2", "calc(" + "(" * 9 + "2" + ")" * 9 + ")": None, "calc(--------2)": "2", "calc(---------2)": None, "calc(1/0 2)": None, "calc(": None, "twelve": None, "calc(x)": None, "calc()": None, "calc(1 2)": None,
    }.items():
        assert calc.apply_calc(given) == (given if want is None else f"{given} = {want}"), given
    assert calc.apply_calc(" calc( 2 + 2 )\n") == "calc(2 + 2) = 4"


@pytest.mark.parametrize("n", [0, 7, 13, 20, 21, 99, 100, 101, 999, 1000, 12_345, 1_000_001])
def test_spelling_round_trip(n):
    assert calc.unspell(calc.spell(n)) == n


def test_expressions():
    for q, want in {
        "whats 457 times 14?": "457*14", "5 minus -3": "5-(-3)", "Multiply 4 by 6.": "4*6", "subtract 3 from 10": "10-3", "divide 9 by 2": "9/2", "add -1.5 and 2": "(-1.5)+2", "the box is 3 x 4 and red": None, "26 percent of 273": None, "hello": None,
    }.items():
        assert calc.extract_expr(q) == want, q
    assert calc.spoken_expr("what is eighty one minus twenty") == "81-20" and calc.spoken_expr("add two hundred and five and seven") == "205+7"
    assert calc.series("plot 10/x from 1 to 2 with 3 points") == [("1", "10"), ("1.5", "6.6667"), ("2", "5")]
    assert calc.series("please make a table of x^2-1 for x from -1 to 1") == [("-1", "0"), ("0", "-1"), ("1", "0")]
    assert calc.series("show bars for 3, -4.5") == [("1", "3"), ("2", "-4.5")] and calc.series("plot 1/x from -1 to 1 with 3 points") is None and calc.series("graph theory") is None
    assert calc.formula("sqrt(2)+abs(-1)+sin(0)*cos(x)", 0) == "2.4142" and calc.formula("sqrt(-1)", 0) is None and calc.formula("__import__('os')", 0) is None


def test_wiki():
    w = "{{Infobox|name=A{{b|c}}|born=[[3 May]] 1900}}\n'''Foo''' (born 3 May 1900) was a [[painter|house painter]] from [[Bar]], well known there.<ref>x</ref>\n== H ==\nmore"
    assert wiki.lead(w) == "Foo was a house painter from Bar, well known there."
    assert wiki.infobox(w) == {"name": "A", "born": "3 May 1900"}
    assert wiki.infobox("{{Infobox|open") == {}
    assert wiki.sentences("Dr. Foo came. He left! It is 5 p.m. now") == ["Dr. Foo came.", "He left!", "It is 5 p.m. now"]
    assert dates.scan("born 3 Jan 1920 and died March 4th, 1980, June 1950, 300 BCE and 13 Foo 1999, 31 Feb. 1850, 40 May 1700, \x01-0044-03\x02, 12 May 44 BC") == [
        "1920-01-03", "1980-03-04", "1950-06", "-0300", "1999", "1850-02-31", "-0044-03",
    ]
    assert dates.iso(5, 13) is None and dates.iso(44, bc=True) == "-0044" and dates.iso(5, 0, 3) is None and dates.iso(0) is None
    assert [dates.said(x) for x in ("1920-01-03", "1950-06", "-0300", "1950-13", "x")] == ["3 January 1920", "June 1950", "300 BC", None, None] and dates.on_in("-0044-03-15") == "on" and dates.on_in("1950-06") == "in"
    assert wiki.fold("Él Niño – 3") == "el nino 3"
    assert wiki.keys_for("The Foo Bar II (x)")[0] == ("the foo bar ii x", 0)
    assert wiki.strip_markup("a{{b{{c}}d}}e") == "ae"
    assert len(wiki.context_sentence("word " * 60)) <= 100


def test_python_labels():
    assert [pycode.label(c) for c in ("sorted(x)", "x = 1", "for a in b:", "calc(", " x", "except ValueError:", None)] == ["exec", "exec", "block", "fragment", "fragment", "fragment", None]
    assert pycode.same_tree("a+b", "a + b") and not pycode.same_tree("a+b", "a-b")
    assert pycode.names_and_constants("f(x, 1)") == (["f", "x"], ["1"])
    same = lambda a, b: pycode.same_but_parameters(a, b, ["xs", "n"], [3, "hi"])
    assert same("print(xs[3])", "print(ys[5])") and same("f(3)", "f(-4)") and same('print("hi")', "print(hi)") and same("def f(xs): return xs", "def f(q): return q")
    assert not same("xs[::-1]", "xs[::-2]") and not same("print(xs)", "show(xs)") and not same("xs.a", "xs.b") and not same("zs[0]", "ys[0]") and not same("xs + 1", "xs - 1") and not same("f(True)", "f(1)")
    assert [pycode.verdict("print(xs[3])", a, ["xs"], [3]) for a in ("print(xs[3])", "print(q[4])", "print(xs)", "print(", None)] == ["exact", "binding", "operation_or_structure", "syntax", "syntax"]
    assert pycode.verdict("a", "a", [], [], False) == "termination_budget"
    assert pycode.erased("f(xs, 3, ys)", ["xs"], [3]) == "f(_1, _2, ys)" and pycode.erased("(", [], []) is None
    assert pycode.parameters("print(xs[3], len(q))") == (["xs", "q"], [3])


def python_key(t):
    import re

    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", t.lower().strip())).strip()


def test_text_functions_like_python(spark):
    import re

    texts = ["Hello,  World!", "", "  x y ", "it's 5%", "a\tb\nc", "É Ü"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.normalize_key(F.col("t")).alias("k"), T.word_list(F.col("t")).alias("w"), F.size(T.ngrams(T.word_list(F.col("t")), 2)).alias("g")).collect()
    for r in got:
        words = re.sub(r"[^a-z0-9\s]", " ", r.t.lower()).split()
        assert r.k == python_key(r.t) and r.w == words and r.g == len({tuple(words[i : i + 2]) for i in range(len(words) - 1)})


def test_fnv_and_edits(spark):
    df = spark.createDataFrame([("a", "b"), ("captial", "capital"), ("abc", "abcd"), ("abc", "xyz"), ("abc", "abc")], "a string, b string")
    got = df.select(T.fnv1a(F.col("a")).alias("h"), T.edit1(F.col("a"), F.col("b")).alias("e"), F.size(T.variants(F.col("a"))).alias("v")).collect()
    assert got[0].h == 3826002220
    assert [r.e for r in got] == [True, True, True, False, False]


def test_title_style(spark):
    df = spark.createDataFrame([("a-b c3d",), ("don't",), (None,)], "t string")
    assert [r[0] for r in df.select(T.title_style(F.col("t"))).collect()] == ["A-B C3D", "Don'T", None]


def test_question_features_of_all_kinds():
    """Against a plain form, feature by feature."""
    from quern.functions import features as X

    def plain(q):
        b = " ".join(q.encode("ascii", "ignore").decode().lower().split())[:127].rstrip()
        toks, out = [], []
        for c in b:
            word = c.isalnum() or c == "_"
            if word and toks and toks[-1][1]:
                toks[-1][0] += c
            elif c == " ":
                toks.append(["", False])
            else:
                toks.append([c, word])
        toks = [t for t in toks if t[0]]
        for k, (t, word) in enumerate(toks):
            out.append((0x77, t.encode()))
            if word:
                kinds = ["V" if c in "aeiouy" else "D" if c.isdigit() else "_" if c == "_" else "C" for c in t]
                out.append((0x53, "".join(c for i, c in enumerate(kinds) if i == 0 or kinds[i - 1] != c).encode() + bytes([min(len(t), 12)])))
            if t.isdigit():
                out.append((0x23, b""))
            if k + 1 < len(toks):
                out.append((0x62, f"{t} {toks[k + 1][0]}".encode()))
        p = f" {b} "
        out += [(0x63, p[i : i + n].encode()) for n in (3, 4) for i in range(len(p) - n + 1)]
        got = {}
        for tag, x in out:
            h = 2166136261
            for c in bytes([tag]) + x:
                h = ((h ^ c) * 16777619) & 0xFFFFFFFF
            got[h % 1024] = got.get(h % 1024, 0) + (-1 if h >> 24 & 1 else 1)
        return {k: max(-7, min(7, v)) for k, v in got.items() if v}

    qs = ["What is 12 plus 7?", "", "é", " \n who\tis  Zoë_9 --", "a" * 300, "aaa aaa aaa aaa aaa aaa aaa aaa aaa aaa", "x" * 126 + " yy", "len(a_b[3:])", "strengthwordlonger 2024"]
    row, dim, v = X.Hashes().vectors(qs)
    assert [{int(d): int(n) for r, d, n in zip(row, dim, v) if r == k} for k in range(len(qs))] == [plain(q) for q in qs]


def test_question_features_of_every_prompt(spark, sf):
    from quern.plans import registry

    got = registry.QUERIES["m5_question_features"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/pairs.parquet").where("prompt is not null").count() == got.where("size(dims) = size(vs)").count()


def test_patterns_and_python_lines(spark):
    from pyspark.sql import functions as F
    from quern.functions import text as T
    from quern.plans.scoring import matches

    rows = [
        ("regex", "It has 12 Goats", ["^it has \\d+ goats$"], None, True), ("regex", "it has goats", ["^it has \\d+"], None, False), ("regex", "say hello there", ["hel+o"], ["THERE"], False),
        ("python-ast", "X = f(1)", ["^x\\ =\\ f\\(1\\)$"], [], True), ("python-ast", "x = f(1", ["^x = f"], None, False), ("python-ast", "for x in y:", ["for x"], None, True), ("python-ast", "except E as e:", ["except"], None, False),
        ("contains", "it is because of gold", ["Au", "ice"], None, False), ("contains", "Say: (ice) here", ["ice"], None, True), ("contains", "a+b here", ["`a+b`"], None, True), ("numeric", "from 3 to 12.50", [], None, True), ("numeric", "12.5 or 3", ["12.5"], None, False), ("numeric", "none", [], None, False),
        ("exact", "Yes", ["yes"], ["no"], True), ("exact", "'Yes'", ["yes!"], None, True), ("exact", "yes", ["yes"], ["^Y"], False), ("judge", "bad", [], ["bad"], None),
    ]
    df = spark.createDataFrame(rows, "scoring string, line string, accept array<string>, reject array<string>, want boolean").withColumn("answer", F.lit("12.5"))
    got = df.select("line", "want", matches(F.col("line"), F.col("accept"), F.col("answer"), F.col("scoring"), F.col("reject")).alias("got")).collect()
    assert [(r.line, r.got) for r in got] == [(r.line, r.want) for r in got]


def test_lines_echoes_and_tool_calls(spark):
    rows = [("  What is it?  \n\n  a   b\n", "what is it?", "a b"), ("\u2028x", "", "x"), (None, "p", ""), ("what is it", "what is it?", "what is it")]
    df = spark.createDataFrame(rows, "o string, p string, want string")
    assert [r[0] for r in df.select(T.first_line(F.col("o"), F.col("p"))).collect()] == [r[2] for r in rows]
    raw = ["calc(3 + 4)", " calc((1+2)*3)\n", "calc(34)", "7", "calc(3+x)", None]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    assert [r[0] for r in df.select(T.tool_form(F.col("r"))).collect()] == [True, True, False, False, False, False]


def test_dates_in_words(spark):
    df = spark.createDataFrame([("1920-01-03",), ("1950-06",), ("-0300",), ("-0044-03-15",)], "d string")
    assert [r[0] for r in df.select(T.date_said(F.col("d"))).collect()] == ["on 3 January 1920", "in June 1950", "in 300 BC", "on 15 March 44 BC"]
