"""G1-G18 and their guards: rows made of templates and pools, in the order of a hash; noise; what is kept of them."""

from __future__ import annotations

import keyword
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import calc
from quern.functions import requests as R
from quern.functions import text as T
from quern.functions.noise import typo_title
from quern.operators import retrieval
from quern.operators.numbering import numbered
from quern.plans import knowledge
from quern.plans import sqltext as S
from quern.session import cut, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Pools, all invented.
WORDS = "kettle ladder market pepper window garden button silver harbor bottle candle mirror anchor feather basket whistle".split()
NAMES = "rows items scores names totals prices groups labels".split()
FILES = "notes.txt log.md data.csv list.txt".split()
FOLDERS = "old backup work notes".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
MONTHS = "january february march april may june july august september october november december".split()
SMALL = [str(n) for n in range(2, 30)]
SPOKEN = [calc.spell(n) for n in range(2, 30)]
LEADS = ["hey", "ok so", "quick one:", "so"]


@dataclass
class Template:
    """A prompt and an answer with {slots}, a pool for each slot, and how many rows to draw of all combinations.

    An answer slot may name a function of a slot: {upper:w}, {reverse:w}, {length:w}, {next:w}, {previous:w}, {digits:w}.
    distinct: no two slots may have the same value (P16).
    """

    id: str
    prompt: str
    answer: str
    pools: dict[str, list[str]]
    n: int = 40
    distinct: bool = False
    functions: tuple[str, ...] = field(default=("upper", "reverse", "length", "next", "previous", "digits"), repr=False)

    def size(self) -> int:
        out = 1
        for p in self.pools.values():
            out *= len(p)
        return out

    def used(self) -> list[tuple[str, str]]:
        return [(f, s) for f in self.functions for s in self.pools if f"{{{f}:{s}}}" in self.answer]

    def frame(self, spark: SparkSession) -> DataFrame:
        """Combinations are numbered and decoded; the product is never made, only ranked by hash."""
        k, div, value = F.col("_k"), 1, {}
        for s, pool in self.pools.items():
            value[s] = F.get(F.array(*map(F.lit, pool)), (F.floor(k / div) % len(pool)).cast("int"))
            div *= len(pool)
        x = spark.range(self.size()).withColumnRenamed("id", "_k").select("_k", *[c.alias(s) for s, c in value.items()])
        if self.distinct:
            x = x.where(F.size(F.array_distinct(F.array(*self.pools))) == len(self.pools))
        x = x.orderBy(T.hash_order(self.id, "_k"), "_k").limit(self.n)

        def fill(text: str):
            out = F.lit(text)
            for f, s in self.used():
                out = F.replace(out, F.lit(f"{{{f}:{s}}}"), self._apply(f, s))
            for s in self.pools:
                out = F.replace(out, F.lit(f"{{{s}}}"), F.col(s))
            return out

        return x.select(F.lit(self.id).alias("template_id"), fill(self.prompt).alias("prompt"), fill(self.answer).alias("answer"))

    def _apply(self, f: str, s: str):
        pool, c = self.pools[s], F.col(s)
        if f in ("next", "previous"):
            step = 1 if f == "next" else -1
            return F.create_map(*[F.lit(x) for i, v in enumerate(pool) for x in (v, pool[(i + step) % len(pool)])])[c]
        if f == "digits":
            return F.create_map(*[F.lit(x) for v in pool for x in (v, str(calc.unspell(v)))])[c]
        return {"upper": F.upper(c), "reverse": F.reverse(c), "length": F.length(c).cast("string")}[f]

    def sql(self) -> str:
        q = S.q
        pool = lambda p: "[" + ", ".join(map(q, p)) + "]"
        cols, div = [], 1
        for s, p in self.pools.items():
            cols.append(f"{pool(p)}[_k // {div} % {len(p)} + 1] as {s}")
            div *= len(p)
        guard = f"where len(list_distinct([{', '.join(self.pools)}])) = {len(self.pools)}" if self.distinct else ""

        def fill(text: str) -> str:
            out = q(text)
            for f, s in self.used():
                p = self.pools[s]
                at = f"list_position({pool(p)}, {s})"
                expr = {"upper": f"upper({s})", "reverse": f"reverse({s})", "length": f"length({s})::varchar", "next": f"{pool(p)}[{at} % {len(p)} + 1]", "previous": f"{pool(p)}[({at} + {len(p) - 2}) % {len(p)} + 1]", "digits": f"{pool([str(calc.unspell(v) or 0) for v in p])}[{at}]"}[f]
                out = f"replace({out}, {q(f'{{{f}:{s}}}')}, {expr})"
            for s in self.pools:
                out = f"replace({out}, {q(f'{{{s}}}')}, {s})"
            return out

        return (
            f"select {q(self.id)} as template_id, {fill(self.prompt)} as prompt, {fill(self.answer)} as answer from (select * from (select _k, {', '.join(cols)} from (select range as _k from range({self.size()}))) {guard} "
            f"order by md5(concat_ws('|', {q(self.id)}, cast(_k as varchar))), _k limit {self.n})"
        )


TEMPLATES = {
    "g3_text_prompts": [
        Template("upper", "uppercase the word {w}", "{upper:w}", {"w": WORDS}), Template("reverse", "reverse {a} {b}", "{reverse:b} {reverse:a}", {"a": WORDS, "b": WORDS}, distinct=True), Template("length", "how many letters are in {w}", "{length:w}", {"w": WORDS}),
    ],
    "g5_python_prompts": [
        Template("swap", "swap {a} and {b}", "{a}, {b} = {b}, {a}", {"a": NAMES, "b": NAMES}, distinct=True), Template("last", "last {k} of {a}", "{a}[-{k}:]", {"a": NAMES, "k": SMALL}), Template("zip", "pair {a} with {b}", "list(zip({a}, {b}))", {"a": NAMES, "b": NAMES}, distinct=True),
    ],
    "g6_bugfix_prompts": [
        Template("colon", "fix: for {v} in {a} print({v})", "for {v} in {a}: print({v})", {"v": ["x", "y", "k"], "a": NAMES}), Template("equals", "fix: if {a} = {k}: stop()", "if {a} == {k}: stop()", {"a": NAMES, "k": SMALL}), Template("bracket", "fix: print(len({a})", "print(len({a}))", {"a": NAMES}),
    ],
    "g7_chat_prompts": [
        Template("day", "what day comes after {d}", "{next:d}", {"d": DAYS}), Template("day-before", "what day comes before {d}", "{previous:d}", {"d": DAYS}), Template("month", "which month comes after {m}", "{next:m}", {"m": MONTHS}), Template("month-before", "which month comes before {m}", "{previous:m}", {"m": MONTHS}),
    ],
    "g9_spelled_arithmetic": [
        Template("plus", "what is {a} plus {b}", "calc({digits:a}+{digits:b})", {"a": SPOKEN, "b": SPOKEN}, 120), Template("times", "{a} times {b}", "calc({digits:a}*{digits:b})", {"a": SPOKEN, "b": SPOKEN}, 120), Template("from", "subtract {a} from {b}", "calc({digits:b}-{digits:a})", {"a": SPOKEN, "b": SPOKEN}, 120),
    ],
    "g10_identity_and_jokes": [
        Template("who", "{l} who are you", "i'm a tiny assistant that answers from its notes.", {"l": LEADS}), Template("joke", "{l} tell me a joke about a {w}", "why did the {w} cross the road? to get to the other side.", {"l": LEADS, "w": WORDS}),
    ],
    "g12_shell_pairs": [
        Template("copy", "copy {f} to {d}", "cp {f} {d}/", {"f": FILES, "d": FOLDERS}), Template("show", "show the last {k} lines of {f}", "tail -n {k} {f}", {"k": SMALL, "f": FILES}), Template("find", "find {w} in {f}", "grep {w} {f}", {"w": WORDS, "f": FILES}),
    ],
}
_ALL = lambda name: " union all ".join(f"select * from ({t.sql()}) t{i}" for i, t in enumerate(TEMPLATES[name]))


def generated(spark: SparkSession, name: str) -> DataFrame:
    """(template_id, prompt, answer) of the templates of a name."""
    out = None
    for t in TEMPLATES[name]:
        x = t.frame(spark)
        out = x if out is None else out.unionByName(x)
    return out


def _register(name: str) -> None:
    @query(name, _ALL(name))
    def run(spark, sf):
        return generated(spark, name)


for _name in TEMPLATES:
    if _name not in ("g10_identity_and_jokes", "g12_shell_pairs"):
        _register(_name)

_HALF = "('0x' || substr(md5(concat_ws('|', 'half', prompt)), 1, 8))::bigint % 100 < 50"


@query("g10_identity_and_jokes", f"select * from ({_ALL('g10_identity_and_jokes')}) where template_id <> 'joke' or {_HALF}")
def g10_identity_and_jokes(spark, sf):
    """Every identity row, half of the jokes by hash."""
    half = F.conv(F.substring(T.hash_order("half", "prompt"), 1, 8), 16, 10).cast("long") % 100 < 50
    return generated(spark, "g10_identity_and_jokes").where((F.col("template_id") != "joke") | half)


_GUARD = r"^(?:cp|tail|grep)( -n \d+| [a-z]+)? [a-z.]+( [a-z]+/)?$"


@query("g12_shell_pairs", f"select * from ({_ALL('g12_shell_pairs')}) where regexp_matches(answer, {S.q(_GUARD)})")
def g12_shell_pairs(spark, sf):
    """Only commands of the known grammar."""
    return generated(spark, "g12_shell_pairs").where(F.col("answer").rlike(_GUARD))


@query("g8_calculator_rows", "select 'what is ' || a || ' ' || op || ' ' || b as prompt, 'calc(' || a || op || b || ')' as answer from (select k // 320 as a, k // 4 % 80 as b, ['+', '-', '*', '/'][k % 4 + 1] as op, k from (select range as k from range(6400))) where not (op = '/' and b = 0) qualify row_number() over (order by md5(concat_ws('|', 'g8', cast(k as varchar))), k) <= 300")
def g8_calculator_rows(spark, sf):
    """Drawn by hash from those that evaluate without an error (M1)."""
    k = F.col("k")
    x = spark.range(6400).withColumnRenamed("id", "k").select("k", F.floor(k / 320).cast("string").alias("a"), (F.floor(k / 4) % 80).cast("string").alias("b"), F.get(F.array(*map(F.lit, "+-*/")), (k % 4).cast("int")).alias("op"))
    x = x.withColumn("answer", F.concat(F.lit("calc("), "a", "op", "b", F.lit(")"))).where(~F.endswith(calc.calc_udf()("answer"), F.lit("error")))
    return x.orderBy(T.hash_order("g8", "k"), "k").limit(300).select(F.concat(F.lit("what is "), "a", F.lit(" "), "op", F.lit(" "), "b").alias("prompt"), "answer")


@query("pred15_template_slots", "select * from (values ('swap {a} and {b}', true), ('swap {a} and {a}', false), ('swap {a}', false), ('swap {a} and {b} {c}', false), ('swap {a and {b}', false), ('{{a}} {b}', false)) v(template, ok)")
def pred15_template_slots(spark, sf):
    """Balanced braces, each required slot (a, b) once, none unknown."""
    t = spark.createDataFrame([("swap {a} and {b}",), ("swap {a} and {a}",), ("swap {a}",), ("swap {a} and {b} {c}",), ("swap {a and {b}",), ("{{a}} {b}",)], "template string")
    return t.select("template", template_ok(F.col("template"), ["a", "b"]).alias("ok"))


def template_ok(template, required: list[str], optional: list[str] | tuple = ()):
    """P15."""
    slots = F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), 1)
    rest = F.regexp_replace(template, r"\{\w+\}", "")
    once = [F.size(slots) - F.size(F.array_remove(slots, r)) == 1 for r in required]
    known = F.size(F.array_except(slots, F.array(*map(F.lit, [*required, *optional])))) == 0
    return T.all_of([~rest.rlike(r"[{}]"), known, *once])


@query("pred16_distinct_names", "select a.n_name as a, b.n_name as b from nation a, nation b where a.n_regionkey = b.n_regionkey and a.n_name <> b.n_name")
def pred16_distinct_names(spark, sf):
    """Combinations of slots without a name twice."""
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    return a.join(F.broadcast(b), "n_regionkey").where(F.size(F.array_distinct(F.array("a", "b"))) == 2).select("a", "b")


_BRAND = r"(?i)\b(?:chatgpt|openai|gpt-?\d|gemini|language model)\b"


@query("pred12_identity_answers", f"select pair_id, case when regexp_matches(answer, {S.q(_BRAND)}) then 'i''m a tiny assistant that answers from its notes.' else answer end as answer from pairs where answer is not null")
def pred12_identity_answers(spark, sf):
    """An answer that names a maker becomes the fixed one."""
    return table(spark, sf, "pairs").where("answer is not null").select("pair_id", F.when(F.col("answer").rlike(_BRAND), "i'm a tiny assistant that answers from its notes.").otherwise(F.col("answer")).alias("answer"))


@query("w17_complementary_tuple", """with c as (select template_id, category, source, tier, min(pair_id) as id from pairs where template_id is not null and source is not null and tier is not null group by all),
  f as (select template_id, arg_min(struct_pack(category, source, tier), id) as first from c group by 1)
  select template_id, id, (category <> first.category)::int + (source <> first.source)::int + (tier <> first.tier)::int as differing from c join f using (template_id) qualify row_number() over (partition by template_id order by (category <> first.category)::int + (source <> first.source)::int + (tier <> first.tier)::int desc, id) = 1""")
def w17_complementary_tuple(spark, sf):
    """Of each template's combinations the one that differs from the first in most slots, the earliest of those."""
    slots = ["category", "source", "tier"]
    c = table(spark, sf, "pairs").where("template_id is not null and source is not null and tier is not null").groupBy("template_id", *slots).agg(F.min("pair_id").alias("id"))
    first = c.groupBy("template_id").agg(F.min_by(F.struct(*slots), "id").alias("first"))
    differing = sum(((F.col(s) != F.col(f"first.{s}")).cast("int") for s in slots), F.lit(0))
    x = c.join(first, "template_id").withColumn("differing", differing)
    return x.groupBy("template_id").agg(F.max_by(F.struct("id", "differing"), F.struct("differing", -F.col("id"))).alias("x")).select("template_id", "x.id", "x.differing")


@query("l8_smallest_offsets", "select template_id, pair_id from pairs where template_id is not null qualify row_number() over (partition by template_id order by pair_id) <= 16")
def l8_smallest_offsets(spark, sf):
    from pyspark.sql import Window

    p = table(spark, sf, "pairs").where("template_id is not null").select("template_id", "pair_id")
    return p.withColumn("rn", F.row_number().over(Window.partitionBy("template_id").orderBy("pair_id"))).where("rn <= 16").select("template_id", "pair_id")  # each task keeps its first 16


_IDENT = ["count", "total", "index", "name", "price", "label", "score", "group", "value", "limit", "class", "import", "lambda"]
_DEV = {"count_total", "name_price", "index"}


@query("f42_identifier_pools", f"""with w as (select unnest([{', '.join(map(S.q, _IDENT))}]) as w), c as (select w as name from w union select a.w || '_' || b.w from w a, w b union select a.w || n from w a, (select unnest(['2', '3', '4']) as n))
  select name from c where name not in ({', '.join(map(S.q, keyword.kwlist))}) and name not in ({', '.join(map(S.q, sorted(_DEV)))}) order by md5(concat_ws('|', 'f42', name)) limit 120""")
def f42_identifier_pools(spark, sf):
    """Names of one word, two words or a word and a digit; no keywords, none of the evaluation side's."""
    w = spark.createDataFrame([(x,) for x in _IDENT], "w string")
    two = w.select(F.col("w").alias("a")).crossJoin(F.broadcast(w)).select(F.concat("a", F.lit("_"), "w").alias("name"))  # 13 fixed words squared
    digit = w.select(F.explode(F.array(*[F.concat("w", F.lit(d)) for d in "234"])).alias("name"))
    names = w.select(F.col("w").alias("name")).unionByName(two).unionByName(digit).distinct()
    return names.where(~F.col("name").isin(*keyword.kwlist, *_DEV)).orderBy(T.hash_order("f42", "name")).limit(120)


@query("f27_typo_titles")
def f27_typo_titles(spark, sf):
    """titles with one random edit in a longer word, fixed by a hash."""
    f = F.pandas_udf(lambda t, i: pd.Series([typo_title(x, f"f27|{k}") for x, k in zip(t, i)], dtype=object), "string")
    return table(spark, sf, "wiki_pages").where("t is not null").select("page_id", "t", f("t", "page_id").alias("typo"))


@query("j20_typos_with_the_same_answer")
def j20_typos_with_the_same_answer(spark, sf):
    """Questions with a mistyped title that still lead to the same entity."""
    pages = table(spark, sf, "wiki_pages")
    x = knowledge.entities(pages)
    q = QUERIES["f27_typo_titles"](spark, sf).where("typo <> t").select(F.col("page_id").alias("qid"), "t", F.concat(F.lit("what is "), "typo").alias("question"))
    q = cut(q, "typos")
    got = retrieval.retrieved(q, cut(knowledge.key_candidates(pages, x), "keys"), knowledge.entity_fields(x).drop("prov"))
    return got.where("title is not null").join(q, "qid").where("title = t").select("qid", "question", "title", "status")


@query("g11_unknown_names")
def g11_unknown_names(spark, sf):
    """Questions about made-up names, kept only if no key of the knowledge base has the name."""
    syllable = F.array(*map(F.lit, "ba ke lo mi nu ra so ti vu ze".split()))
    part = lambda n: F.get(syllable, (F.pmod(F.xxhash64(F.lit(n), "id"), F.lit(10))).cast("int"))
    names = spark.range(400).select(F.concat(*[part(n) for n in range(4)]).alias("key")).distinct()
    keys = knowledge.key_candidates(table(spark, sf, "wiki_pages")).select("key")
    return names.join(keys, "key", "left_anti").select(F.concat(F.lit("who is "), F.initcap("key")).alias("prompt"), F.lit("that one is not in my notes.").alias("answer"))


@query("g13_title_questions")
def g13_title_questions(spark, sf):
    """Questions about titles whose answer begins with the title."""
    pages = table(spark, sf, "wiki_pages")
    x = knowledge.entities(pages)
    q = pages.where("t is not null and r is null").select(F.col("page_id").alias("qid"), "t", F.concat(F.lit("tell me about "), "t").alias("question"))
    got = cut(retrieval.retrieved(q, cut(knowledge.key_candidates(pages, x), "keys"), knowledge.entity_fields(x).drop("prov")), "answers")  # a filter on the status would repeat its whole expression
    return got.where("status = 'answer_present'").join(q, "qid").where(F.startswith(F.lower("context"), F.lower("t"))).select("qid", "question", "context")


def _bucket(seed: str, *cols):
    return F.conv(F.substring(T.hash_order(seed, *cols), 1, 8), 16, 10).cast("long") % 100


_G14 = " union all ".join(f"select * from ({_ALL(n)})" for n in ("g5_python_prompts", "g6_bugfix_prompts"))


@query("g14_curriculum_split", f"""with r as (select *, ('0x' || substr(md5(concat_ws('|', 'g14', template_id, prompt)), 1, 8))::bigint % 100 as b from ({_G14})),
  s as (select template_id, case when b < 16 then 'bare' when b < 46 and starts_with(prompt, 'fix: ') then 'raw' when b < 70 then 'noisy' else 'plain' end as kind, prompt, answer from r)
  select template_id, kind, case kind when 'bare' then regexp_replace(prompt, '^fix: ', '') when 'raw' then substr(prompt, 6) when 'noisy' then 'hey, ' || lower(prompt) || ' pls' else prompt || ' in python' end as prompt, answer,
    row_number() over (partition by template_id order by md5(concat_ws('|', 'n', prompt)), prompt) as seq from s""")
def g14_curriculum_split(spark, sf):
    """Rows of the Python families: bare, raw bugs, noisy or plain by hash, numbered within their template."""
    x = generated(spark, "g5_python_prompts").unionByName(generated(spark, "g6_bugfix_prompts")).withColumn("b", _bucket("g14", "template_id", "prompt"))
    kind = F.when(F.col("b") < 16, "bare").when((F.col("b") < 46) & F.startswith("prompt", F.lit("fix: ")), "raw").when(F.col("b") < 70, "noisy").otherwise("plain")
    x = numbered(x.withColumn("kind", kind).withColumn("h", T.hash_order("n", "prompt")), ["template_id"], ["h", "prompt"], "seq")
    said = F.when(F.col("kind").isin("bare", "raw"), F.regexp_replace("prompt", "^fix: ", "")).when(F.col("kind") == "noisy", F.concat(F.lit("hey, "), F.lower("prompt"), F.lit(" pls"))).otherwise(F.concat("prompt", F.lit(" in python")))
    return x.select("template_id", "kind", said.alias("prompt"), "answer", "seq")


@query("g16_tasks_by_template", f"""with t as (select * from (values ('a', 'how do i {{x}}'), ('b', 'please {{x}}'), ('c', '{{x}} in one line')) v(wrap, pattern)) select template_id, wrap, replace(pattern, '{{x}}', prompt) as prompt, answer from ({_ALL('g5_python_prompts')}), t
  qualify row_number() over (partition by template_id, wrap order by md5(concat_ws('|', 'g16', prompt)), prompt) <= 10""")
def g16_tasks_by_template(spark, sf):
    """Tasks by wrappings, ten of each pair."""
    from pyspark.sql import Window

    t = F.broadcast(spark.createDataFrame([("a", "how do i {x}"), ("b", "please {x}"), ("c", "{x} in one line")], "wrap string, pattern string"))
    x = generated(spark, "g5_python_prompts").crossJoin(t).withColumn("h", T.hash_order("g16", "prompt"))  # three wrappings
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("template_id", "wrap").orderBy("h", "prompt"))).where("rn <= 10")
    return x.select("template_id", "wrap", F.replace("pattern", F.lit("{x}"), F.col("prompt")).alias("prompt"), "answer")


@query("g17_golden_mix")
def g17_golden_mix(spark, sf):
    """Test questions of seven kinds by hash: fact, typo, fake, mixed, nocue, chat, soup."""
    b = F.pmod(F.xxhash64(F.lit("g17"), "page_id"), F.lit(7))
    f = F.pandas_udf(lambda t, i: pd.Series([typo_title(x, f"g17|{k}") for x, k in zip(t, i)], dtype=object), "string")
    x = table(spark, sf, "wiki_pages").where("t is not null").select("page_id", "t", f("t", "page_id").alias("typo"), b.alias("b"))
    ask = lambda c: F.concat(F.lit("what is "), c)
    soup = F.array_join(F.array_sort(F.split(F.concat(F.col("t"), F.lit(" of what is the")), " ")), " ")
    kinds = [("fact", ask(F.col("t"))), ("typo", ask(F.col("typo"))), ("fake", ask(F.reverse("t"))), ("mixed", F.concat(ask(F.col("t")), F.lit(" and 3 plus 4"))), ("nocue", F.col("t")), ("chat", F.lit("hello there")), ("soup", soup)]
    kind = F.coalesce(*[F.when(F.col("b") == i, k) for i, (k, _) in enumerate(kinds)])
    return x.select("page_id", kind.alias("kind"), F.coalesce(*[F.when(F.col("b") == i, q) for i, (_, q) in enumerate(kinds)]).alias("question"))


# Look-alikes of requests that ask for nothing to be done.
NEGATIVES = ["what does {op} mean", "how do i {op} a list in python", "why would i {op} it", "{op} the file", "who invented {op}", "explain {op}"]
_REQUESTS = {"uppercase": "upper", "lowercase": "lower", "reverse": "reverse", "spell": "spell", "capitalize": "capitalize"}


@query("g18_text_requests")
def g18_text_requests(spark, sf):
    """Requests for text operations and look-alikes, with what the parser makes of them."""
    rows = [(f"{p}{op} {w}{tail}", name) for op, name in _REQUESTS.items() for w in WORDS for p, tail in (("", ""), ("please ", "?"), ("can you ", " please"))] + [(n.format(op=op), None) for op in _REQUESTS for n in NEGATIVES]
    df = spark.createDataFrame(rows, "request string, wanted string")
    return df.select("request", "wanted", R.struct_udf(R.text_request, ["op", "output"])("request").alias("x")).select("request", "wanted", F.col("x.op").alias("found"), "x.output")


@query("f31_text_requests")
def f31_text_requests(spark, sf):
    """What each prompt asks for."""
    p = table(spark, sf, "pairs").where("prompt is not null").select("pair_id", "prompt")
    x = p.select("pair_id", R.struct_udf(R.text_request, ["op", "output"])("prompt").alias("r"), R.struct_udf(R.style_request, ["kind", "style", "inner"])("prompt").alias("s"), R.udf(R.follow_up, "string")("prompt").alias("follow_up"), R.udf(R.act, "string")("prompt").alias("act"))
    return x.select("pair_id", "r.op", "r.output", F.col("s.kind").alias("style_kind"), "s.style", "follow_up", "act").where("op is not null or style is not null or follow_up is not null or act is not null")


@query("r9_dispatch")
def r9_dispatch(spark, sf):
    """The first stage that has an answer: text operation, arithmetic, knowledge base, else asking back."""
    pages = table(spark, sf, "wiki_pages")
    x = knowledge.entities(pages)
    p = table(spark, sf, "pairs").where("prompt is not null").select(F.col("pair_id").alias("qid"), F.col("prompt").alias("question"))
    value = F.split_part(calc.calc_udf()(F.concat(F.lit("calc("), calc.spoken_udf()("question"), F.lit(")"))), F.lit(" = "), F.lit(2))
    text = R.struct_udf(R.text_request, ["op", "output"])("question")["output"]
    y = cut(p.select("qid", "question", text.alias("text"), F.nullif(value, F.lit("")).alias("calc")), "stages")  # Python reads each prompt once
    done = y.where("text is not null or calc is not null").select("qid", F.when(F.col("text").isNotNull(), "text").otherwise("calc").alias("stage"), F.coalesce("text", "calc").alias("answer"))
    rest = y.where("text is null and calc is null").select("qid", "question")
    kb = retrieval.retrieved(rest, cut(knowledge.key_candidates(pages, x), "keys"), cut(knowledge.entity_fields(x).drop("prov"), "fields"))
    asked = kb.select("qid", F.when(F.col("status") == "answer_present", "facts").otherwise("clarify").alias("stage"), F.col("context").alias("answer"))
    return done.unionByName(asked).withColumnRenamed("qid", "pair_id")


@query("j19_unrelated_contexts", """with p as (select t, w, row_number() over (order by page_id) - 1 as pos, count(*) over () as n from wiki_pages where r is null and w is not null and t is not null)
  select pair_id, t from pairs join p on pos = ('0x' || substr(md5(concat_ws('|', 'j19', cast(pair_id as varchar))), 1, 15))::bigint % n where category <> 'factual'""")
def j19_unrelated_contexts(spark, sf):
    """Each pair that asks for no fact gets a page by hash; pages are numbered once and looked up."""
    pages = table(spark, sf, "wiki_pages").where("r is null and w is not null and t is not null").select("page_id", "t")
    p = numbered(pages, [], ["page_id"], "at", "n")
    n = F.broadcast(p.agg(F.max("n").alias("n")))  # one row
    rows = table(spark, sf, "pairs").where("category <> 'factual'").select("pair_id").crossJoin(n)
    place = F.conv(F.substring(T.hash_order("j19", "pair_id"), 1, 15), 16, 10).cast("long") % F.col("n") + 1
    return rows.select("pair_id", place.alias("at")).join(p.select("at", "t"), "at").select("pair_id", "t")


@query("f26_noise_kinds")
def f26_noise_kinds(spark, sf):
    """six kinds of noise, each by its own hash: dropped small words, a typo, small letters, no punctuation, contractions, a casual lead or tail."""
    from quern.functions.noise import noisy_udf

    return table(spark, sf, "pairs").where("prompt is not null").select("pair_id", noisy_udf("prompt", "pair_id").alias("x")).select("pair_id", "x.*")
