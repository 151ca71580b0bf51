"""Further operators: packaging of knowledge-base tables, audits, features, generators."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quern.functions import features
from quern.functions import text as T
from quern.operators.contamination import small
from quern.operators.retrieval import with_sentence
from quern.plans import knowledge, scoring
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


_H = lambda seed, *ids: f"md5(concat_ws('|', '{seed}', " + ", ".join(f"cast({i} as varchar)" for i in ids) + "))"


@query("a9_bucket_occupancy", """with k as (select list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split(id, ''), lambda c: ascii(c)::ubigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 128 as bucket from eval_suite),
  b as (select bucket, count(*) as n from k group by 1) select count(*) as used, max(n) as largest, round(avg(n), 6) as mean, round(count_if(n <= 2) / count(*), 6) as small_share from b""")
def a9_bucket_occupancy(spark, sf):
    b = table(spark, sf, "eval_suite").select((T.fnv1a(F.col("id")) % 128).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return b.agg(F.count("*").alias("used"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.count_if(F.col("n") <= 2) / F.count("*"), 6).alias("small_share"))


@query("w5_collision_winner", f"select {S.key('t')} as key, t from wiki_pages where w is not null and t is not null qualify row_number() over (partition by {S.key('t')} order by r is not null, length(w) desc, page_id) = 1")
def w5_collision_winner(spark, sf):
    x = table(spark, sf, "wiki_pages").where("w is not null and t is not null").withColumn("key", T.normalize_key(F.col("t")))
    w = Window.partitionBy("key").orderBy(F.col("r").isNotNull(), F.length("w").desc(), "page_id")
    return x.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("key", "t")


@query("j14_held_out_titles", f"select page_id, t from wiki_pages where t is not null and {S.key('t')} not in (select {S.key('prompt')} from auto_dev_40) and page_id % 20 <> 7")
def j14_held_out_titles(spark, sf):
    """Titles that are not held out: those of every twentieth page, and those that are an evaluation prompt."""
    pages = table(spark, sf, "wiki_pages").where("t is not null")
    asked = table(spark, sf, "auto_dev_40").select(T.normalize_key(F.col("prompt")).alias("k"))
    held = pages.where("page_id % 20 = 7").select("page_id")
    x = pages.select("page_id", "t", T.normalize_key(F.col("t")).alias("k"))
    return x.join(small(asked), "k", "left_anti").join(small(held), "page_id", "left_anti").select("page_id", "t")


@query("a11_failures_by_reason", scoring._SCORED + "select category, case when missing then 'missing' when over then 'too_long' when correct is null then 'judge' when correct then 'right' else 'wrong' end as reason, count(*) as n from scored group by 1, 2")
def a11_failures_by_reason(spark, sf):
    """Exclusive verdicts in a fixed order."""
    reason = F.when(F.col("missing"), "missing").when(F.col("over"), "too_long").when(F.col("correct").isNull(), "judge").when(F.col("correct"), "right").otherwise("wrong")
    return scoring.scored(spark, sf).groupBy("category", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("a12_flag_sums", "select sum(cast(prompt is null as int)) as no_prompt, sum(cast(answer is null as int)) as no_answer, sum(cast(tier is null as int)) as no_tier, sum(cast(context is not null as int)) as with_context from pairs")
def a12_flag_sums(spark, sf):
    flag = lambda c, n: F.sum(c.cast("int")).alias(n)
    p = table(spark, sf, "pairs")
    return p.agg(flag(F.col("prompt").isNull(), "no_prompt"), flag(F.col("answer").isNull(), "no_answer"), flag(F.col("tier").isNull(), "no_tier"), flag(F.col("context").isNotNull(), "with_context"))


# Endings that may be left out to find a word.
_ENDINGS = ["s", "es", "ed", "d", "ing", "ly", "er"]
_STEMS = lambda w: "list_concat([" + w + "], list_transform(list_filter(" + str(_ENDINGS) + f", lambda e: length({w}) > length(e) + 2 and ends_with({w}, e)), lambda e: {w}[:length({w}) - length(e)]))"


@query("a14_garbled_words", f"""with known as (select distinct w from (select unnest({S.words('text')}) as w from documents where text is not null)),
  ws as (select pair_id, unnest(list_distinct({S.words('answer')})) as w, {S.words("coalesce(prompt, '') || ' ' || coalesce(context, '')")} as own from pairs where answer is not null),
  c as (select pair_id, w, unnest({_STEMS('w')}) as stem, own from ws where not regexp_matches(w, '[0-9]') and length(w) > 3),
  k as (select pair_id, w, bool_or(list_contains(own, stem) or stem in (select w from known)) as found from c group by 1, 2)
  select pair_id, count(*) as garbled from k where not found group by 1""")
def a14_garbled_words(spark, sf):
    """longer words of an answer that, with or without an ending, neither its prompt, its context nor the documents have."""
    return _garbled(spark, sf).groupBy("pair_id").agg(F.count("*").alias("garbled"))


def _garbled(spark, sf):
    known = small(table(spark, sf, "documents").where("text is not null").select(F.explode(T.word_list(F.col("text"))).alias("stem")).distinct())
    p = table(spark, sf, "pairs").where("answer is not null")
    own = T.word_list(F.concat_ws(" ", "prompt", "context"))
    w = p.select("pair_id", F.explode(T.word_set(F.col("answer"))).alias("w"), own.alias("own")).where("length(w) > 3").where(~F.col("w").rlike("[0-9]"))
    cuts = F.array_compact(F.array(F.col("w"), *[F.when((F.length("w") > len(e) + 2) & F.endswith("w", F.lit(e)), F.substring("w", F.lit(1), F.length("w") - len(e))) for e in _ENDINGS]))
    w = w.withColumn("stems", cuts).where(~F.arrays_overlap("stems", "own")).select("pair_id", "w", F.explode("stems").alias("stem"))
    found = w.join(known.withColumn("k", F.lit(True)), "stem", "left").groupBy("pair_id", "w").agg(F.max("k").alias("k"))
    return found.where("k is null").select("pair_id", "w")


@query("a14_garbled_by_cut")
def a14_garbled_by_cut(spark, sf):
    """Answers and garbled ones by how their context was cut (F20), with a subtotal of the clean cuts and a total."""
    g = _garbled(spark, sf).select("pair_id").distinct().withColumn("garbled", F.lit(1))
    x = old_cut(table(spark, sf, "pairs").where("answer is not null and context is not null"), "context").select("pair_id", "kind").join(g, "pair_id", "left")
    x = x.withColumn("clean", F.col("kind") != "midphrase")
    return x.rollup("clean", "kind").agg(F.count("*").alias("answers"), F.count("garbled").alias("garbled"))


@query("f18_grounded", f"""select pair_id, len(list_filter({S.words('answer')}, lambda w: length(w) > 3 and not list_contains(list_transform({S.words("context || ' ' || prompt")}, lambda v: regexp_replace(v, 's$', '')), regexp_replace(w, 's$', '')))) = 0 as grounded
  from pairs where answer is not null and context is not null and prompt is not null""")
def f18_grounded(spark, sf):
    """All longer words of the answer, but for a plural s, stand in context or prompt."""
    stem = lambda ws: F.transform(ws, lambda w: F.regexp_replace(w, "s$", ""))
    p = table(spark, sf, "pairs").where("answer is not null and context is not null and prompt is not null")
    own = stem(T.word_list(F.concat_ws(" ", "context", "prompt")))
    return p.select("pair_id", (F.size(F.array_except(stem(F.filter(T.word_list(F.col("answer")), lambda w: F.length(w) > 3)), own)) == 0).alias("grounded"))


def longest_run(a: str, b: str) -> int:
    """words of the longest run that both have."""
    x, y = (re.findall("[a-z0-9]+", t.lower()) for t in (a, b))
    at: dict[str, list[int]] = {}
    for j, w in enumerate(y):
        at.setdefault(w, []).append(j)
    best, ending = 0, {}
    for w in x:
        ending = {j: ending.get(j - 1, 0) + 1 for j in at.get(w, ())}
        best = max(best, *ending.values()) if ending else best
    return best


_RUNS = lambda w, k: f"list_transform(range(1, len({w}) - {k} + 2), lambda i: array_to_string({w}[i:i + {k} - 1], ' '))"


@query("f17_longest_run", f"select pair_id, coalesce(list_max(list_filter(range(1, len(a) + 1), lambda k: list_has_any({_RUNS('a', 'k')}, {_RUNS('b', 'k')}))), 0)::int as words from (select pair_id, {S.words('answer')} as a, {S.words('context')} as b from pairs where answer is not null and context is not null)")
def f17_longest_run(spark, sf):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([longest_run(x, y) for x, y in zip(a, b)], dtype="int32")

    f = F.pandas_udf(run, IntegerType())
    return table(spark, sf, "pairs").where("answer is not null and context is not null").select("pair_id", f("answer", "context").alias("words"))


# Fixed value: the answer that is always allowed.
IDK = "that one is not in my notes."
# Words that need no support.
_FREE = "a an the of in on at by for from to with and or is are was were be it its this that as".split()


@query("pred11_valid_answers", f"""with x as (select pair_id, answer, {S.words('answer')} as a, {S.words("context || ' ' || prompt")} as own, {S.words('context')} as c from pairs where answer is not null and context is not null and prompt is not null)
  select pair_id, answer = '{IDK}' or (len(a) between 1 and 12 and not contains(answer, chr(10)) and len(list_filter(a, lambda w: not list_contains({_FREE}, w) and not list_contains(list_transform(own, lambda v: case when length(v) > 3 and regexp_matches(v, '[^s]s$') then v[:-2] else v end), case when length(w) > 3 and regexp_matches(w, '[^s]s$') then w[:-2] else w end))) = 0
    and not list_has_any({_RUNS('a', '7')}, {_RUNS('c', '7')})) as valid from x""")
def pred11_valid_answers(spark, sf):
    """One line of one to twelve words, all but small ones supported, no run of more than six of the context; or the standing reply."""
    stem = lambda ws: F.transform(ws, lambda w: F.when((F.length(w) > 3) & w.rlike("[^s]s$"), F.regexp_replace(w, "s$", "")).otherwise(w))
    p = table(spark, sf, "pairs").where("answer is not null and context is not null and prompt is not null")
    a, own, c = T.word_list(F.col("answer")), T.word_list(F.concat_ws(" ", "context", "prompt")), T.word_list(F.col("context"))
    free = F.array(*map(F.lit, _FREE))
    supported = F.size(F.array_except(stem(F.filter(a, lambda w: ~F.array_contains(free, w))), stem(own))) == 0
    short = F.size(a).between(1, 12) & ~F.contains("answer", F.lit("\n"))
    return p.select("pair_id", ((F.col("answer") == IDK) | (short & supported & ~F.arrays_overlap(T.ngrams(a, 7), T.ngrams(c, 7)))).alias("valid"))


_FIRST = "case when regexp_matches(context, '(?s)^.*?[.!?]\\s+[A-Z0-9\"''(]') then regexp_extract(context, '(?s)^(.*?[.!?])\\s+[A-Z0-9\"''(]', 1) else context end"
_FULL = "case when contains(s[:80], ' ') then regexp_replace(s[:80], '(?s) [^ ]*$', '') else s[:80] end"
_AT = "length(f) - length(regexp_replace(f, '(?s)^.*[,;]', ''))"


@query("f20_old_cut", f"with x as (select pair_id, {_FIRST} as s from pairs where context is not null), y as (select pair_id, s, {_FULL} as f from x) select pair_id, case when length(s) <= 80 then s when regexp_matches(f, '[,;]') and {_AT} - 1 >= 40 then f[:{_AT} - 1] else f end as cut, case when length(s) <= 80 then 'sentence' when regexp_matches(f, '[,;]') and {_AT} - 1 >= 40 then 'clause' else 'midphrase' end as kind from y")
def f20_old_cut(spark, sf):
    """the first sentence, or 80 characters of it up to a clause from 40 on, or to a word."""
    return old_cut(table(spark, sf, "pairs").where("context is not null"), "context").select("pair_id", "cut", "kind")


def old_cut(df, text: str):
    """df with cut and kind."""
    first = F.regexp_extract(text, r"(?s)^(.*?[.!?])\s+[A-Z0-9\"'(]", 1)
    x = df.withColumn("_s", F.when(first != "", first).otherwise(F.col(text)))
    full = F.regexp_replace(F.substring("_s", 1, 80), r"(?s) [^ ]*\z", "")
    x = x.withColumn("_f", F.when(F.contains(F.substring("_s", 1, 80), F.lit(" ")), full).otherwise(F.substring("_s", 1, 80)))
    at = F.length("_f") - F.length(F.regexp_replace("_f", "(?s)^.*[,;]", ""))
    clause = F.col("_f").rlike("[,;]") & (at - 1 >= 40)
    whole = F.length("_s") <= 80
    x = x.withColumn("cut", F.when(whole, F.col("_s")).when(clause, F.substring("_f", F.lit(1), at - 1)).otherwise(F.col("_f")))
    return x.withColumn("kind", F.when(whole, "sentence").when(clause, "clause").otherwise("midphrase")).drop("_s", "_f")


@query("m5_hashed_features", f"""with t as (select pair_id, unnest(list_concat({S.words('prompt')}, list_transform({S.words('prompt')}, lambda w: 'len' || length(w)))) as f from pairs where category = 'calc' and prompt is not null),
  h as (select pair_id, ('0x' || substr(md5(f), 1, 6))::int as h from t)
  select pair_id, h % 1024 as dim, greatest(-7, least(7, sum(case when h // 1024 % 2 = 0 then 1 else -1 end))) as v from h group by 1, 2""")
def m5_hashed_features(spark, sf):
    """Signed counts of hashed words and lengths of calc questions, clipped; m5_question_features has all kinds, of all questions."""
    ws = T.word_list(F.col("prompt"))
    x = table(spark, sf, "pairs").where("category = 'calc' and prompt is not null").select("pair_id", F.explode(F.concat(ws, F.transform(ws, lambda w: F.concat(F.lit("len"), F.length(w).cast("string"))))).alias("f"))
    x = x.select("pair_id", F.conv(F.substring(F.md5("f"), 1, 6), 16, 10).cast("long").alias("h"))
    sign = F.when(F.floor(F.col("h") / 1024) % 2 == 0, 1).otherwise(-1)
    return x.groupBy("pair_id", (F.col("h") % 1024).alias("dim")).agg(F.greatest(F.lit(-7), F.least(F.lit(7), F.sum(sign))).alias("v"))


@query("m5_question_features")
def m5_question_features(spark, sf):
    """M5: hashed words, shapes, digits, bigrams and character n-grams of every question: its buckets and their clipped signed counts."""
    return table(spark, sf, "pairs").where("prompt is not null").select("pair_id", "prompt").mapInArrow(features.run, "pair_id long, dims array<int>, vs array<int>")


@query("r3_relation", f"""select pair_id, case when list_has_any(w, ['capital']) then 'capital' when list_has_any(w, ['born']) then 'birth' when list_has_any(w, ['founded', 'built', 'started']) then 'founder' when list_has_any(w, ['river']) then 'river'
  when list_has_any(w, ['live', 'people']) then 'population' when list_has_any(w, ['where', 'location']) then 'place' when list_has_any(w, ['known', 'famous']) then 'fame' when list_has_any(w, ['who', 'old']) then 'person' end as relation
  from (select pair_id, {S.words('prompt')} as w from pairs where category = 'factual' and prompt is not null)""")
def r3_relation(spark, sf):
    cues = [("capital", ["capital"]), ("birth", ["born"]), ("founder", ["founded", "built", "started"]), ("river", ["river"]), ("population", ["live", "people"]), ("place", ["where", "location"]), ("fame", ["known", "famous"]), ("person", ["who", "old"])]
    x = table(spark, sf, "pairs").where("category = 'factual' and prompt is not null").select("pair_id", T.word_list(F.col("prompt")).alias("w"))
    return x.select("pair_id", F.coalesce(*[F.when(T.any_of(F.col("w"), ws), F.lit(r)) for r, ws in cues]).alias("relation"))


@query("l4_first_unique", f"select prompt from pairs where prompt is not null group by prompt order by {_H('4', 'prompt')}, prompt limit 200")
def l4_first_unique(spark, sf):
    return first_unique(table(spark, sf, "pairs").where("prompt is not null"), "prompt", "4", 200)


def first_unique(df, col: str, seed: str, n: int):
    """L4: the first n distinct values in the order of a hash; too few are an error."""
    out = cut(df.select(col).distinct().orderBy(T.hash_order(seed, col), col).limit(n), "unique")
    if out.count() < n:
        raise ValueError(f"fewer than {n} values of {col}")
    return out


@query("l5_even_cycles", "select subject, unnest(range(case when row_number() over (order by subject) <= 37 % count(*) over () then 37 // count(*) over () + 1 else 37 // count(*) over () end)) as k from subjects")
def l5_even_cycles(spark, sf):
    s = table(spark, sf, "subjects").select("subject")
    w = Window.orderBy("subject")  # ten fixed rows
    x = s.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    times = F.floor(F.lit(37) / F.col("n")) + (F.col("rn") <= F.lit(37) % F.col("n")).cast("int")
    return x.select("subject", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("k"))


@query("w9_best_per_entity", "select category, source, pair_id from (select category, source, arg_max(pair_id, (length(answer), -pair_id)) as pair_id, min(pair_id) as first_seen from pairs where answer is not null group by 1, 2) qualify row_number() over (partition by category order by first_seen) <= 8")
def w9_best_per_entity(spark, sf):
    p = table(spark, sf, "pairs").where("answer is not null").groupBy("category", "source").agg(F.max_by("pair_id", F.struct(F.length("answer"), -F.col("pair_id"))).alias("pair_id"), F.min("pair_id").alias("first_seen"))
    return p.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy("first_seen"))).where("rn <= 8").select("category", "source", "pair_id")


@query("category_tier_gaps", "select category, tier, n, n - lead(n) over (partition by category order by n desc, tier) as gap from (select category, tier, count(*) as n from pairs group by 1, 2)")
def category_tier_gaps(spark, sf):
    c = table(spark, sf, "pairs").groupBy("category", "tier").agg(F.count("*").alias("n"))
    return c.withColumn("gap", F.col("n") - F.lead("n").over(Window.partitionBy("category").orderBy(F.col("n").desc(), F.col("tier").asc_nulls_last())))


@query("g1_factual_questions", """select 'which region is ' || n_name || ' in' as prompt, r_name as answer from nation join region on n_regionkey = r_regionkey
  union all select 'is ' || n_name || ' in ' || r.r_name, case when n_regionkey = r.r_regionkey then 'yes' else 'no' end from nation, region r
  union all select 'how many nations are in ' || r_name, count(*)::varchar from nation join region on n_regionkey = r_regionkey group by r_name""")
def g1_factual_questions(spark, sf):
    """Questions whose answers the fixed tables of nations and regions give."""
    n, r = table(spark, sf, "nation"), F.broadcast(table(spark, sf, "region"))
    every = n.crossJoin(r)  # 25 by 5 fixed rows
    own = every.where("n_regionkey = r_regionkey")
    where = own.select(F.concat(F.lit("which region is "), "n_name", F.lit(" in")).alias("prompt"), F.col("r_name").alias("answer"))
    inside = every.select(F.concat(F.lit("is "), "n_name", F.lit(" in "), "r_name").alias("prompt"), F.when(F.col("n_regionkey") == F.col("r_regionkey"), "yes").otherwise("no").alias("answer"))
    many = own.groupBy("r_name").agg(F.count("*").cast("string").alias("answer")).select(F.concat(F.lit("how many nations are in "), "r_name").alias("prompt"), "answer")
    return where.unionByName(inside).unionByName(many)


@query("g2_arithmetic", f"""with r as (select range as k from range(10000)), t as (select k, k // 100 as a, k % 100 as b from r), p as (
  select 'what is ' || a || ' plus ' || b as prompt, a + b as answer, case when a < 10 and b < 10 then 1 when a < 50 then 2 else 3 end as tier, k from t)
  select prompt, answer, tier from p qualify row_number() over (partition by tier order by {_H('g2', 'k')}) <= 50""")
def g2_arithmetic(spark, sf):
    """Prompts are unique by construction; so many of each tier in the order of a hash."""
    t = spark.range(10_000).withColumnRenamed("id", "k").select("k", F.floor(F.col("k") / 100).alias("a"), (F.col("k") % 100).alias("b"))
    tier = F.when((F.col("a") < 10) & (F.col("b") < 10), 1).when(F.col("a") < 50, 2).otherwise(3)
    p = t.withColumn("tier", tier).withColumn("rn", F.row_number().over(Window.partitionBy("tier").orderBy(T.hash_order("g2", "k")))).where("rn <= 50")
    return p.select(F.concat(F.lit("what is "), "a", F.lit(" plus "), "b").alias("prompt"), (F.col("a") + F.col("b")).alias("answer"), "tier")


@query("f26_noise", f"select pair_id, array_to_string(list_filter(string_split(prompt, ' '), lambda w, i: ascii(substr({_H('n', 'pair_id', 'i')}, 1, 1)) % 8 <> 0), ' ') as noisy from pairs where prompt is not null")
def f26_noise(spark, sf):
    """Word dropout by a hash of row and place."""
    keep = F.filter(F.split("prompt", " "), lambda w, i: F.ascii(F.substring(F.md5(F.concat_ws("|", F.lit("n"), F.col("pair_id").cast("string"), (i + 1).cast("string"))), 1, 1)) % 8 != 0)
    return table(spark, sf, "pairs").where("prompt is not null").select("pair_id", F.array_join(keep, " ").alias("noisy"))


# What may stand before a question, with a colon behind it; and the tables' own.
_WRAPS = [
    "Answer briefly", "One more question", "Real quick", "Short answer please", "Simple question", "Just curious", "Mind answering this", "Tell me", "Quick question", "Here's a question", "Please answer", "Fact check", "Answer this", "For my homework", "Here's a quick one",
    "Trivia question", "For the record", "Give me a one-word answer", "Just the answer", "Help me out here", "Briefly", "No explanation needed", "Can you tell me", "I need to know", "In one word", "Pop quiz",
]
_WRAP = "(?i)^(?:Q: )?(?:(?:I was wondering|I'm curious),? )?(?:(?:" + "|".join(_WRAPS) + "): )?(?:(?:please|hey|ok so|just wondering|next up)[,:]? +)?"


@query("pred13_wrapper_strip", f"select pair_id, case when ('0x' || substr({_H('w', 'pair_id')}, 1, 8))::bigint % 100 < 40 then regexp_replace(prompt, {S.q(_WRAP)}, '') else prompt end as prompt from pairs where prompt is not null")
def pred13_wrapper_strip(spark, sf):
    """Two in five prompts, by hash, lose what stands before the question."""
    some = F.conv(F.substring(T.hash_order("w", "pair_id"), 1, 8), 16, 10).cast("long") % 100 < 40
    return table(spark, sf, "pairs").where("prompt is not null").select("pair_id", F.when(some, F.regexp_replace("prompt", _WRAP, "")).otherwise(F.col("prompt")).alias("prompt"))


_ISO = "case when n_chars is null then strftime(fetched_at, '%Y') when n_chars % 2 = 0 then strftime(fetched_at, '%Y-%m') else strftime(fetched_at, '%Y-%m-%d') end"


@query("d6_date_text", f"select doc_id, {_ISO} as date, case when n_chars is null then 'in ' || year(fetched_at) when n_chars % 2 = 0 then 'in ' || strftime(fetched_at, '%B ') || year(fetched_at) else 'on ' || day(fetched_at) || strftime(fetched_at, ' %B ') || year(fetched_at) end as said from documents where fetched_at is not null")
def d6_date_text(spark, sf):
    """Dates of all three lengths (made of the fetching times) in words, with on or in."""
    d = F.when(F.col("n_chars").isNull(), F.date_format("fetched_at", "yyyy")).when(F.col("n_chars") % 2 == 0, F.date_format("fetched_at", "yyyy-MM")).otherwise(F.date_format("fetched_at", "yyyy-MM-dd"))
    return table(spark, sf, "documents").where("fetched_at is not null").select("doc_id", d.alias("date"), T.date_said(d).alias("said"))


@query("f37_rendered_facts")
def f37_rendered_facts(spark, sf):
    """A sentence for each field of each entity, by relation."""
    f = knowledge.entity_fields(knowledge.entities(table(spark, sf, "wiki_pages"))).where("not missing")
    return with_sentence(f, "rel").select("t", "rel", "sentence")


@query("v6_latency_rows", "select custom_id, epoch_us(received_at) - epoch_us(submitted_at) as wait_us from batch_results join request_shards using (custom_id)")
def v6_latency_rows(spark, sf):
    r = table(spark, sf, "request_shards").select("custom_id", "submitted_at")
    return table(spark, sf, "batch_results").select("custom_id", "received_at").join(r, "custom_id").select("custom_id", (F.unix_micros("received_at") - F.unix_micros("submitted_at")).alias("wait_us"))


@query("late_loads", "select category, count_if(loaded_at - created_at > interval 2 days) as late, count_if(loaded_at is null) as never from pairs group by 1")
def late_loads(spark, sf):
    late = F.unix_micros("loaded_at") - F.unix_micros("created_at") > 2 * 86_400_000_000
    return table(spark, sf, "pairs").groupBy("category").agg(F.count_if(late).alias("late"), F.count_if(F.col("loaded_at").isNull()).alias("never"))


_ACTUAL = "(select id, case when id like '%2' then upper(answer) when id like '%4' then null else answer end as actual from eval_suite where id not like '%9')"


@query("v2_parity_verdicts", f"select e.id, case when e.answer is null then 'safety-pass' when o.actual is not distinct from e.answer and o.id is not null then 'exact' when o.actual = upper(e.answer) and e.id like '%12' then 'known-divergence' else 'FAIL' end as verdict from eval_suite e left join {_ACTUAL} o using (id)")
def v2_parity_verdicts(spark, sf):
    """V2: items without a right answer pass by not failing; others by the answer, or by the output that is on record for them."""
    e = table(spark, sf, "eval_suite").select("id", "answer")
    id_ = F.col("id")
    actual = e.where(~id_.like("%9")).select("id", F.when(id_.like("%2"), F.upper("answer")).when(~id_.like("%4"), F.col("answer")).alias("actual"), F.lit(True).alias("ran"))
    known = e.where(id_.like("%12")).select("id", F.upper("answer").alias("on_record"))
    x = e.join(actual, "id", "left").join(known, "id", "left")
    exact = F.col("ran").isNotNull() & F.col("actual").eqNullSafe(F.col("answer"))
    return x.select("id", F.when(F.col("answer").isNull(), "safety-pass").when(exact, "exact").when(F.col("actual") == F.col("on_record"), "known-divergence").otherwise("FAIL").alias("verdict"))


@query("v3_suite_coverage", "select id, scoring from (select id, scoring, answer, accept from auto_dev_40 union all select id, scoring, answer, accept from eval_suite union all select 'broken-' || id, scoring, 'x' || substr(answer, 3), accept from auto_dev_40) where scoring in ('regex', 'python-ast') and len(list_filter(accept, lambda a: regexp_matches(answer, a, 'i'))) = 0")
def v3_suite_coverage(spark, sf):
    """V3: items whose own answer doesn't pass them (here also copies with broken answers)."""
    cols = ["id", "scoring", "answer", "accept"]
    dev = table(spark, sf, "auto_dev_40").select(*cols)
    broken = dev.select(F.concat(F.lit("broken-"), "id").alias("id"), "scoring", F.concat(F.lit("x"), F.substring("answer", F.lit(3), F.length("answer"))).alias("answer"), "accept")
    x = broken.unionByName(dev).unionByName(table(spark, sf, "eval_suite").select(*cols)).where("scoring in ('regex', 'python-ast')")
    ok = scoring.matches(F.col("answer"), F.col("accept"), F.col("answer"), F.col("scoring"))
    return x.where(~F.coalesce(ok, F.lit(False))).select("id", "scoring")


_REPORT = scoring._SCORED + "select split as run, category, count_if(coalesce(correct, false)) as ok, count(*) as n from scored group by 1, 2"


@query("v5_run_summaries", f"select run, max(case when category = 'python' then ok || '/' || n end) as python, max(case when category = 'bugfix' then ok || '/' || n end) as bugfix, sum(ok)::bigint || '/' || sum(n)::bigint as overall from ({_REPORT}) group by 1")
def v5_run_summaries(spark, sf):
    """V5: report lines of each run (category, right/all) read back by a pattern, one summary row a run."""
    s = scoring.scored(spark, sf).groupBy(F.col("split").alias("run"), "category").agg(F.count_if(F.coalesce("correct", F.lit(False))).alias("ok"), F.count("*").alias("n"))
    lines = s.select("run", F.format_string("%-10s %d/%d", "category", "ok", "n").alias("line"))
    x = lines.select("run", F.regexp_extract("line", r"^(\w+)\s", 1).alias("category"), F.regexp_extract("line", r"(\d+/\d+)$", 1).alias("rate"))
    x = x.withColumn("ok", F.split_part("rate", F.lit("/"), F.lit(1)).cast("long")).withColumn("n", F.split_part("rate", F.lit("/"), F.lit(2)).cast("long"))
    of = lambda c: F.max(F.when(F.col("category") == c, F.col("rate"))).alias(c)
    return x.groupBy("run").agg(of("python"), of("bugfix"), F.concat(F.sum("ok").cast("string"), F.lit("/"), F.sum("n").cast("string")).alias("overall"))


def spans(tags):
    """M7: (begin, end) of a text's tags, from 1 on, behind its last: one B, then I in a row; null if they are broken, or there are none."""
    first, last = F.array_position(tags, "B"), F.size(tags) - F.coalesce(F.nullif(F.array_position(F.reverse(tags), "I"), F.lit(0)), F.size(tags) - F.array_position(tags, "B") + 1) + 1
    inside = F.slice(tags, F.greatest(F.lit(1), (first + 1).cast("int")), F.greatest(F.lit(0), (last - first).cast("int")))
    whole = (first > 0) & (F.size(F.filter(tags, lambda t: t == "B")) == 1) & F.forall(inside, lambda t: t == "I") & (F.size(F.filter(tags, lambda t: t == "I")) == F.size(inside))
    return F.when(whole, F.struct(first.cast("int").alias("begin"), (last + 1).cast("int").alias("end")))


_TAGS = "list_transform(w, lambda x, i: case when i = 3 then 'B' when i > 3 and (i < 6 or x <> 'and') then 'I' else 'O' end)"


@query("m7_tag_spans", f"""with t as (select pair_id, {_TAGS} as tags from (select pair_id, {S.words('prompt')} as w from pairs where category = 'transform' and prompt is not null)),
  p as (select pair_id, tags, list_position(tags, 'B') as b, len(list_filter(tags, lambda x: x = 'I')) as n from t)
  select pair_id, b::int as begin, (b + n + 1)::int as "end" from p where b > 0 and len(list_filter(tags[b + 1:b + n], lambda x: x <> 'I')) = 0""")
def m7_tag_spans(spark, sf):
    """M7: spans of tag sequences (here by place and word, an and breaks them); broken ones give none."""
    x = table(spark, sf, "pairs").where("category = 'transform' and prompt is not null").select("pair_id", T.word_list(F.col("prompt")).alias("w"))
    tags = F.transform("w", lambda v, i: F.when(i == 2, "B").when((i > 2) & ((i < 5) | (v != "and")), "I").otherwise("O"))
    return x.select("pair_id", spans(tags).alias("s")).where("s is not null").select("pair_id", "s.begin", "s.end")
