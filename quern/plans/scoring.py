"""Scoring of outputs, reports, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.pycode import any_pattern, compile_all, line_parses, parse_label, verdicts
from quern.plans import sqltext as S
from quern.session import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def outputs(spark, sf) -> DataFrame:
    """Outputs (id, output) of the short suites: the first answer that the pairs have to an item's prompt."""
    items, pairs = table(spark, sf, "auto_dev_40").select("id", "prompt"), table(spark, sf, "pairs").select("prompt", "answer", "pair_id").where("answer is not null")
    first = pairs.join(F.broadcast(items), "prompt").groupBy("id").agg(F.min_by("answer", "pair_id").alias("output"))
    return first


def matches(line, accept, answer, scoring, reject=None):
    """how a line is held against the item, by its scoring; judge items have no verdict.

    Patterns are searched ignoring case, Python lines must parse as well, numbers are the line's last and the item's
    answer, and what a reject pattern finds is wrong.
    """
    norm = T.answer_norm(line)
    numbers = F.regexp_extract_all(line, F.lit(r"(-?\d+(?:\.\d+)?)"), 1)
    rejected = F.lit(False) if reject is None else F.coalesce(any_pattern(line, reject), F.lit(False)) & (scoring != "judge")
    return (
        F.when(rejected, F.lit(False))
        .when(scoring == "exact", F.exists(accept, lambda a: norm == T.answer_norm(a)))
        .when(scoring == "contains", F.exists(accept, lambda a: T.whole_words(norm, T.answer_norm(a))))
        .when(scoring == "numeric", F.coalesce(F.abs(F.try_element_at(numbers, F.lit(-1)).cast("double") - answer.try_cast("double")) < 1e-6, F.lit(False)))
        .when(scoring == "regex", any_pattern(line, accept))
        .when(scoring == "python-ast", any_pattern(line, accept) & line_parses(line))
    )


_OUT = "out as (select i.id, arg_min(p.answer, p.pair_id) as output from auto_dev_40 i join pairs p using (prompt) where p.answer is not null group by 1)"
_NORM = lambda x: f"regexp_replace(regexp_replace(lower({x}), '^[`\"'' \t]+|[`\"'' \t]+$', '', 'g'), '[.!?,;:]+$', '')"
_ECHO = f"case when prompt <> '' and starts_with(lower(regexp_replace(output, {S.q(f'^[{S.SPACE}]+')}, '')), lower(prompt)) then substr(regexp_replace(output, {S.q(f'^[{S.SPACE}]+')}, ''), length(prompt) + 1) else output end"
_LINE = f"coalesce(list_filter(list_transform(string_split_regex({_ECHO}, '\r\n|\r|\n'), lambda l: trim(regexp_replace(l, {S.q(f'[{S.SPACE}]+')}, ' ', 'g'))), lambda l: l <> '')[1], '')"
_SCORED = rf"""with {_OUT}, s0 as (select i.*, o.output, {_LINE} as line from auto_dev_40 i left join out o using (id)), s1 as (
  select *, {_NORM('line')} as norm from s0
), scored as (
  select id, split, category, tier, scoring, output is null as missing, length(line) > greatest(64, 8 * max_new_tokens) as over,
    case when output is null or length(line) > greatest(64, 8 * max_new_tokens) then false
      when category = 'math' and scoring <> 'judge' and not regexp_full_match(trim(output), 'calc\([0-9 .()]*[-+*/%][0-9 .()+\-*/%]*\)') then false
      when scoring = 'exact' then len(list_filter(accept, lambda a: norm = {_NORM('a')})) > 0
      when scoring = 'contains' then len(list_filter(accept, lambda a: regexp_matches(norm, '(^|\W)' || regexp_escape({_NORM('a')}) || '(\W|$)'))) > 0
      when scoring = 'numeric' then coalesce(abs(try_cast(list_last(regexp_extract_all(line, '-?\d+(?:\.\d+)?')) as double) - try_cast(answer as double)) < 1e-6, false)
      when scoring in ('regex', 'python-ast') then len(list_filter(accept, lambda a: regexp_matches(line, a, 'i'))) > 0 end as correct
  from s1)
"""


def scored(spark, sf) -> DataFrame:
    """Every item with its verdict; a missing output or too long a line is wrong, judge items have none."""
    x = table(spark, sf, "auto_dev_40").join(outputs(spark, sf), "id", "left").withColumn("line", T.first_line(F.col("output"), F.col("prompt")))
    over = F.length("line") > F.greatest(F.lit(64), 8 * F.col("max_new_tokens"))
    right = matches(F.col("line"), F.col("accept"), F.col("answer"), F.col("scoring"), F.col("reject") if "reject" in x.columns else None)
    tool = (F.col("category") != "math") | T.tool_form(F.col("output"))
    verdict = F.when(F.col("output").isNull() | over, False).otherwise(F.when(right & ~tool, False).otherwise(right))
    return x.select("id", "split", "category", "tier", "scoring", F.col("output").isNull().alias("missing"), over.alias("over"), verdict.alias("correct"))


@query("j8_scored_items", _SCORED + "select id, missing, over, correct from scored")
def j8_scored_items(spark, sf):
    return scored(spark, sf).select("id", "missing", "over", "correct")


@query("a2_accuracy_grouping_sets", _SCORED + """select split, category, tier, grouping(split, category, tier) as level, count(*) as items, count_if(missing) as missing, count_if(coalesce(correct, false)) as correct
  from scored group by grouping sets ((), (split), (category), (tier))""")
def a2_accuracy_grouping_sets(spark, sf):
    scored(spark, sf).createOrReplaceTempView("quern_scored")
    return spark.sql(
        """select split, category, tier, cast(grouping_id(split, category, tier) as bigint) as level, count(*) as items, count_if(missing) as missing, count_if(coalesce(correct, false)) as correct
        from quern_scored group by grouping sets ((), (split), (category), (tier))"""
    )


@query("a5_amortized_bytes", _SCORED + """, t as (select count_if(coalesce(correct, false)) / count(*) as acc, (select sum(octet_length(encode(output))) from out) as bytes from scored)
  select n, case when acc = 0 then null else round((4096 + bytes * n) / (n * acc), 4) end as bytes_per_correct from t, (select unnest([1, 10, 100, 1000]) as n)""")
def a5_amortized_bytes(spark, sf):
    acc = scored(spark, sf).agg((F.count_if(F.coalesce("correct", F.lit(False))) / F.count("*")).alias("acc"))
    size = outputs(spark, sf).agg(F.sum(F.octet_length("output")).alias("bytes"))
    x = acc.crossJoin(size).withColumn("n", F.explode(F.array(*map(F.lit, (1, 10, 100, 1000)))))  # one row each
    return x.select("n", F.when(F.col("acc") != 0, F.round((4096 + F.col("bytes") * F.col("n")) / (F.col("n") * F.col("acc")), 4)).alias("bytes_per_correct"))


@query("u4_missing_ids", f"with {_OUT} select id from auto_dev_40 except select id from out")
def u4_missing_ids(spark, sf):
    return table(spark, sf, "auto_dev_40").select("id").subtract(outputs(spark, sf).select("id"))


@query("j16_full_check", f"with {_OUT} select coalesce(i.id, o.id) as id, i.id is null as unknown, o.id is null as missing from auto_dev_40 i full join out o using (id) where i.id is null or o.id is null")
def j16_full_check(spark, sf):
    i, o = table(spark, sf, "auto_dev_40").select("id", F.lit(True).alias("x")), outputs(spark, sf).select("id", F.lit(True).alias("y"))
    return i.join(o, "id", "full").where("x is null or y is null").select("id", F.col("x").isNull().alias("unknown"), F.col("y").isNull().alias("missing"))


@query("pred18_subset", "select id from eval_suite where cast(regexp_extract(id, '(\\d+)$', 1) as int) % 5 = 1")
def pred18_subset(spark, sf):
    return table(spark, sf, "eval_suite").where(F.regexp_extract("id", r"(\d+)$", 1).cast("int") % 5 == 1).select("id")


_Q = lambda x: f"list_transform({x}, lambda v: greatest(-127, least(127, cast(floor(v * 100 + 0.5) as int))))"


@query("m6_int8_head", f"""with m as (select label, list(mean order by pos) as w from (select label, pos, round(avg(v), 5) as mean from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by 1, 2) group by 1),
  h as (select label, {_Q("w")} as w from m), s as (select vec_id, h.label, list_sum(list_transform({_Q('embedding::double[]')}, lambda v, i: v * w[i]))::bigint as s from embeddings, h),
  r as (select vec_id, label, s, row_number() over (partition by vec_id order by s desc, label) as k from s)
  select a.vec_id, a.label as predicted, (a.s - b.s) * 256 // 10000 as margin from r a join r b on a.vec_id = b.vec_id and a.k = 1 and b.k = 2""")
def m6_int8_head(spark, sf):
    """M6: weights and vectors as hundredths in 8 bits, whole scores, the first of equal classes, the margin to the next in 256ths."""
    q = lambda c: F.transform(c, lambda v: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(v.cast("double") * 100 + 0.5).cast("int"))))
    mean = QUERIES["a18_mean_vector"](spark, sf).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("w"))
    head = mean.select("label", q(F.transform("w", lambda x: x["mean"])).alias("w")).agg(F.array_sort(F.collect_list(F.struct("label", "w"))).alias("head"))
    dot = lambda w: F.aggregate(F.zip_with(F.col("v"), w, lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    x = table(spark, sf, "embeddings").select("vec_id", q(F.col("embedding")).alias("v")).crossJoin(F.broadcast(head))  # one row: the classes' weights
    ranked = F.sort_array(F.transform("head", lambda h: F.struct(dot(h["w"]).alias("s"), (-h["label"]).alias("l"))), asc=False)
    x = x.select("vec_id", ranked.alias("r"))
    return x.select("vec_id", (-F.col("r")[0]["l"]).alias("predicted"), F.floor((F.col("r")[0]["s"] - F.col("r")[1]["s"]) * 256 / 10000).alias("margin"))


_FAULTY = "(select id, prompt, answer, accept, scoring, max_new_tokens from eval_suite union all select id, prompt, answer, accept, scoring, max_new_tokens from auto_dev_40 union all select 'faulty-' || id, case when id like '%1' then '' else prompt end, case when id like '%2' then null else answer end, case when id like '%3' then [] when id like '%4' then ['(unclosed'] else accept end, case when id like '%5' then 'guess' when id like '%4' then 'regex' else scoring end, case when id like '%6' then 0 else max_new_tokens end from eval_suite)"


@query("s3_suite_violations", f"""select id, reason from (
  select id, unnest(list_filter([case when prompt is null or prompt = '' then 'no_prompt' end, case when answer is null then 'no_answer' end, case when accept is null or len(accept) = 0 then 'no_accept' end,
    case when scoring not in ('exact', 'contains', 'regex', 'python-ast', 'numeric', 'judge') then 'bad_scoring' end, case when scoring in ('regex', 'python-ast') and len(list_filter(accept, lambda a: a = '(unclosed')) > 0 then 'bad_pattern' end,
    case when max_new_tokens is null or max_new_tokens <= 0 then 'bad_limit' end, case when count(*) over (partition by id) > 1 then 'duplicate_id' end], lambda x: x is not null)) as reason from {_FAULTY})""")
def s3_suite_violations(spark, sf):
    """S3: all faults of both suites, and of a copy of one with planted faults, at once."""
    cols = ["id", "prompt", "answer", "accept", "scoring", "max_new_tokens"]
    suite, id_ = table(spark, sf, "eval_suite").select(*cols), F.col("id")
    bad = suite.select(
        F.concat(F.lit("faulty-"), id_).alias("id"), F.when(id_.like("%1"), "").otherwise(F.col("prompt")).alias("prompt"), F.when(~id_.like("%2"), F.col("answer")).alias("answer"),
        F.when(id_.like("%3"), F.array().cast("array<string>")).when(id_.like("%4"), F.array(F.lit("(unclosed"))).otherwise(F.col("accept")).alias("accept"), F.when(id_.like("%5"), "guess").when(id_.like("%4"), "regex").otherwise(F.col("scoring")).alias("scoring"),
        F.when(id_.like("%6"), 0).otherwise(F.col("max_new_tokens")).alias("max_new_tokens"),
    )
    return suite_faults(suite.unionByName(table(spark, sf, "auto_dev_40").select(*cols)).unionByName(bad))


def suite_faults(items: DataFrame) -> DataFrame:
    """(id, reason) of every fault of items (id, prompt, answer, accept, scoring, max_new_tokens)."""
    x = items.withColumn("n", F.count("*").over(Window.partitionBy("id")))
    patterns = F.col("scoring").isin("regex", "python-ast") & ~compile_all("accept")
    rules = [
        F.when(F.col("prompt").isNull() | (F.col("prompt") == ""), "no_prompt"), F.when(F.col("answer").isNull(), "no_answer"), F.when(F.col("accept").isNull() | (F.size("accept") == 0), "no_accept"),
        F.when(~F.col("scoring").isin("exact", "contains", "regex", "python-ast", "numeric", "judge"), "bad_scoring"), F.when(patterns, "bad_pattern"), F.when(F.col("max_new_tokens").isNull() | (F.col("max_new_tokens") <= 0), "bad_limit"), F.when(F.col("n") > 1, "duplicate_id"),
    ]
    return x.select("id", F.explode(F.array_compact(F.array(*rules))).alias("reason"))


@query("a3_length_stats", """select coalesce(source, '?') as source, round(avg(n), 6) as mean, list_sort(list(n))[len(list(n)) // 2 + 1] as upper_median, max(n) as longest
  from (select source, length(text) as n from documents where text is not null) group by 1""")
def a3_length_stats(spark, sf):
    """The exact upper median without a list of a whole group: ranks of the distinct lengths' counts."""
    n = table(spark, sf, "documents").where("text is not null").select(F.coalesce("source", F.lit("?")).alias("source"), F.length("text").cast("long").alias("n"))
    return _at_rank(n, "source", "n", lambda total: F.floor(total / 2) + 1, "upper_median").join(n.groupBy("source").agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("longest")), "source")


def _at_rank(df: DataFrame, key: str, value: str, rank, name: str) -> DataFrame:
    """The value at a rank of each group, from counts by value (bounded by the number of distinct values)."""
    c = df.groupBy(key, value).count()
    run = Window.partitionBy(key).orderBy(value)
    c = c.withColumn("upto", F.sum("count").over(run)).withColumn("total", F.sum("count").over(Window.partitionBy(key)))
    return c.where(F.col("upto") >= rank(F.col("total"))).groupBy(key).agg(F.min(value).alias(name))


@query("a4_p95_floor_index", "select coalesce(lang, '?') as lang, list_sort(list(length(text)))[cast(floor(.95 * count(*)) as int) + 1] as p95 from documents where text is not null group by 1")
def a4_p95_floor_index(spark, sf):
    n = table(spark, sf, "documents").where("text is not null").select(F.coalesce("lang", F.lit("?")).alias("lang"), F.length("text").cast("long").alias("n"))
    return _at_rank(n, "lang", "n", lambda total: F.floor(F.lit(0.95) * total) + 1, "p95")


@query("a6_conflicting_results", "select custom_id, count(*) as deliveries, count(distinct r) as results from (select custom_id, result::varchar as r from batch_results union all select custom_id, 'changed' from batch_results where custom_id like '%7') group by 1 having count(distinct r) > 1")
def a6_conflicting_results(spark, sf):
    """What should be the same in all deliveries of a request and isn't (here also changed copies of every tenth)."""
    r = table(spark, sf, "batch_results").select("custom_id", F.sha2(F.to_json("result"), 256).alias("h"))
    r = r.unionByName(r.where("custom_id like '%7'").withColumn("h", F.lit("changed")))
    return r.groupBy("custom_id").agg(F.count("*").alias("deliveries"), F.countDistinct("h").alias("results")).where("results > 1")


@query("a10_category_outcome_pivot", """select category, count_if(answer is null) as no_answer, count_if(answer is not null and length(answer) < 20) as short, count_if(length(answer) >= 20) as long from pairs group by rollup (category)""")
def a10_category_outcome_pivot(spark, sf):
    kind = F.when(F.col("answer").isNull(), "no_answer").when(F.length("answer") < 20, "short").otherwise("long")
    x = table(spark, sf, "pairs").select("category", kind.alias("kind"))
    p = x.groupBy("category").pivot("kind", ["no_answer", "short", "long"]).count().na.fill(0, ["no_answer", "short", "long"])
    return p.unionByName(p.agg(*[F.sum(k).alias(k) for k in ("no_answer", "short", "long")]).withColumn("category", F.lit(None).cast("string")))


@query("a13_copy_rate", f"""select category, count(*) as n, count_if(answer = prompt) as exact, count_if({S.key('answer')} = {S.key('prompt')}) as near from pairs where answer is not null and prompt is not null group by 1""")
def a13_copy_rate(spark, sf):
    same = T.normalize_key(F.col("answer")) == T.normalize_key(F.col("prompt"))
    return table(spark, sf, "pairs").where("answer is not null and prompt is not null").groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("answer") == F.col("prompt")).alias("exact"), F.count_if(same).alias("near"))


@query("a16_distincts", "select category, count(distinct prompt) as prompts, count(distinct answer) as answers, round(1 - count(distinct prompt) / count(*), 6) as loss from pairs group by 1")
def a16_distincts(spark, sf):
    return table(spark, sf, "pairs").groupBy("category").agg(F.countDistinct("prompt").alias("prompts"), F.countDistinct("answer").alias("answers"), F.round(1 - F.countDistinct("prompt") / F.count("*"), 6).alias("loss"))


@query("a17_arg_min", "select category, arg_min(pair_id, (length(answer), pair_id)) as pair_id from pairs where answer is not null group by 1")
def a17_arg_min(spark, sf):
    return table(spark, sf, "pairs").where("answer is not null").groupBy("category").agg(F.min_by("pair_id", F.struct(F.length("answer"), "pair_id")).alias("pair_id"))


@query("a18_mean_vector", "select label, pos, round(avg(v), 5) as mean from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by 1, 2")
def a18_mean_vector(spark, sf):
    x = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return x.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


@query("m6_linear_head_argmax", """with m as (select label, list(mean order by pos) as w from (select label, pos, round(avg(v), 5) as mean from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by 1, 2) group by 1)
  select vec_id, m.label as predicted from embeddings e, m qualify row_number() over (partition by vec_id order by round(list_dot_product(e.embedding::double[], m.w), 6) desc, m.label) = 1""")
def m6_linear_head_argmax(spark, sf):
    """The head's weights, a row for each class, are one array; every vector is scored where it lies."""
    mean = QUERIES["a18_mean_vector"](spark, sf).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("w"))
    head = mean.select("label", F.transform("w", lambda x: x["mean"]).alias("w")).agg(F.array_sort(F.collect_list(F.struct("label", "w"))).alias("head"))
    dot = lambda w: F.aggregate(F.zip_with(F.col("embedding"), w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    x = table(spark, sf, "embeddings").crossJoin(F.broadcast(head))  # one row: the classes' weights
    best = F.array_max(F.transform("head", lambda h: F.struct(F.round(dot(h["w"]), 6).alias("s"), (-h["label"]).alias("l"))))
    return x.select("vec_id", (-best["l"]).alias("predicted"))


@query("a22_provenance_hash", """with h as (select sha256(concat_ws('|', pair_id, prompt, answer)) as h from pairs), b as (select substr(h, 1, 3) as b, sha256(string_agg(h, '' order by h)) as f from h group by 1)
  select sha256(string_agg(b || f, '' order by b)) as fingerprint from b""")
def a22_provenance_hash(spark, sf):
    """Independent of the rows' order, in two levels: the sorted hashes of each of 4096 ranges, then those of the ranges."""
    h = table(spark, sf, "pairs").select(F.sha2(F.concat_ws("|", F.col("pair_id").cast("string"), "prompt", "answer"), 256).alias("h"))
    b = h.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("f"))
    return b.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "f"))), ""), 256).alias("fingerprint"))


@query("m11_python_label")
def m11_python_label(spark, sf):
    """Does an answer parse as Python, and as what."""
    return table(spark, sf, "pairs").where("category in ('python', 'bugfix') and answer is not null").select("pair_id", parse_label(F.col("answer")).alias("label"))


@query("r11_failure_verdicts")
def r11_failure_verdicts(spark, sf):
    """Python items with their outputs: the first verdict that holds, the expected answer's parameters as binding."""
    items = table(spark, sf, "auto_dev_40").where("scoring = 'python-ast'").select("id", "answer", "category", "max_new_tokens")
    x = items.join(outputs(spark, sf), "id", "left").withColumn("line", T.first_line(F.col("output")))
    finished = F.col("output").isNotNull() & (F.length("line") <= F.greatest(F.lit(64), 8 * F.col("max_new_tokens")))
    return x.select("id", "category", verdicts("answer", "line", finished).alias("verdict"))


@query("a10_nested_verdicts")
def a10_nested_verdicts(spark, sf):
    """Family (of the id), category and verdict, with subtotals of each level."""
    v = QUERIES["r11_failure_verdicts"](spark, sf).withColumn("family", F.regexp_extract("id", r"^([a-z]+)", 1))
    kinds = ("termination_budget", "syntax", "exact", "binding", "operation_or_structure")
    return v.rollup("family", "category").agg(*[F.count_if(F.col("verdict") == k).alias(k) for k in kinds], F.count("*").alias("items"))


_OTHER = "(select id, case when id like '%3' then prompt || ' ' else prompt end as prompt, case when id like '%5' then null else answer end as answer, category from eval_suite where id not like '%7' union all select 'new-1', 'p', 'a', 'chat')"


@query("v1_field_mismatches", f"""select coalesce(e.id, o.id) as id, case when o.id is null then ['missing'] when e.id is null then ['unexpected'] else list_filter([case when e.prompt is distinct from o.prompt then 'prompt' end, case when e.answer is distinct from o.answer then 'answer' end,
  case when e.category is distinct from o.category then 'category' end], lambda x: x is not null) end as fields from eval_suite e full join {_OTHER} o using (id) where o.id is null or e.id is null or e.prompt is distinct from o.prompt or e.answer is distinct from o.answer or e.category is distinct from o.category""")
def v1_field_mismatches(spark, sf):
    """A full comparison of expected and actual rows: the fields that differ, missing rows and unexpected ones."""
    e = table(spark, sf, "eval_suite").select("id", "prompt", "answer", "category")
    id_ = F.col("id")
    o = e.where(~id_.like("%7")).select("id", F.when(id_.like("%3"), F.concat("prompt", F.lit(" "))).otherwise(F.col("prompt")).alias("prompt"), F.when(~id_.like("%5"), F.col("answer")).alias("answer"), "category")
    o = o.unionByName(spark.createDataFrame([("new-1", "p", "a", "chat")], o.schema))
    return compared(e, o, "id").where(F.size("fields") > 0)


def compared(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """V1: (key, fields): names of the fields that differ, or missing, or unexpected; empty where all are equal."""
    cols = [c for c in expected.columns if c != key]
    x = expected.select(key, F.struct(*cols).alias("e")).join(actual.select(key, F.struct(*cols).alias("a")), key, "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")), c) for c in cols]))
    return x.select(key, F.when(F.col("a").isNull(), F.array(F.lit("missing"))).when(F.col("e").isNull(), F.array(F.lit("unexpected"))).otherwise(differ).alias("fields"))


@query("v4_fingerprint_compare", "select category, case when count(distinct h) = 1 then 'MATCH' when count(h) < count(*) then 'UNKNOWN' else 'MISMATCH' end as verdict from (select category, case when answer is null then null else substr(sha256(answer), 1, 16) end as h from eval_suite) group by 1")
def v4_fingerprint_compare(spark, sf):
    x = table(spark, sf, "eval_suite").select("category", F.substring(F.sha2("answer", 256), 1, 16).alias("h"))
    return x.groupBy("category").agg(F.when(F.countDistinct("h") == 1, "MATCH").when(F.count("h") < F.count("*"), "UNKNOWN").otherwise("MISMATCH").alias("verdict"))
