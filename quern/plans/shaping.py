"""Sampling, mixtures, chunks, generated rows, token windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import packing as P
from quern.operators.numbering import numbered
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


def _h(seed: str, *ids: str) -> str:
    return f"md5(concat_ws('|', '{seed}', " + ", ".join(f"cast({i} as varchar)" for i in ids) + "))"


@query("l1_md5_shuffle", f"select pair_id, category, {_h('42', 'pair_id')} as ord, row_number() over (partition by category order by {_h('42', 'pair_id')}) as pos from pairs")
def l1_md5_shuffle(spark, sf):
    x = table(spark, sf, "pairs").select("pair_id", "category", T.hash_order("42", "pair_id").alias("ord"))
    return numbered(x, ["category"], ["ord", "pair_id"], "pos")


@query("l2_product_sample", f"""with c as (select count(*) as n from nation), s as (select range as k from range(625) order by {_h('l2', 'range')} limit 100)
  select k, a.n_name as first, b.n_name as second from s, nation a, nation b where a.n_nationkey = k // 25 and b.n_nationkey = k % 25""")
def l2_product_sample(spark, sf):
    """Sampled places of the product space are decoded by mixed radix; the product itself is never made."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    s = spark.range(625).withColumnRenamed("id", "k").orderBy(T.hash_order("l2", "k")).limit(100)
    a, b = n.toDF("a", "first"), n.toDF("b", "second")
    return s.join(F.broadcast(a), F.floor(F.col("k") / 25) == F.col("a")).join(F.broadcast(b), F.col("k") % 25 == F.col("b")).select("k", "first", "second")


_DRAW = f"('0x' || substr({_h('up', 'd.category', 'draw')}, 1, 15))::bigint % d.n"


@query("l3_upsample_with_replacement", f"""with r as (select category, pair_id, row_number() over (partition by category order by pair_id) - 1 as pos, count(*) over (partition by category) as n from pairs where answer is not null),
  c as (select distinct category, n from r), d as (select category, n, unnest(range(50)) as draw from c)
  select d.category, draw, pair_id from d join r on r.category = d.category and r.pos = {_DRAW}""")
def l3_upsample_with_replacement(spark, sf):
    """60 bits of a hash choose the place; rows are numbered in ranges, and only the drawn places are looked up."""
    p = table(spark, sf, "pairs").where("answer is not null").select("category", "pair_id")
    r = numbered(p, ["category"], ["pair_id"], "pos", "n")
    draws = p.groupBy("category").agg(F.count("*").alias("n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(49))))
    draws = draws.withColumn("pos", F.conv(F.substring(T.hash_order("up", "category", "draw"), 1, 15), 16, 10).cast("long") % F.col("n") + 1)
    return r.drop("n").join(F.broadcast(draws), ["category", "pos"]).select("category", F.col("draw").cast("long").alias("draw"), "pair_id")  # fifty draws a category


@query("l6_stratified_first", f"select category, tier, pair_id from pairs qualify row_number() over (partition by category, tier order by {_h('6', 'pair_id')}) <= case when tier = 1 then 20 when tier = 2 then 10 else 5 end")
def l6_stratified_first(spark, sf):
    cap = F.when(F.col("tier") == 1, 20).when(F.col("tier") == 2, 10).otherwise(5)
    x = table(spark, sf, "pairs").select("category", "tier", "pair_id", T.hash_order("6", "pair_id").alias("h"))
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("category", "tier").orderBy("h", "pair_id")))  # the bound of 20 lets each task keep its first only
    return x.where((F.col("rn") <= cap) & (F.col("rn") <= 20)).select("category", "tier", "pair_id")


@query("l7_sha1_bucket", "select pair_id, cast(('0x' || substr(sha1(prompt), 1, 2)) as int) % 5 as bucket from pairs where prompt is not null")
def l7_sha1_bucket(spark, sf):
    return table(spark, sf, "pairs").where("prompt is not null").select("pair_id", T.sha1_bucket(F.col("prompt")).alias("bucket"))


@query("w19_validation_split", f"select category, count_if(rn <= least(100, n // 20)) as held_out, count(*) as n from (select category, row_number() over (partition by category order by {_h('19', 'pair_id')}) as rn, count(*) over (partition by category) as n from pairs) group by 1")
def w19_validation_split(spark, sf):
    x = numbered(table(spark, sf, "pairs").select("category", "pair_id", T.hash_order("19", "pair_id").alias("h")), ["category"], ["h", "pair_id"], "rn", "n")
    return x.groupBy("category").agg(F.count_if(F.col("rn") <= F.least(F.lit(100), F.floor(F.col("n") / 20))).alias("held_out"), F.count("*").alias("n"))


_SRC = "coalesce(nullif(replace(lower(trim(source)), '_', '-'), ''), 'unknown')"


@query("w15_mixture_caps", f"select source, pair_id from (select {_SRC} as source, pair_id, answer from pairs) where answer is not null qualify row_number() over (partition by source order by {_h('mix', 'pair_id')}) <= case when source in ('synth-joke', 'idk-nohit') then 1000000 else 150 end")
def w15_mixture_caps(spark, sf):
    source = F.coalesce(F.nullif(F.translate(F.lower(F.trim("source")), "_", "-"), F.lit("")), F.lit("unknown"))
    x = table(spark, sf, "pairs").where("answer is not null").select(source.alias("source"), "pair_id")
    x = x.withColumn("h", T.hash_order("mix", "pair_id"))
    free = F.col("source").isin("synth-joke", "idk-nohit")
    first = x.where(~free).withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("h", "pair_id"))).where("rn <= 150")  # each task keeps its first 150
    many = numbered(x.where(free), ["source"], ["h", "pair_id"]).where("rn <= 1000000")
    return first.select("source", "pair_id").unionByName(many.select("source", "pair_id"))


@query("l9_plan_shares", "select mix, round(sum(case when mix = 'balanced' and source = 'chat-log' then 0.5 else target_share end), 6) as total, abs(sum(case when mix = 'balanced' and source = 'chat-log' then 0.5 else target_share end) - 1) < 1e-6 as ok from mix_plan group by 1")
def l9_plan_shares(spark, sf):
    return share_totals(table(spark, sf, "mix_plan"), {("balanced", "chat-log"): 0.5})


def share_totals(plan, override: dict[tuple[str, str], float] | None = None):
    """(mix, total, ok) of a plan's shares, some of them overridden; they must add up to 1."""
    share = F.col("target_share")
    for (mix, source), value in (override or {}).items():
        share = F.when((F.col("mix") == mix) & (F.col("source") == source), value).otherwise(share)
    return plan.groupBy("mix").agg(F.round(F.sum(share), 6).alias("total"), (F.abs(F.sum(share) - 1) < 1e-6).alias("ok"))


@query("u1_union_pools", "select origin, count(*) as n, count(tier) as tiers from (select 'pairs' as origin, tier from pairs union all select 'suite', tier from eval_suite union all select 'dev', tier from auto_dev_40 union all select 'raw', null from raw_lines) group by 1")
def u1_union_pools(spark, sf):
    pools = [table(spark, sf, t).select(F.lit(n).alias("origin"), "tier") for n, t in (("pairs", "pairs"), ("suite", "eval_suite"), ("dev", "auto_dev_40"))]
    x = pools[0].unionByName(pools[1]).unionByName(pools[2]).unionByName(table(spark, sf, "raw_lines").select(F.lit("raw").alias("origin")), allowMissingColumns=True)
    return x.groupBy("origin").agg(F.count("*").alias("n"), F.count("tier").alias("tiers"))


_BUCKET = "cast(('0x' || substr(sha1(prompt), 1, 2)) as int) % 5"


@query("u3_split_template_leak", f"select template_id from pairs where template_id is not null and {_BUCKET} = 0 intersect select template_id from pairs where template_id is not null and {_BUCKET} <> 0")
def u3_split_template_leak(spark, sf):
    """Templates on both sides of the stable split."""
    p = table(spark, sf, "pairs").where("template_id is not null").select("template_id", T.sha1_bucket(F.col("prompt")).alias("bucket"))
    return p.where("bucket = 0").select("template_id").intersect(p.where("bucket <> 0").select("template_id"))


@query("w7_request_chunks", "select format('{:06d}', (rn - 1) // 5) as custom, category, list(prompt order by rn) as prompts from (select category, prompt, row_number() over (partition by category order by pair_id) as rn from pairs where prompt is not null) group by 1, 2")
def w7_request_chunks(spark, sf):
    p = numbered(table(spark, sf, "pairs").where("prompt is not null").select("category", "prompt", "pair_id"), ["category"], ["pair_id"])
    g = p.groupBy(F.format_string("%06d", F.floor((F.col("rn") - 1) / 5)).alias("custom"), "category").agg(F.array_sort(F.collect_list(F.struct("rn", "prompt"))).alias("x"))
    return g.select("custom", "category", F.transform("x", lambda y: y["prompt"]).alias("prompts"))


@query("w18_family_numbers", "select pair_id, split_part(template_id, '-', 1) as family, row_number() over (partition by split_part(template_id, '-', 1) order by pair_id) as seq from pairs where template_id is not null")
def w18_family_numbers(spark, sf):
    x = table(spark, sf, "pairs").where("template_id is not null").select("pair_id", F.split_part("template_id", F.lit("-"), F.lit(1)).alias("family"))
    return numbered(x, ["family"], ["pair_id"], "seq")


@query("g4_ordered_pairs", "select a.r_name as first, b.r_name as second, 'copy ' || lower(a.r_name) || ' to ' || lower(b.r_name) as prompt from region a, region b where a.r_name <> b.r_name")
def g4_ordered_pairs(spark, sf):
    r = table(spark, sf, "region").select("r_name")
    a, b = r.toDF("first"), r.toDF("second")
    x = a.join(F.broadcast(b), F.col("first") != F.col("second"))  # five rows each, fixed
    return x.withColumn("prompt", F.concat(F.lit("copy "), F.lower("first"), F.lit(" to "), F.lower("second")))


@query("j15_template_product", f"""with t as (select * from (values ('t1', 'what is {{x}} known for'), ('t2', 'tell me about {{x}}'), ('t3', 'who comes from {{x}}')) v(template_id, pattern))
  select template_id, n_name as slot, replace(pattern, '{{x}}', n_name) as prompt from t, nation qualify row_number() over (partition by template_id order by {_h('15', 'template_id', 'n_name')}) <= 10""")
def j15_template_product(spark, sf):
    t = spark.createDataFrame([("t1", "what is {x} known for"), ("t2", "tell me about {x}"), ("t3", "who comes from {x}")], "template_id string, pattern string")
    x = table(spark, sf, "nation").select("n_name").crossJoin(F.broadcast(t))  # three templates for each of 25 fixed rows
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("template_id").orderBy(T.hash_order("15", "template_id", "n_name")))).where("rn <= 10")
    return x.select("template_id", F.col("n_name").alias("slot"), F.replace("pattern", F.lit("{x}"), F.col("n_name")).alias("prompt"))


@query("pred15_template_fields", "select id, list_distinct(regexp_extract_all(answer, '\\{(\\w+)\\}', 1)) as fields, length(answer) - length(replace(answer, '{', '')) = length(answer) - length(replace(answer, '}', '')) as balanced from auto_dev_40")
def pred15_template_fields(spark, sf):
    count = lambda ch: F.length("answer") - F.length(F.replace("answer", F.lit(ch), F.lit("")))
    return table(spark, sf, "auto_dev_40").select("id", F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\{(\w+)\}"), 1)).alias("fields"), (count("{") == count("}")).alias("balanced"))


_IDS = f"list_transform({S.words('text')}, lambda w: length(w) * 31 + ascii(w))"


def _tokens(spark, sf):
    """Words of the documents as stand-in token ids."""
    ids = F.transform(T.word_list(F.col("text")), lambda w: F.length(w) * 31 + F.ascii(w))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", ids.alias("ids"))


@query("w10_stream_windows", f"""with t as (select doc_id, {_IDS} as ids from documents where text is not null), f as (select doc_id, unnest(ids) as token, generate_subscripts(ids, 1) as k from t),
  p as (select token, row_number() over (order by doc_id, k) - 1 as pos from f) select pos // 64 as "window", list(token order by pos) as ids from p group by 1 having count(*) = 64""")
def w10_stream_windows(spark, sf):
    return P.stream_windows(_tokens(spark, sf), "doc_id", "ids", 64)


@query("w11_padded_windows", f"select doc_id, list_resize(ids[1:64], 64, 0) as ids from (select doc_id, {_IDS} as ids from documents where text is not null)")
def w11_padded_windows(spark, sf):
    return _tokens(spark, sf).select("doc_id", P.padded(F.col("ids"), 64).alias("ids"))


_PAIR_IDS = f"list_transform({S.words('prompt')}, lambda w: length(w) * 31 + ascii(w))"


@query("w13_shifted_targets", f"""with t as (select pair_id, {_PAIR_IDS} as p, list_concat({_PAIR_IDS}, {_PAIR_IDS.replace('prompt', 'answer')}) as ids from pairs where prompt is not null and answer is not null)
  select pair_id, list_transform(ids, lambda x, k: case when k >= len(p) and k < len(ids) then ids[k + 1] else -1 end) as tgt from t""")
def w13_shifted_targets(spark, sf):
    ids = lambda c: F.transform(T.word_list(F.col(c)), lambda w: F.length(w) * 31 + F.ascii(w))
    x = table(spark, sf, "pairs").where("prompt is not null and answer is not null").select("pair_id", ids("prompt").alias("p"), ids("answer").alias("a"))
    x = x.select("pair_id", F.size("p").alias("n"), F.concat("p", "a").alias("ids"))
    return x.select("pair_id", P.shifted_targets(F.col("ids"), F.col("n")).alias("tgt"))


@query("w14_token_budget", """with x as (select pair_id, length(prompt) + length(answer) as n from pairs where prompt is not null and answer is not null), t as (select sum(n) as total, 3 * sum(n) // 2 as budget from x),
  y as (select pair_id, k, total * k + coalesce(sum(n) over (partition by k order by pair_id rows between unbounded preceding and 1 preceding), 0) as before, budget from x, t, (select unnest(range(3)) as k))
  select pair_id, count(*) as uses from y where before < budget group by 1""")
def w14_token_budget(spark, sf):
    """Pairs in order, from the first again when all are used, until a budget of half as many characters again is reached."""
    x = table(spark, sf, "pairs").where("prompt is not null and answer is not null").select("pair_id", (F.length("prompt") + F.length("answer")).cast("long").alias("n"))
    total = F.broadcast(x.agg(F.sum("n").alias("total")))  # one row
    x = P.running(x, "pair_id", "n", "before").crossJoin(total)
    left = F.floor(F.col("total") * 3 / 2) - F.col("before")
    return x.select("pair_id", F.ceil(left / F.col("total")).cast("long").alias("uses")).where("uses > 0")


@query("pred14_fits_window", f"select count_if(len({S.words('prompt')}) + len({S.words('answer')}) <= 24) as fits, count(*) as n from pairs where prompt is not null and answer is not null")
def pred14_fits_window(spark, sf):
    n = F.size(T.word_list(F.col("prompt"))) + F.size(T.word_list(F.col("answer")))
    return table(spark, sf, "pairs").where("prompt is not null and answer is not null").agg(F.count_if(n <= 24).alias("fits"), F.count("*").alias("n"))


@query("a21_window_counts", f"""with t as (select list_resize(ids[1:64], 64, 0) as ids from (select {_IDS} as ids from documents where text is not null))
  select count(*) as windows, sum(len(list_filter(ids, lambda x: x <> 0))) as unpadded, sum(len(list_filter(ids, lambda x: x = 0))) as padded from t""")
def a21_window_counts(spark, sf):
    w = QUERIES["w11_padded_windows"](spark, sf)
    return w.agg(F.count("*").alias("windows"), F.sum(F.size(F.filter("ids", lambda x: x != 0))).alias("unpadded"), F.sum(F.size(F.filter("ids", lambda x: x == 0))).alias("padded"))


@query("w12_greedy_paragraphs", """with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents where text is not null), n as (select doc_id, line, length(t) as n from l),
  g as (select doc_id, line, n, 0::bigint as pack, n as used from n where line = 0
    union all select n.doc_id, n.line, n.n, case when g.used > 0 and g.used + n.n > 256 then g.pack + 1 else g.pack end, case when g.used > 0 and g.used + n.n > 256 then n.n else g.used + n.n end from g join n on n.doc_id = g.doc_id and n.line = g.line + 1)
  select doc_id, line::int as line, n::int as n, pack from g""")
def w12_greedy_paragraphs(spark, sf):
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return P.greedy_paragraphs(lines.select("doc_id", "line", F.length("t").alias("n")), "doc_id", "line", "n", 256)


@query("w16_round_robin_templates", """with p as (select pair_id, category, row_number() over (partition by category order by pair_id) as rn, dense_rank() over (order by category) as c from pairs),
  t as (select pair_id, category, (rn - 1 + c) % 5 as template, rn from p) select pair_id, category, template from t qualify row_number() over (partition by category, template order by rn) <= 40""")
def w16_round_robin_templates(spark, sf):
    """Templates in turn, beginning one further in each category; a family (category and template) has at most 40 rows."""
    p = table(spark, sf, "pairs").select("pair_id", "category")
    rank = F.broadcast(p.select("category").distinct().withColumn("c", F.dense_rank().over(Window.orderBy("category"))))  # the seven categories
    first = p.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy("pair_id"))).where("rn <= 200")  # 40 of each of five templates
    return first.join(rank, "category").select("pair_id", "category", ((F.col("rn") - 1 + F.col("c")) % 5).cast("long").alias("template"))
