"""Queries of the pair pipeline: parsing, cascade, contamination, copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import clean, contamination as C
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


_ITEMS = f"""
with req as (
  select custom_id, category, items from request_shards where custom_id is not null
  qualify row_number() over (partition by custom_id order by submitted_at desc nulls last, category desc nulls last) = 1
), res as (
  select custom_id, received_at, coalesce(result.type, '') as type,
    list_filter(list_transform(string_split_regex(array_to_string(list_transform(list_filter(result.message.content, lambda b: b.type = 'text'), lambda b: coalesce(b.text, '')), ''), '\\r\\n|\\r|\\n'),
      lambda x: regexp_replace({S.strip('x')}, '^`+|`+$', '', 'g')), lambda x: x <> '' and json_valid(x)) as ls
  from batch_results
), line as (
  select custom_id, received_at, idx, cast(json_extract(l, '$.i') as int) as i, json_extract_string(l, '$.answer') as answer
  from (select custom_id, received_at, unnest(ls) as l, generate_subscripts(ls, 1) as idx from res)
  where json_type(l) = 'OBJECT' and json_extract(l, '$.i') is not null and json_extract_string(l, '$.answer') is not null
), last as (select * from line qualify row_number() over (partition by custom_id, received_at, i order by idx desc) = 1
), item as (
  select r.custom_id, r.received_at, r.type, q.category, unnest(case when q.items is null then [null] else q.items end) as item
  from res r left join req q using (custom_id)
), items as (
  select x.custom_id, x.received_at, x.category, x.item.i as i, x.item.prompt as prompt, x.item.tier as tier, {S.strip('l.answer')} as answer,
    case when x.category is null then 'no_matching_request' when x.type <> 'succeeded' then 'batch_errored' when l.answer is null then 'missing_item' else 'ok' end as status
  from item x left join last l on l.custom_id = x.custom_id and l.received_at = x.received_at and l.i = x.item.i
)"""


@query("j2_candidate_items", _ITEMS + " select custom_id, epoch_us(received_at) as received_us, category, i, prompt, tier, answer, status from items")
def j2_candidate_items(spark, sf):
    items = clean.candidate_items(table(spark, sf, "request_shards"), table(spark, sf, "batch_results"))
    return items.withColumn("received_us", F.unix_micros("received_at")).drop("received_at")


_CASCADE = (
    _ITEMS
    + f""", suite as (
  select distinct 'prompt' as kind, {S.key('prompt')} as k from eval_suite
  union select 'answer', {S.key('answer')} from eval_suite where length({S.key('answer')}) > 12
  union select 'gram', unnest({S.grams('prompt', 8)}) from eval_suite
  union select 'gram', unnest({S.grams('answer', 8)}) from eval_suite
), sets as (select list_distinct({S.words('prompt')}) as rs from eval_suite
), near as (
  select distinct prompt from (select prompt, list_distinct({S.words('prompt')}) as ls from (select distinct prompt from items)) a, sets
  where len(ls) > 0 and len(list_intersect(ls, rs)) / (len(ls) + len(rs) - len(list_intersect(ls, rs))) >= 0.8 - 1e-12
), gram as (
  select distinct custom_id, received_at, i from (select custom_id, received_at, i, unnest(list_concat({S.grams("coalesce(prompt, '')", 8)}, {S.grams("coalesce(answer, '')", 8)})) as g from items)
  where g in (select k from suite where kind = 'gram')
), ruled as (
  select x.*, case when status <> 'ok' then status when answer = '' then 'empty_answer' when {S.refusal('answer')} then 'refusal'
    when len({S.space_words('answer')}) > 40 then 'overlong'
    when {S.key('prompt')} in (select k from suite where kind = 'prompt') then 'contamination_exact_prompt'
    when {S.key('answer')} in (select k from suite where kind = 'answer') then 'contamination_exact_answer'
    when exists (from gram g where g.custom_id = x.custom_id and g.received_at = x.received_at and g.i = x.i) then 'contamination_8gram'
    when prompt in (select prompt from near) then 'contamination_overlap' end as reason
  from items x
), done as (
  select *, case when reason is null and row_number() over (partition by {S.key('prompt')}, {S.key('answer')}, reason is null order by received_at, custom_id, i) > 1 then 'duplicate' else reason end as drop_reason from ruled
)"""
)


def _cascade(spark, sf):
    return clean.drop_reasons(clean.candidate_items(table(spark, sf, "request_shards"), table(spark, sf, "batch_results")), table(spark, sf, "eval_suite"))


@query("c2_clean_pairs", _CASCADE + " select custom_id, i, category, prompt, answer, tier from done where drop_reason is null")
def c2_clean_pairs(spark, sf):
    return _cascade(spark, sf).where("drop_reason is null").select("custom_id", "i", "category", "prompt", "answer", "tier")


@query("pred1_drop_reason_counts", _CASCADE + " select coalesce(drop_reason, 'kept') as outcome, count(*) as n from done group by 1")
def pred1_drop_reason_counts(spark, sf):
    return _cascade(spark, sf).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query("a1_kept_per_category", _CASCADE + " select category, count(*) as kept from done where drop_reason is null group by 1")
def a1_kept_per_category(spark, sf):
    return _cascade(spark, sf).where("drop_reason is null").groupBy("category").agg(F.count("*").alias("kept"))


@query("j1_unmatched_results", "select custom_id, count(*) as n from batch_results where custom_id not in (select custom_id from request_shards where custom_id is not null) group by 1")
def j1_unmatched_results(spark, sf):
    return table(spark, sf, "batch_results").where("custom_id is not null").join(table(spark, sf, "request_shards"), "custom_id", "left_anti").groupBy("custom_id").agg(F.count("*").alias("n"))


@query("f1_word_tokens", f"select doc_id, {S.words('text')} as words, len({S.words('text')}) as n from documents")
def f1_word_tokens(spark, sf):
    w = T.word_list(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", w.alias("words"), F.when(F.col("text").isNotNull(), F.size(w)).cast("long").alias("n"))


@query("f2_normalized_key", f"select pair_id, {S.key('prompt')} as prompt_key, {S.key('answer')} as answer_key from pairs")
def f2_normalized_key(spark, sf):
    return table(spark, sf, "pairs").select("pair_id", T.normalize_key(F.col("prompt")).alias("prompt_key"), T.normalize_key(F.col("answer")).alias("answer_key"))


@query("f3_ngrams8_count", f"select doc_id, len({S.grams('text', 8)}) as grams from documents where text is not null")
def f3_ngrams8_count(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(T.ngrams(T.word_list(F.col("text")), 8)).cast("long").alias("grams"))


@query("pred2_refusal_flag", f"select pair_id, {S.refusal('answer')} as refusal from pairs where answer is not null")
def pred2_refusal_flag(spark, sf):
    return table(spark, sf, "pairs").where("answer is not null").select("pair_id", T.is_refusal(F.col("answer")).alias("refusal"))


@query("pred3_overlong", f"select pair_id, len({S.space_words('answer')}) as words from pairs where len({S.space_words('answer')}) > 20")
def pred3_overlong(spark, sf):
    n = F.size(T.space_words(F.col("answer"))).cast("long")
    return table(spark, sf, "pairs").select("pair_id", n.alias("words")).where("words > 20")


@query("pred5_prompt_shape", "select pair_id, octet_length(encode(prompt)) <= 127 and regexp_full_match(prompt, '[ -\\[\\]-~]*') as ok from pairs where prompt is not null")
def pred5_prompt_shape(spark, sf):
    return table(spark, sf, "pairs").where("prompt is not null").select("pair_id", ((F.octet_length("prompt") <= 127) & F.col("prompt").rlike(r"\A[ -\[\]-~]*\z")).alias("ok"))


_HITS = f"""with suite as (
  select 'prompt' as kind, {S.key('prompt')} as k from eval_suite union select 'answer', {S.key('answer')} from eval_suite where length({S.key('answer')}) > 12
  union select 'gram', unnest({S.grams('prompt', 8)}) from eval_suite union select 'gram', unnest({S.grams('answer', 8)}) from eval_suite)
"""


@query("a15_eval_keys", _HITS + "select distinct kind, k as key from suite")
def a15_eval_keys(spark, sf):
    return C.eval_keys(table(spark, sf, "eval_suite"))


# Reformatted copies of suite items stand beside the pairs, so that there is something to find.
_WITH_COPIES = "(select cast(pair_id as varchar) as id, prompt, answer from pairs union all select 'copy-' || id, '  ' || upper(prompt) || ' !', lower(answer) || '...' from eval_suite)"


def _with_copies(spark, sf):
    suite = table(spark, sf, "eval_suite").select(F.concat(F.lit("copy-"), "id").alias("id"), F.concat(F.lit("  "), F.upper("prompt"), F.lit(" !")).alias("prompt"), F.concat(F.lower("answer"), F.lit("...")).alias("answer"))
    return table(spark, sf, "pairs").select(F.col("pair_id").cast("string").alias("id"), "prompt", "answer").unionByName(suite)


@query("j4_exact_prompt", _HITS + f"select id from {_WITH_COPIES} where {S.key('prompt')} in (select k from suite where kind = 'prompt')")
def j4_exact_prompt(spark, sf):
    keys = C.small(C.eval_keys(table(spark, sf, "eval_suite")).where("kind = 'prompt'").select("key"))
    return _with_copies(spark, sf).select("id", T.normalize_key(F.col("prompt")).alias("key")).join(keys, "key", "left_semi").select("id")


@query("j5_exact_long_answer", _HITS + f"select id from {_WITH_COPIES} where {S.key('answer')} in (select k from suite where kind = 'answer')")
def j5_exact_long_answer(spark, sf):
    keys = C.small(C.eval_keys(table(spark, sf, "eval_suite")).where("kind = 'answer'").select("key"))
    return _with_copies(spark, sf).select("id", T.normalize_key(F.col("answer")).alias("key")).join(keys, "key", "left_semi").select("id")


@query("j6_ngram8_contamination", _HITS + f"select doc_id, count(*) as shared from (select doc_id, unnest({S.grams('text', 8)}) as g from documents where text is not null) where g in (select k from suite where kind = 'gram') group by 1")
def j6_ngram8_contamination(spark, sf):
    """Runs are compared as pairs of 64-bit hashes; only documents with hits are counted."""
    suite = table(spark, sf, "eval_suite")
    keys = suite.select(F.explode(F.concat(*[T.gram_keys(T.word_list(F.coalesce(c, F.lit(""))), 8) for c in ("prompt", "answer")])).alias("k")).select("k.*").distinct()
    grams = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(T.gram_keys(T.word_list(F.col("text")), 8)).alias("k")).select("doc_id", "k.*")
    return grams.join(C.small(keys), ["a", "b"], "left_semi").groupBy("doc_id").agg(F.countDistinct("a", "b").alias("shared"))


@query(
    "j7_jaccard_prompts",
    f"""with a as (select pair_id, list_distinct({S.words('prompt')}) as ls from pairs where prompt is not null), b as (select id, list_distinct({S.words('prompt')}) as rs from auto_dev_40)
    select pair_id, id as item_id, round(len(list_intersect(ls, rs)) / (len(ls) + len(rs) - len(list_intersect(ls, rs))), 6) as jaccard from a, b
    where len(ls) > 0 and len(rs) > 0 and len(list_intersect(ls, rs)) / (len(ls) + len(rs) - len(list_intersect(ls, rs))) >= 0.8 - 1e-12""",
)
def j7_jaccard_prompts(spark, sf):
    pairs = table(spark, sf, "pairs").where("prompt is not null").select(F.col("pair_id").alias("l"), F.col("prompt").alias("text"))
    items = table(spark, sf, "auto_dev_40").select(F.col("id").alias("r"), F.col("prompt").alias("text"))
    return C.jaccard_join(pairs, items).select(F.col("l").alias("pair_id"), F.col("r").alias("item_id"), F.round("jaccard", 6).alias("jaccard"))


@query("w1_first_wins_dedup", f"select pair_id from pairs where prompt is not null and answer is not null qualify row_number() over (partition by {S.key('prompt')}, {S.key('answer')} order by created_at, pair_id) = 1")
def w1_first_wins_dedup(spark, sf):
    rows = table(spark, sf, "pairs").where("prompt is not null and answer is not null")
    return clean.first_wins(rows, [T.normalize_key(F.col("prompt")), T.normalize_key(F.col("answer"))], ["created_at", "pair_id"]).select("pair_id")


@query("w2_exact_dedup", "select pair_id from pairs qualify row_number() over (partition by prompt, answer, context order by md5(concat_ws('|', 'w2', cast(pair_id as varchar))), pair_id) = 1")
def w2_exact_dedup(spark, sf):
    rows = table(spark, sf, "pairs").withColumn("h", T.hash_order("w2", "pair_id"))
    return clean.first_wins(rows, ["prompt", "answer", "context"], ["h", "pair_id"]).select("pair_id")


@query("j13_train_minus_dev", f"select pair_id from pairs where prompt is not null and {S.key('prompt')} not in (select {S.key('prompt')} from auto_dev_40)")
def j13_train_minus_dev(spark, sf):
    dev = table(spark, sf, "auto_dev_40").select(T.normalize_key(F.col("prompt")).alias("k")).distinct()
    return table(spark, sf, "pairs").where("prompt is not null").select("pair_id", T.normalize_key(F.col("prompt")).alias("k")).join(C.small(dev), "k", "left_anti").select("pair_id")


@query("j13_train_minus_dev_pairs", f"select id from {_WITH_COPIES} where prompt is not null and answer is not null and ({S.key('prompt')}, {S.key('answer')}) not in (select ({S.key('prompt')}, {S.key('answer')}) from eval_suite)")
def j13_train_minus_dev_pairs(spark, sf):
    """The form by prompt and answer: both must be the suite's."""
    keys = [T.normalize_key(F.col(c)).alias(k) for c, k in (("prompt", "p"), ("answer", "a"))]
    dev = table(spark, sf, "eval_suite").select(*keys).distinct()
    return _with_copies(spark, sf).where("prompt is not null and answer is not null").select("id", *keys).join(C.small(dev), ["p", "a"], "left_anti").select("id")


@query("j3_context_work_list", "select pair_id from pairs p where context is not null and not exists (from pairs q where q.prompt = p.prompt and q.context = p.context and q.answer is not null and q.pair_id <> p.pair_id)")
def j3_context_work_list(spark, sf):
    """Rows that no other row with the same prompt and context answers: the least and the greatest answered id of each such pair tell it."""
    p = table(spark, sf, "pairs").where("context is not null")
    have = p.where("answer is not null and prompt is not null").groupBy("prompt", "context").agg(F.min("pair_id").alias("low"), F.max("pair_id").alias("high"))
    x = p.select("pair_id", "prompt", "context").join(have, ["prompt", "context"], "left")
    other = (F.col("low") != F.col("pair_id")) | (F.col("high") != F.col("pair_id"))
    return x.where(~F.coalesce(other, F.lit(False))).select("pair_id")


@query("j3_short_answers", "select pair_id, first_value(answer) over (partition by prompt, context order by length(answer), answer rows between unbounded preceding and unbounded following) as short from pairs where context is not null and prompt is not null and answer is not null")
def j3_short_answers(spark, sf):
    """The other side: each row's shortest answer among those with its prompt and context, found by an aggregate and joined back."""
    p = table(spark, sf, "pairs").where("context is not null and prompt is not null and answer is not null")
    best = p.groupBy("prompt", "context").agg(F.min(F.struct(F.length("answer").alias("n"), "answer")).alias("m"))
    return p.select("pair_id", "prompt", "context").join(best, ["prompt", "context"]).select("pair_id", F.col("m.answer").alias("short"))


@query("pred10_answer_in_context", f"select pair_id, contains(concat(' ', {S.key('context')}, ' '), concat(' ', {S.key('answer')}, ' ')) as supported from pairs where context is not null and answer is not null")
def pred10_answer_in_context(spark, sf):
    pad = lambda c: F.concat(F.lit(" "), T.normalize_key(F.col(c)), F.lit(" "))
    return table(spark, sf, "pairs").where("context is not null and answer is not null").select("pair_id", F.contains(pad("context"), pad("answer")).alias("supported"))


@query("f24_prompt_format", "select pair_id, case when context is null then 'Q: ' || prompt || chr(10) || 'A:' else 'C: ' || context || chr(10) || 'Q: ' || prompt || chr(10) || 'A:' end as formatted from pairs where prompt is not null")
def f24_prompt_format(spark, sf):
    ctx = F.when(F.col("context").isNotNull(), F.concat(F.lit("C: "), "context", F.lit("\n"))).otherwise(F.lit(""))
    return table(spark, sf, "pairs").where("prompt is not null").select("pair_id", F.concat(ctx, F.lit("Q: "), "prompt", F.lit("\nA:")).alias("formatted"))
