"""Round trips through the readers and writers, and the streams, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vocab
from quern.operators import packing as P
from quern.plans import sqltext as S
from quern.session import scratch, table
from quern.sources import readers, shards, writers
from quern.streaming import dialogue

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("k1_s1_jsonl_round_trip", "select pair_id, prompt, answer, category, tier from pairs")
def k1_s1_jsonl_round_trip(spark, sf):
    path = scratch(spark, "jsonl")
    df = table(spark, sf, "pairs").select("pair_id", "prompt", "answer", "category", "tier")
    writers.jsonl(df, path)
    return readers.jsonl(spark, path, df.schema)


@query("s2_strict_lines", """select id, 'unknown_id' as reason from (select cast(pair_id as varchar) as id from pairs) union all select id, 'bad_tier' from auto_dev_40 where tier is null union all select id, 'duplicate_id' from auto_dev_40 where id like '%1' union all select id, 'bad_tier' from auto_dev_40 where tier is null and id like '%1'
  union all select null, unnest(['not_an_object', 'not_an_object', 'no_id'])""")
def s2_strict_lines(spark, sf):
    """A file with good lines and all kinds of violations: no object, broken, no id, unknown and repeated ids, bad counters."""
    path = scratch(spark, "strict")
    items = table(spark, sf, "auto_dev_40")
    good = items.select("id", F.col("answer").alias("output"), F.coalesce(F.col("tier").cast("string"), F.lit("-1")).alias("tier"))
    bad = table(spark, sf, "pairs").select(F.col("pair_id").cast("string").alias("id"), F.lit("x").alias("output"), F.lit("1").alias("tier"))
    lines = good.unionByName(bad).unionByName(good.where("id like '%1'")).select(F.to_json(F.struct("id", "output", "tier")).alias("value"))
    junk = spark.createDataFrame([("[1, 2]",), ('{"id": ',), ('{"output": "x", "tier": "1"}',), ("   ",)], "value string")
    lines.unionByName(junk).write.text(path)
    return readers.strict_jsonl(spark, path, items, ["tier"])[1]


@query("k2_shards", "select (row_number() over (order by pair_id) - 1) // 1000 as shard, pair_id from pairs")
def k2_shards(spark, sf):
    """K2: shards of a thousand rows in order, read back with the number of their file."""
    path = scratch(spark, "shards")
    writers.shards(table(spark, sf, "pairs").select("pair_id", "prompt"), path, "pair_id", 1000)
    x = spark.read.parquet(path)
    return x.select(F.regexp_extract(F.col("shard").cast("string"), r"(\d+)", 1).cast("long").alias("shard"), "pair_id")


@query("k8_resume", "select pair_id, 'first' as run from pairs where loaded_at is not null union all select pair_id, 'second' from pairs where loaded_at is null")
def k8_resume(spark, sf):
    """A first run writes the loaded rows, a second is given all and appends the rest, a third finds nothing to do."""
    path, df = scratch(spark, "resume"), table(spark, sf, "pairs").select("pair_id", "loaded_at")
    for run, part in (("first", df.where("loaded_at is not null")), ("second", df), ("third", df)):
        writers.append_missing(part.select("pair_id", F.lit(run).alias("run")), path, "pair_id")
    return spark.read.parquet(path)


@query("k9_manifest", """with g as (select coalesce(category, '') as k, count(*) as rows, count(distinct prompt) as prompts, count(distinct answer) as answers from pairs group by 1),
  s as (select coalesce(category, '') as k, coalesce(tier::varchar, '') as tier, count(*) as n from pairs group by 1, 2), t as (select k, list({'tier': tier, 'n': n} order by tier) as tiers from s group by 1)
  select to_json(list({'k': g.k, 'rows': g.rows, 'prompts': g.prompts, 'answers': g.answers, 'tiers': t.tiers} order by g.k)) as manifest from g join t using (k)""")
def k9_manifest(spark, sf):
    return writers.manifest(table(spark, sf, "pairs"), "category", "tier")


@query("s5_xml_pages", "select page_id, t, r from wiki_pages where w is not null and t is not null")
def s5_xml_pages(spark, sf):
    path = scratch(spark, "xml")
    p = table(spark, sf, "wiki_pages").where("w is not null and t is not null")
    p.select(F.col("t").alias("title"), F.lit(0).alias("ns"), F.col("page_id").alias("id"), F.when(F.col("r").isNotNull(), F.struct(F.col("r").alias("_title"))).alias("redirect"), F.struct(F.col("w").alias("text")).alias("revision")).write.format("xml").option("rowTag", "page").save(path)
    return readers.xml_pages(spark, path).select("page_id", "t", "r")


def _windows(spark, sf):
    """Windows of the pairs' words as stand-in ids, with targets behind the prompt."""
    ids = lambda c: F.transform(T.word_list(F.col(c)), lambda w: F.length(w) * 31 + F.ascii(w))
    x = table(spark, sf, "pairs").where("prompt is not null and answer is not null").select("pair_id", ids("prompt").alias("p"), ids("answer").alias("a"))
    x = x.select("pair_id", F.size("p").alias("n"), F.concat("p", "a").alias("seq"))
    return x.select("pair_id", P.padded(F.col("seq"), 24).alias("ids"), P.padded(P.shifted_targets(F.col("seq"), F.col("n")), 24, -1).alias("tgt"))


_WORDS = lambda c: f"list_transform({S.words(c)}, lambda w: length(w) * 31 + ascii(w))"


@query("k3_window_faults", f"""with t as (select {_WORDS('prompt')} as p, list_concat({_WORDS('prompt')}, {_WORDS('answer')}) as ids from pairs where prompt is not null and answer is not null),
  w as (select list_resize(list_transform(ids, lambda x, k: case when k >= len(p) and k < len(ids) then ids[k + 1] else -1 end)[1:24], 24, -1) as tgt, list_resize(ids[1:24], 24, 0) as ids from t)
  select * from (select unnest(['all_masked', 'ids_range', 'targets_range']) as fault, unnest([count_if(list_max(tgt) < 0), count_if(list_max(ids) >= 500), count_if(list_max(tgt) >= 500)]) as n from w) where n > 0""")
def k3_window_faults(spark, sf):
    """Windows written as a split and checked."""
    path = scratch(spark, "windows")
    shards.write_windows(_windows(spark, sf), path, "train", 24, 500)
    return shards.window_faults(spark, path, "train", 24, 500)


@query("s10_random_windows")
def s10_random_windows(spark, sf):
    """Five hundred windows with replacement, cut behind their last target."""
    return shards.random_windows(_windows(spark, sf), "pair_id", 500, 10, trim=True)


@query("s11_keyed_lookup", "select page_id, t from wiki_pages where t in (select t from wiki_pages where page_id % 20 = 0)")
def s11_keyed_lookup(spark, sf):
    """A keyed table and what it has for some keys."""
    path, pages = scratch(spark, "keyed"), table(spark, sf, "wiki_pages")
    writers.keyed(pages.select("page_id", "t"), path, "t", 16)
    return shards.lookup(spark, path, pages.where("page_id % 20 = 0").select("t"), "t")


@query("k6_published_states", "select event_type, count(*) as n from events group by 1")
def k6_published_states(spark, sf):
    """K6: two states published one behind the other; readers see the last."""
    path, e = scratch(spark, "published"), table(spark, sf, "events")
    for df in (e.limit(0), e):
        shards.publish(df.groupBy("event_type").agg(F.count("*").alias("n")), path, "done")
    return shards.published(spark, path)


@query("f40_scored_pieces")
def f40_scored_pieces(spark, sf):
    """every document's ids by a public vocabulary of scored pieces, and the text they give back."""
    return vocab.encoded(table(spark, sf, "documents"), "doc_id", "text", vocab.from_model())


def _messages(spark, sf):
    p = table(spark, sf, "pairs").where("prompt is not null and custom_id is not null")
    return p.select(F.col("custom_id").alias("session"), F.col("pair_id").cast("long").alias("seq"), F.col("prompt").alias("text"))


@query("st2_dialogue_state")
def st2_dialogue_state(spark, sf):
    return dialogue.fold(_messages(spark, sf))


@query("st4_incremental_counts", "select event_type, cast(ts as date) as day, count(*) as n from events group by 1, 2")
def st4_incremental_counts(spark, sf):
    target, mark, src = scratch(spark, "counts"), scratch(spark, "counts-mark"), scratch(spark, "events")
    e = table(spark, sf, "events")
    e.write.parquet(src)
    dialogue.incremental_counts(spark, src, e.schema, target, mark)
    return dialogue.latest(spark, target, ["event_type", "day"])


@query("st5_event_windows", "select cast(floor(epoch_us(ts) / 600000000) * 600000000 as bigint) as start_us, event_type, count(*) as n from events group by 1, 2")
def st5_event_windows(spark, sf):
    return dialogue.windowed(table(spark, sf, "events"))


@query("m10_event_props", "select json_extract_string(props, '$.page') as page, count(*) as n from events group by 1")
def m10_event_props(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.page").alias("page")).agg(F.count("*").alias("n"))
