"""Wiki pages to a keyed knowledge base, fuzzy words, lookup, routing, arithmetic, text operations, dialogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import calc, entity, questions as Q, text as T, wiki
from quern.operators import retrieval
from quern.operators.contamination import small
from quern.operators.numbering import numbered
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


def _pages(spark, sf) -> DataFrame:
    return table(spark, sf, "wiki_pages")


def entities(pages: DataFrame) -> DataFrame:
    """Articles (no redirects, disambiguations or lists) with lead, infobox, dates, kind and typed fields.

    A country without a capital gets the one that another page's lead names, the first in the order of pages.
    """
    a = pages.where("r is null and w is not null and t is not null and not lower(t) like '%(disambiguation)%' and not lower(t) like 'list of%'")
    x = a.select(
        "page_id", "t", F.coalesce("n", F.lit(0).cast("long")).alias("n"), wiki.udf("lead")("w").alias("lead"), wiki.udf("infobox")("w").alias("fields"), wiki.udf("scan_dates")(wiki.udf("clean_line")(wiki.udf("strip_markup")("w"))).alias("dates"),
        entity.extract_udf("t", "w").alias("e"), wiki.udf("fold")("t").alias("name"),
    )
    x = cut(x.withColumn("prom", T.prominence(F.col("n"))), "entities")  # Python reads every page once
    said = x.where("e.capital_of is not null").groupBy(F.col("e.capital_of").alias("name")).agg(F.min_by("e.capital", "page_id").alias("said"))
    x = x.join(said, "name", "left")
    own = F.map_keys("e.typed")
    typed = F.when((F.col("e.etype") == "country") & F.col("said").isNotNull() & ~F.array_contains(own, "capital"), F.map_concat("e.typed", F.create_map(F.lit("capital"), F.struct(F.col("said").alias("value"), F.lit("reverse").alias("prov"))))).otherwise(F.col("e.typed"))
    return x.select("page_id", "t", "n", "lead", "fields", "dates", "prom", F.col("e.etype").alias("etype"), typed.alias("typed"))


# The relations that an entity of each kind should have a value for.
FITS = {"person": ["birth_date", "death_date", "birth_place", "death_place", "occupation", "surname"], "event": ["date_range", "location"], "country": ["capital", "location", "quantity"], "place": ["location", "quantity"], "other": []}


def entity_fields(x: DataFrame) -> DataFrame:
    """(t, rel, value, prov, missing): typed fields and the definition, and markers where a fitting field has no value."""
    lead = x.where("lead is not null").select("t", F.lit("definition").alias("rel"), wiki.udf("context_sentence")("lead").alias("value"), F.lit("lead_text").alias("prov"), F.lit(False).alias("missing"))
    have = x.select("t", F.explode("typed").alias("rel", "v")).select("t", "rel", "v.value", "v.prov", F.lit(False).alias("missing"))
    fits = F.coalesce(*[F.when(F.col("etype") == k, F.array(*map(F.lit, v)).cast("array<string>")) for k, v in FITS.items()])
    none = x.select("t", F.explode(F.array_except(fits, F.map_keys("typed"))).alias("rel")).select("t", "rel", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("prov"), F.lit(True).alias("missing"))
    return lead.unionByName(have).unionByName(none).dropDuplicates(["t", "rel"])


def key_candidates(pages: DataFrame, x: DataFrame | None = None) -> DataFrame:
    """(key, rank, t, kind, prom): titles' keys and redirects (two steps) to articles; four best for each key.

    Of two articles with the same title the more prominent one counts. x: the pages' entities, if at hand.
    """
    art = pages.where("r is null and w is not null and t is not null").groupBy("t").agg(F.max(T.prominence(F.coalesce("n", F.lit(0).cast("long")))).alias("prom"))
    etypes = x.groupBy("t").agg(F.min("etype").alias("etype")) if x is not None else None
    art = art.join(etypes, "t", "left") if etypes is not None else art.withColumn("etype", F.lit("other"))
    own = art.select("t", "prom", F.explode(wiki.keys_udf("t", F.coalesce("etype", F.lit("other")), "prom")).alias("k")).select("t", "prom", "k.key", "k.kind")
    red = pages.where("r is not null and t is not null").select(F.col("t").alias("alias"), F.col("r").alias("target")).distinct()
    second = red.select(F.col("alias").alias("target"), F.col("target").alias("target2"))
    hop = red.join(second, "target", "left").select("alias", F.coalesce("target2", "target").alias("t"))
    more = hop.join(art, "t").select("t", "prom", wiki.udf("fold")("alias").alias("key"), F.lit(wiki.REDIRECT).alias("kind")).where("key <> ''")
    best = own.unionByName(more).groupBy("key", "t").agg(F.min("kind").alias("kind"), F.max("prom").alias("prom"))
    w = Window.partitionBy("key").orderBy("kind", F.col("prom").desc(), "t")
    return best.withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("key", "rank", "t", "kind", "prom")


@query("s6_articles", "select page_id, t, coalesce(n, 0) as n, least(63, cast(floor(4 * log2(1 + coalesce(n, 0) / 32)) as int)) as prom from wiki_pages where r is null and w is not null and not lower(t) like '%(disambiguation)%' and not lower(t) like 'list of%'")
def s6_articles(spark, sf):
    return entities(_pages(spark, sf)).select("page_id", "t", "n", "prom")


@query("c6_entities")
def c6_entities(spark, sf):
    return entities(_pages(spark, sf))


@query("k5_entity_audit")
def k5_entity_audit(spark, sf):
    """Fields with provenance and markers by kind of entity."""
    x = entities(_pages(spark, sf))
    f = entity_fields(x).join(x.select("t", "etype").dropDuplicates(["t"]), "t")
    return f.groupBy("etype", "rel").agg(F.count("*").alias("entities"), F.count_if("missing").alias("missing"), F.count_if(F.col("prov") == "infobox").alias("infobox"), F.count_if(F.col("prov") == "lead_text").alias("lead_text"), F.count_if(F.col("prov") == "title").alias("title"))


@query("w3_key_candidates")
def w3_key_candidates(spark, sf):
    return key_candidates(_pages(spark, sf))


@query("j9_redirects", "select a.t as alias, coalesce(b.r, a.r) as target, exists (from wiki_pages p where p.t = coalesce(b.r, a.r) and p.r is null) as found from wiki_pages a left join wiki_pages b on b.t = a.r and b.r is not null where a.r is not null")
def j9_redirects(spark, sf):
    p = _pages(spark, sf)
    a, b = p.where("r is not null").select(F.col("t").alias("alias"), "r"), p.where("r is not null").select(F.col("t").alias("r"), F.col("r").alias("r2"))
    x = a.join(b, "r", "left").select("alias", F.coalesce("r2", "r").alias("target"))
    art = p.where("r is null").select(F.col("t").alias("target"), F.lit(True).alias("x")).distinct()
    return x.join(art, "target", "left").select("alias", "target", F.col("x").isNotNull().alias("found"))


@query("w6_entity_numbers", "select row_number() over (order by coalesce(n, 0) desc, t, page_id) - 1 as eid, t from wiki_pages where r is null and w is not null")
def w6_entity_numbers(spark, sf):
    """Dense ids in a total order, without one task for all rows."""
    x = _pages(spark, sf).where("r is null and w is not null").select(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "t", "page_id")
    return numbered(x, [], [F.col("n").desc(), "t", "page_id"], "eid").select((F.col("eid") - 1).alias("eid"), "t")


@query("a7_document_frequency", f"select w as word, count(*) as df from (select unnest(list_distinct({S.words('text')})) as w from documents where text is not null) where length(w) >= 3 and not regexp_matches(w, '[0-9]') group by 1 having count(*) >= 3")
def a7_document_frequency(spark, sf):
    w = table(spark, sf, "documents").where("text is not null").select(F.explode(T.word_set(F.col("text"))).alias("word"))
    return w.where((F.length("word") >= 3) & ~F.col("word").rlike("[0-9]")).groupBy("word").agg(F.count("*").alias("df")).where("df >= 3")


@query("a8_lead_coverage")
def a8_lead_coverage(spark, sf):
    e = entities(_pages(spark, sf))
    return e.agg(F.count("*").alias("entities"), F.count("lead").alias("leads"), F.count_if(F.size("fields") > 0).alias("infoboxes"), F.count_if(F.size("dates") > 0).alias("dated"))


@query("a20_field_masks", "select source, bit_or(cast(1 as int) << case category when 'python' then 0 when 'bugfix' then 1 when 'calc' then 2 when 'shell' then 3 when 'transform' then 4 when 'factual' then 5 else 6 end) as mask from pairs group by 1")
def a20_field_masks(spark, sf):
    code = F.coalesce(*[F.when(F.col("category") == c, F.lit(i)) for i, c in enumerate(("python", "bugfix", "calc", "shell", "transform", "factual"))], F.lit(6))
    return table(spark, sf, "pairs").groupBy("source").agg(F.bit_or(F.pow(F.lit(2), code).cast("int")).alias("mask"))


_DF = f"select w, count(*) as df from (select unnest(list_distinct({S.words('prompt')})) as w from pairs where prompt is not null) where length(w) >= 5 and not regexp_matches(w, '[0-9]') group by 1"
_CUTS = "list_distinct(list_concat([{w}], list_transform(range(1, length({w}) + 1), lambda i: substr({w}, 1, i - 1) || substr({w}, i + 1))))"


@query("j12_delete1_fuzzy", f"""with known as (select w, df from ({_DF}) where df >= 20), rare as (select w from ({_DF}) where df <= 2),
  kv as (select w as word, df, unnest({_CUTS.format(w='w')}) as v from known), rv as (select w as rare, unnest({_CUTS.format(w='w')}) as v from rare),
  c as (select distinct rare, word, df from rv join kv using (v) where rare <> word)
  select rare, word from c where damerau_levenshtein(rare, word) = 1 qualify row_number() over (partition by rare order by df desc, word) <= 4""")
def j12_delete1_fuzzy(spark, sf):
    """Rare words to frequent ones one edit away: an equi-join on delete-1 variants, then verified; never all pairs."""
    w = table(spark, sf, "pairs").where("prompt is not null").select(F.explode(T.word_set(F.col("prompt"))).alias("w")).where((F.length("w") >= 5) & ~F.col("w").rlike("[0-9]"))
    df = w.groupBy("w").agg(F.count("*").alias("df"))
    known = df.where("df >= 20").select(F.col("w").alias("word"), "df", F.explode(T.variants(F.col("w"))).alias("v"))
    rare = df.where("df <= 2").select(F.col("w").alias("rare"), F.explode(T.variants(F.col("w"))).alias("v"))
    c = rare.join(small(known), "v").where("rare <> word").select("rare", "word", "df").distinct().where(T.edit1(F.col("rare"), F.col("word")))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy("rare").orderBy(F.col("df").desc(), "word"))).where("rn <= 4").select("rare", "word")


@query("f15_variants", f"select id, list_sort({_CUTS.format(w='id')}) as vs from auto_dev_40")
def f15_variants(spark, sf):
    return table(spark, sf, "auto_dev_40").select("id", F.array_sort(T.variants(F.col("id"))).alias("vs"))


@query("f16_fnv1a", "select id, list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split(id, ''), lambda c: ascii(c)::ubigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::bigint as h from auto_dev_40")
def f16_fnv1a(spark, sf):
    return table(spark, sf, "auto_dev_40").select("id", T.fnv1a(F.col("id")).alias("h"))


def _asked(spark, sf) -> DataFrame:
    """Factual questions of the pairs, and a question about each title."""
    asked = table(spark, sf, "pairs").where("category = 'factual' and prompt is not null").select(F.col("pair_id").alias("qid"), F.col("prompt").alias("question"))
    return asked.unionByName(_pages(spark, sf).where("t is not null").select((-F.col("page_id")).alias("qid"), F.concat(F.lit("what is "), "t").alias("question")))


@query("r5_retrieval")
def r5_retrieval(spark, sf):
    """Every question with its status, entity, field and answer."""
    pages = _pages(spark, sf)
    x = entities(pages)
    return retrieval.retrieved(_asked(spark, sf), cut(key_candidates(pages, x), "keys"), entity_fields(x).drop("prov"))


@query("r8_alias_retrieval")
def r8_alias_retrieval(spark, sf):
    """The same with keys for words in any order and a confidence floor."""
    pages = _pages(spark, sf)
    x = entities(pages)
    return retrieval.retrieved(_asked(spark, sf), cut(key_candidates(pages, x), "keys"), entity_fields(x).drop("prov"), aliases=True)


@query("a8_status_counts")
def a8_status_counts(spark, sf):
    return QUERIES["r5_retrieval"](spark, sf).groupBy("status", "reason").agg(F.count("*").alias("questions"))


@query("pred7_kb_gate")
def pred7_kb_gate(spark, sf):
    """The gate's reason, and what the first release's gate says."""
    v0 = F.udf(Q.v0_gate, "boolean")
    p = table(spark, sf, "pairs").where("prompt is not null").select("pair_id", "prompt")
    return p.select("pair_id", Q.asked_udf()("prompt")["gate"].alias("reason"), v0("prompt").alias("v0"))


@query("r7_first_hit")
def r7_first_hit(spark, sf):
    """The longest run of words that is a key and holds the majority of the question's words; the first of them."""
    q = _asked(spark, sf).select("qid", F.explode(Q.asked_udf(routed=True)("question")["keys"]).alias("k")).select("qid", "k.key", F.size(F.split("k.key", " ")).alias("n"), "k.ord")
    best = q.join(small(key_candidates(_pages(spark, sf)).where("rank = 1").select("key", "t")), "key")
    return best.groupBy("qid").agg(F.max_by(F.struct("key", "t"), F.struct("n", -F.col("ord"))).alias("x")).select("qid", "x.key", "x.t")


# The words by which a question is routed.
SHELL_WORDS = ["rm", "chmod", "folder", "files", "file", "copy", "rename", "job", "log"]
PYTHON_WORDS = ["list", "dict", "tuple", "function", "items", "sort", "append", "python", "values", "strings"]
CUES = ["what", "who", "where", "when", "which", "why", "how"]


@query("r1_route", f"""with t as (select pair_id, {S.words('prompt')} as w, lower(prompt) as p from pairs where prompt is not null)
  select pair_id, case when len(w) = 0 or not regexp_matches(p, '[aeiouy0-9]') then 'unknown' when regexp_matches(p, '[0-9] *(?:[-+*/]|plus|times|minus|percent of) *[0-9]') then 'calc'
    when list_has_any(w, {SHELL_WORDS}) then 'shell' when list_has_any(w, {PYTHON_WORDS}) or regexp_matches(p, '[a-z]+_[a-z]+') then 'python'
    when regexp_matches(p, '^(?:uppercase|spell|repeat|echo|say|first word|last word)') then 'text' when list_has_any(w, ['and', 'then', 'also']) and len(w) <= 3 then 'clarify' else 'facts' end as handler from t""")
def r1_route(spark, sf):
    w, p = F.col("w"), F.col("p")
    x = table(spark, sf, "pairs").where("prompt is not null").select("pair_id", T.word_list(F.col("prompt")).alias("w"), F.lower("prompt").alias("p"))
    handler = (
        F.when((F.size(w) == 0) | ~p.rlike("[aeiouy0-9]"), "unknown").when(p.rlike("[0-9] *(?:[-+*/]|plus|times|minus|percent of) *[0-9]"), "calc").when(T.any_of(w, SHELL_WORDS), "shell")
        .when(T.any_of(w, PYTHON_WORDS) | p.rlike("[a-z]+_[a-z]+"), "python").when(p.rlike("^(?:uppercase|spell|repeat|echo|say|first word|last word)"), "text")
        .when(T.any_of(w, ["and", "then", "also"]) & (F.size(w) <= 3), "clarify").otherwise("facts")
    )
    return x.select("pair_id", handler.alias("handler"))


@query("pred6_context_gate")
def pred6_context_gate(spark, sf):
    """Question word first, no code, no quotes but contractions, no arithmetic in digits or words."""
    wants = F.pandas_udf(lambda s: s.map(Q.wants_context, na_action="ignore").astype(object), "boolean")
    return table(spark, sf, "pairs").where("prompt is not null").select("pair_id", wants("prompt").alias("wants"))


@query("m1_calc")
def m1_calc(spark, sf):
    return table(spark, sf, "pairs").where("answer like 'calc(%'").select("pair_id", "answer", calc.calc_udf()("answer").alias("value"))


_NUM = r"-?\d+(?:\.\d+)?"
_ASKED = f"lower(rtrim({S.strip('prompt')}, '?.! '))"
_PAREN = lambda x: f"case when starts_with({x}, '-') then '(' || {x} || ')' else {x} end"
_EXPR = "case " + " ".join(
    f"when regexp_full_match(q, '{p.replace(chr(39), chr(39) * 2).format(n=_NUM)}') then {_PAREN(f'ns[{i}]')} || '{op}' || {_PAREN(f'ns[{j}]')}"
    for p, op, i, j in [
        *[(rf"(?:what is |what's |whats |how much is )?{{n}} (?:{w}) {{n}}", op, 1, 2) for w, op in ((r"plus|\+", "+"), ("minus|-", "-"), (r"times|\*|x", "*"), ("divided by|/", "/"))],
        ("add {n} and {n}", "+", 1, 2), ("multiply {n} by {n}", "*", 1, 2), ("divide {n} by {n}", "/", 1, 2), ("subtract {n} from {n}", "-", 2, 1),
    ]
) + " end"


@query("f38_extract_expr", f"select pair_id, {_EXPR} as expr from (select pair_id, {_ASKED} as q, regexp_extract_all({_ASKED}, '(?:^|[^0-9.])(-?[0-9]+(?:[.][0-9]+)?)', 1) as ns from pairs where prompt is not null)")
def f38_extract_expr(spark, sf):
    return table(spark, sf, "pairs").where("prompt is not null").select("pair_id", calc.expr_udf()("prompt").alias("expr"))


@query("f38_spoken_expr")
def f38_spoken_expr(spark, sf):
    """The same with numbers in words, and what it comes to."""
    x = table(spark, sf, "pairs").where("prompt is not null").select("pair_id", calc.spoken_udf()("prompt").alias("expr")).where("expr is not null")
    return x.select("pair_id", "expr", calc.calc_udf()(F.concat(F.lit("calc("), "expr", F.lit(")"))).alias("value"))


@query("m2_series", "select 'plot x*x-3 from -5 to 5 with 11 points' as request, (k)::varchar as x, (k * k - 3)::varchar as y from (select unnest(range(-5, 6)) as k) union all select 'table of 2*x+1 for x from 0 to 3', k::varchar, (2 * k + 1)::varchar from (select unnest(range(4)) as k) union all select 'bars for 3, 4', k::varchar, (k + 2)::varchar from (select unnest([1, 2]) as k)")
def m2_series(spark, sf):
    """One request to a row for each x: a table function over the rows of a small parameter table."""
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    f = F.udf(calc.series, ArrayType(StructType([StructField("x", StringType()), StructField("y", StringType())])))
    t = spark.createDataFrame([("plot x*x-3 from -5 to 5 with 11 points",), ("table of 2*x+1 for x from 0 to 3",), ("bars for 3, 4",), ("plot the trees",)], "request string")
    return t.select("request", F.explode(f("request")).alias("p")).select("request", "p.x", "p.y")


_TITLE = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c, i: case when i > 1 and regexp_matches(string_split({x}, '')[i - 1], '[A-Za-z]') then lower(c) else upper(c) end), '')"
_W = f"string_split(trim(regexp_replace(prompt, {S.q(f'[{S.SPACE}]+')}, ' ', 'g')), ' ')"
_L = "regexp_replace(lower(prompt), '[^a-z0-9]', '', 'g')"


@query("f30_text_operations", f"""select pair_id, upper(prompt) as op_upper, lower(prompt) as op_lower, {_TITLE('prompt')} as op_title, upper(substr(prompt, 1, 1)) || lower(substr(prompt, 2)) as op_capitalize, reverse(prompt) as op_reverse,
  array_to_string(list_reverse({_W}), ' ') as op_reverse_words, length(regexp_replace(prompt, '[^A-Za-z]', '', 'g')) as op_count_letters, length(prompt) as op_count_chars,
  length(regexp_replace(prompt, {S.q(f'[{S.SPACE}]')}, '', 'g')) as op_count_chars_nospace, len(list_filter({_W}, lambda w: w <> '')) as op_count_words, length(regexp_replace(lower(prompt), '[^aeiou]', '', 'g')) as op_count_vowels,
  replace(prompt, ' ', '') as op_remove_spaces, array_to_string([prompt, prompt, prompt], ' ') as op_repeat, replace(prompt, 'the', 'a') as op_replace,
  array_to_string(list_transform(list_filter({_W}, lambda w: w <> ''), lambda w: upper(substr(w, 1, 1)) || '.'), ' ') as op_initials, upper(array_to_string(list_transform({_W}, lambda w: substr(w, 1, 1)), '')) as op_acronym,
  array_to_string(list_sort({_W}), ' ') as op_sort_words, {_W}[1] as op_first_word, {_W}[-1] as op_last_word, {_L} = reverse({_L}) as op_palindrome,
  array_to_string(list_filter(string_split(regexp_replace(prompt, {S.q(f'[{S.SPACE}]')}, '', 'g'), ''), lambda x: x <> ''), '-') as op_spell
  from pairs where category = 'transform' and prompt is not null and regexp_full_match(prompt, '[ -~]*')""")
def f30_text_operations(spark, sf):
    x = table(spark, sf, "pairs").where("category = 'transform' and prompt is not null").where(F.col("prompt").rlike(r"\A[ -~]*\z"))
    ops = T.text_operations(F.col("prompt"))
    return x.select("pair_id", *[c.alias(n) for n, c in ops.items()])


@query("f28_title_style", f"select id, {_TITLE('answer')} as title from eval_suite where regexp_full_match(answer, '[ -~]*') union all select id, answer from eval_suite where answer is null")
def f28_title_style(spark, sf):
    return table(spark, sf, "eval_suite").where(F.col("answer").isNull() | F.col("answer").rlike(r"\A[ -~]*\z")).select("id", T.title_style(F.col("answer")).alias("title"))


@query("f7_sentences")
def f7_sentences(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(wiki.udf("sentences")(wiki.udf("clean_line")(wiki.udf("strip_markup")("text")))).alias("sentence"))


@query("f8_context_sentence")
def f8_context_sentence(spark, sf):
    return entities(_pages(spark, sf)).where("lead is not null").select("t", wiki.udf("context_sentence")("lead").alias("context"))


@query("f14_edit1_ids", "select a.id as a, b.id as b from auto_dev_40 a, auto_dev_40 b where a.id < b.id and damerau_levenshtein(a.id, b.id) = 1")
def f14_edit1_ids(spark, sf):
    """ids one edit apart, by delete-1 variants."""
    ids = table(spark, sf, "auto_dev_40").select("id", F.explode(T.variants(F.col("id"))).alias("v"))
    a, b = ids.toDF("a", "v"), ids.toDF("b", "v")
    return a.join(b, "v").where("a < b").select("a", "b").distinct().where(T.edit1(F.col("a"), F.col("b")))
