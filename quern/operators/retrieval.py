"""Questions against the keyed knowledge base: exact keys, one bounded expansion, ranking, statuses, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import questions as Q
from quern.functions import text as T
from quern.operators.contamination import small
from quern.session import cut

# Weights of coverage, kind of key, prominence, corrected words and the field asked for; bounds and the gap of close candidates.
W_COVER, W_KIND, W_PROM, W_TYPO, W_PRESENT, W_MISSING = 6, (8, 6, 4, -20), 1, 40, 60, 20
POOL, TOP, GAP, FIXES, ALIAS_FLOOR = 8, 3, 12, 4, 500
#: Keys and words of up to this many bytes each are broadcast; the driver holds both of them at once, some times over.
BROADCAST_BYTES = 16 << 20


def kb_words(keys: DataFrame) -> DataFrame:
    """(w, df): words of the keys and how many keys have them."""
    return keys.where("not startswith(key, '~')").select(F.explode(F.array_distinct(F.split("key", " "))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))


def like_cues(words: DataFrame) -> frozenset[str]:
    """Words of pages that are one edit from a relation's word; at most the edits of eighteen words."""
    cue = words.sparkSession.createDataFrame([(c,) for c in Q.CUE_TYPO], "c string").select("c", F.explode(T.variants(F.col("c"))).alias("v"))
    near = words.where("length(w) between 3 and 12").select("w", F.explode(T.variants(F.col("w"))).alias("v")).join(F.broadcast(cue), "v").where(T.edit1(F.col("w"), F.col("c")))
    return frozenset(r[0] for r in near.select("w").distinct().collect())


def merged(hits: DataFrame) -> DataFrame:
    """One row for each entity of a question, by the better route, and the first POOL entities in the order they came."""
    better = F.struct("cover", (-F.col("typo")).alias("t"), (-F.col("kind")).alias("k"), (-F.col("ord")).alias("o"))
    one = hits.groupBy("qid", "t").agg(F.max_by(F.struct("cover", "typo", "kind", "key", "prom", "has", "lacks"), better).alias("x"), F.min(F.struct("ord", "rank")).alias("came"))
    first = Window.partitionBy("qid").orderBy("came", "t")
    return one.withColumn("n", F.row_number().over(first)).where(F.col("n") <= POOL).select("qid", "t", "x.*", "n")


def decided(pool: DataFrame, questions: DataFrame, aliases: bool = False) -> DataFrame:
    """(qid, t, relation, key, cover, typo, s1, s2, decision): the best of the TOP by entity score, once the field asked for counts too.

    ambiguous: the next one covers as much and is within GAP; with aliases also what is below the confidence floor.
    """
    x = pool.join(questions.select("qid", "total", "relation"), "qid").where("2 * cover > total")
    kind = F.coalesce(*[F.when(F.col("kind") == k, w) for k, w in enumerate(W_KIND)], F.lit(W_KIND[-1]))
    s1 = W_COVER * F.floor(100 * F.col("cover") / F.col("total")) + kind + W_PROM * F.col("prom") - W_TYPO * F.col("typo")
    x = x.withColumn("s1", s1.cast("int")).withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("s1").desc(), "n"))).where(F.col("r") <= TOP)
    field = F.when(F.array_contains("has", F.col("relation")), W_PRESENT).when(F.array_contains("lacks", F.col("relation")), W_MISSING).otherwise(0)
    x = x.withColumn("s2", F.col("s1") + field)
    w = Window.partitionBy("qid").orderBy(F.col("s2").desc(), "n")
    close = (F.lead("cover").over(w) == F.col("cover")) & (F.col("s2") - F.lead("s2").over(w) <= GAP)
    x = x.withColumn("close", F.coalesce(close, F.lit(False))).withColumn("r", F.row_number().over(w)).where("r = 1")
    floor = ((F.col("cover") < F.col("total")) | (F.col("s1") < ALIAS_FLOOR)) if aliases else F.lit(False)
    return x.select("qid", "t", "relation", "key", "cover", "typo", "s1", "s2", F.when(F.col("close") | floor, "ambiguous").otherwise("ok").alias("decision"))


def alias_keys(candidates: DataFrame) -> DataFrame:
    """Further keys of entities: their titles' words in any order. Beside a title's own key they don't count."""
    stop = F.array(*map(F.lit, sorted(Q.ENT_STOP)))
    words = F.filter(F.split("key", " "), lambda w: ~F.array_contains(stop, w))
    own = candidates.where("kind <= 2").withColumn("key", F.concat(F.lit("~"), F.array_join(F.array_sort(words), " "))).where("key <> '~'")
    w = Window.partitionBy("key").orderBy(F.col("prom").desc(), "t")
    return own.dropDuplicates(["key", "t"]).withColumn("kind", F.lit(2)).withColumn("rank", F.row_number().over(w)).where("rank <= 4").select(*candidates.columns)


def retrieved(questions: DataFrame, candidates: DataFrame, fields: DataFrame, routed: bool = False, expand: bool = True, aliases: bool = False) -> DataFrame:
    """(qid, status, reason, relation, title, key, value, context) of questions (qid, question).

    candidates (key, rank, t, kind, prom), fields (t, rel, value, missing). Statuses: gated (with the
    reason), no_match, ambiguous, field_missing, corrupt_kb (a date that can't be one), answer_present. J11: at most
    MAX_KEYS exact keys, best coverage first, up to the first that covers all; R6: then one expansion by keys with one
    or two words put right, of unresolved questions only. Null questions are gated.
    """
    if aliases:
        candidates = candidates.unionByName(alias_keys(candidates))
    words = cut(kb_words(candidates), "words")
    known = like_cues(words)
    # Written, since each of the many uses below would run Python over all questions and put its plan into this one again.
    q = cut(questions.select("qid", Q.asked_udf(known, routed, aliases)("question").alias("a")).select("qid", "a.*"), "asked")
    has = fields.groupBy("t").agg(F.collect_set(F.when(~F.col("missing"), F.col("rel"))).alias("has"), F.collect_set(F.when(F.col("missing"), F.col("rel"))).alias("lacks"))
    base = candidates.join(has, "t", "left")
    none = F.array().cast("array<string>")
    base = small(cut(base.withColumn("has", F.coalesce("has", none)).withColumn("lacks", F.coalesce("lacks", none)), "base"), BROADCAST_BYTES)
    tried = q.where("gate is null").select("qid", "total", F.explode("keys").alias("k")).select("qid", "total", "k.*", F.lit(0).alias("typo"))
    hits = tried.join(base, "key")
    full = Window.partitionBy("qid")
    stop = F.min(F.when(F.col("cover") == F.col("total"), F.col("ord"))).over(full)
    hits = hits.withColumn("stop", stop).where("stop is null or ord <= stop")
    if aliases:  # the side index counts only where no title was met by the same words
        title = F.max((F.col("kind") == 0) & ~F.startswith("key", F.lit("~")) & (F.col("cover") == F.col("total"))).over(full)
        hits = hits.withColumn("title", title).where("not title or not startswith(key, '~')")
    cols = ["qid", "key", "cover", "typo", "ord", "rank", "t", "kind", "prom", "has", "lacks"]
    hits = hits.select(*cols)
    if expand:
        hits = cut(hits, "hits")
        solved = hits.join(q.select("qid", "total"), "qid").where("cover = total").select("qid").distinct()
        open_ = q.where("gate is null and total > 0").join(solved, "qid", "left_anti")
        word = open_.select("qid", F.explode(F.filter(F.transform(F.arrays_zip("words", "flags"), lambda x: F.when((x["flags"] == 1) & (F.length(x["words"]) >= Q.CONTENT_MIN), x["words"])), lambda x: x.isNotNull())).alias("w")).distinct()
        asked_words = word.select("w").distinct().join(words.select("w"), "w", "left_anti")  # words that no key has
        near = asked_words.select("w", F.explode(T.variants(F.col("w"))).alias("v")).join(small(words.where("length(w) >= 3").select(F.col("w").alias("to"), "df", F.explode(T.variants(F.col("w"))).alias("v")), BROADCAST_BYTES), "v")
        near = near.select("w", "to", "df").distinct().where(T.edit1(F.col("w"), F.col("to")))
        best = near.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy(F.col("df").desc(), "to"))).where(F.col("r") <= FIXES)
        fixes = best.groupBy("w").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "to"))), lambda x: x["to"]).alias("to"))
        of = word.join(fixes, "w").groupBy("qid").agg(F.collect_list(F.struct("w", "to")).alias("fixes"))
        more = open_.join(of, "qid").select("qid", F.explode(Q.fixed_keys_udf("words", "flags", "fixes")).alias("k")).select("qid", "k.*")
        cue = open_.where("cue_entity").select("qid", F.explode("keys").alias("k")).select("qid", "k.key", "k.cover", F.lit(0).alias("typo"), "k.ord")
        hits = hits.unionByName(more.unionByName(cue).join(base, "key").select(*cols))
    best = decided(merged(hits), q, aliases).join(fields.withColumnRenamed("rel", "relation"), ["t", "relation"], "left")
    best = with_sentence(best, "relation").drop("relation")
    x = q.select("qid", "gate", "relation").join(best, "qid", "left")
    context = F.col("sentence")
    status = (
        F.when(F.col("gate").isNotNull(), "gated").when(F.col("t").isNull(), "no_match").when(F.col("decision") == "ambiguous", "ambiguous")
        .when(F.col("value").isNull() | F.col("missing"), "field_missing").when(context.isNull(), "corrupt_kb").otherwise("answer_present")
    )
    reason = F.coalesce("gate", F.when(F.col("t").isNull(), "no_candidate").when(F.col("decision") == "ambiguous", "close_candidates").when(F.col("value").isNull(), "field_not_applicable").when(F.col("missing"), "field_marked_missing"))
    answered = status == "answer_present"
    return x.select("qid", status.alias("status"), reason.alias("reason"), "relation", F.col("t").alias("title"), "key", F.when(answered, F.col("value")).alias("value"), F.when(answered, context).alias("context"))


def with_sentence(df: DataFrame, rel: str) -> DataFrame:
    """df (t, rel, value) with a sentence for the value of each of the relations; null for a date that can't be one."""
    value, r = F.col("value"), F.col(rel)
    good = lambda d: F.when(d.rlike(r"^-?\d{1,4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?$"), T.date_said(d))
    dated = r.isin("birth_date", "death_date", "date_range")
    first, last = F.split_part(value, F.lit("/"), F.lit(1)), F.when(F.contains(value, F.lit("/")), F.split_part(value, F.lit("/"), F.lit(2)))
    df = df.withColumns({"_t": F.regexp_replace("t", r" \([^()]*\)$", ""), "_from": F.when(dated, good(first)), "_to": F.when(dated, good(last))})
    t, say = F.col("_t"), lambda before, v, after=".": F.concat("_t", F.lit(before), v, F.lit(after))
    bare = lambda c: F.regexp_replace(c, "^(?:on|in) ", "")
    span = F.when(first == "", say(" ended ", F.col("_to"))).when(last.isNull(), say(" was ", F.col("_from"))).otherwise(F.concat(t, F.lit(" was from "), bare("_from"), F.lit(" to "), bare("_to"), F.lit(".")))
    article = F.when(F.lower(F.substring(value, 1, 1)).isin(*"aeiou"), " was an ").otherwise(" was a ")
    # The sentences.
    forms = {
        "definition": value, "birth_date": say(" was born ", F.col("_from")), "death_date": say(" died ", F.col("_from")), "birth_place": say(" was born in ", value), "death_place": say(" died in ", value), "location": say(" is in ", value),
        "surname": F.concat(F.lit("The last name of "), t, F.lit(" is "), value, F.lit(".")), "capital": F.concat(F.lit("The capital of "), t, F.lit(" is "), value, F.lit(".")), "occupation": F.concat(t, article, value, F.lit(".")),
        "creator": say(" was created by ", value), "height": say(" is ", value, " tall."), "length": say(" is ", value, " long."), "quantity": say(" has a population of ", value), "date_range": span,
    }
    return df.withColumn("sentence", F.coalesce(*[F.when(r == k, c) for k, c in forms.items()])).drop("_t", "_from", "_to")
