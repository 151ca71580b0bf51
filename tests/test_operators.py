import itertools
import random

from pyspark.sql import functions as F

from quern.operators import clean, contamination, packing
from quern.operators.numbering import numbered
from quern.session import scratch
from quern.sources import readers, writers
from quern.streaming import dialogue


def test_jaccard_join_like_brute_force(spark):
    rnd = random.Random(1)
    left = [(str(i), " ".join(rnd.sample("a b c d e f g h".split(), rnd.randint(0, 6)))) for i in range(80)]
    right = [(str(i), " ".join(rnd.sample("a b c d e f g h".split(), rnd.randint(0, 6)))) for i in range(30)]
    for t in (0.5, 0.8):
        got = {(r.l, r.r) for r in contamination.jaccard_join(spark.createDataFrame(left, "l string, text string"), spark.createDataFrame(right, "r string, text string"), t).collect()}
        want = {(a, b) for (a, x), (b, y) in itertools.product(left, right) if x and y and len(set(x.split()) & set(y.split())) >= t * len(set(x.split()) | set(y.split())) - 1e-12}
        assert got == want
        got = {(r.l, r.r) for r in contamination.jaccard_join(spark.createDataFrame(left, "l string, text string"), spark.createDataFrame(right, "r string, text string"), t, limit=0).collect()}
        assert got == want


def test_numbers_of_groups(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randint(0, 9), i) for i in range(300)]
    want, sizes = {}, {}
    for g, k, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[i] = sizes[g] = sizes.get(g, 0) + 1
    df = spark.createDataFrame(rows, "g string, k int, i int")
    got = numbered(df, ["g"], ["k", "i"], "rn", "n").collect()
    assert {r.i: r.rn for r in got} == want and all(r.n == sizes[r.g] for r in got) and len(got) == 300
    assert sorted(r.rn for r in numbered(df, [], [F.col("i").desc()]).collect()) == list(range(1, 301)) and numbered(df.limit(0), ["g"], ["k"]).count() == 0


def test_first_of_each_key(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), (None, 5, 3), (None, 5, 4), ("b", 0, 5)], "k string, t int, id int")
    assert sorted(r.id for r in clean.first_wins(df, ["k"], ["t", "id"]).collect()) == [2, 3, 5]


def test_cascade_order(spark):
    req = spark.createDataFrame([("c1", "python", [(0, "ok one", 1), (1, "what is the long known prompt", 1), (2, "z", 1), (3, "ok one", 1)], 1)], "custom_id string, category string, items array<struct<i:int,prompt:string,tier:int>>, submitted_at int")
    text = '{"i": 0, "answer": "fine"}\n`{"i": 1, "answer": "x"}`\njunk\n{"i": 2, "answer": "  "}\n{"i": 3, "answer": "Fine!"}'
    res = spark.createDataFrame([("c1", ("succeeded", ([("text", text)],)), 1), ("c9", ("succeeded", None), 2), ("c1", ("errored", None), 3)], "custom_id string, result struct<type:string,message:struct<content:array<struct<type:string,text:string>>>>, received_at int")
    suite = spark.createDataFrame([("e", "What is the long, known prompt?", "a")], "id string, prompt string, answer string")
    got = sorted((r.received_at, r.i if r.i is not None else -1, r.drop_reason) for r in clean.drop_reasons(clean.candidate_items(req, res), suite).collect())
    assert got == [(1, 0, None), (1, 1, "contamination_exact_prompt"), (1, 2, "empty_answer"), (1, 3, "duplicate"), (2, -1, "no_matching_request"), *[(3, i, "batch_errored") for i in range(4)]]


def test_running_sum_in_blocks(spark):
    df = spark.createDataFrame([(i * 7, i % 5) for i in range(500)], "k long, n long")
    got = [r.s for r in packing.running(df, "k", "n", "s", block=64).orderBy("k").collect()]
    assert got == [sum(j % 5 for j in range(i)) for i in range(500)]


def test_windows_and_paragraphs(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, [4, 5, 6, 7])], "k long, ids array<int>")
    assert [r.ids for r in packing.stream_windows(df, "k", "ids", 3).orderBy("window").collect()] == [[1, 2, 3], [4, 5, 6]]
    p = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 20), (1, 3, 1)], "d long, line int, n int")
    assert [r.pack for r in packing.greedy_paragraphs(p, "d", "line", "n", 12).orderBy("line").collect()] == [0, 0, 1, 2]
    t = spark.createDataFrame([([5, 6, 7, 8],)], "ids array<int>")
    assert t.select(packing.shifted_targets(F.col("ids"), F.lit(2))).first()[0] == [-1, 7, 8, -1]
    assert t.select(packing.padded(F.col("ids"), 6)).first()[0] == [5, 6, 7, 8, 0, 0]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n1x\n\nstep 5: train loss 1.5, val loss 2.25\nk = v=1\n=bad\n# c\n")
    assert readers.words(spark, str(tmp_path / "a.txt")).count() == 1
    assert [tuple(r) for r in readers.log_rows(spark, str(tmp_path / "a.txt")).collect()] == [(5, 1.5, 2.25)]
    assert ("k", "v=1", None) in [tuple(r) for r in readers.config(spark, str(tmp_path / "a.txt")).collect()]
    (tmp_path / "p.txt").write_text("a\nb\n\nc\n\n\n\nd")
    assert readers.paragraphs(spark, str(tmp_path / "p.txt")).count() == 3
    (tmp_path / "t.tsv").write_text("# x\na\t1\nb\t2\n")
    assert readers.tsv(spark, str(tmp_path / "t.tsv"), "w string, n int").count() == 2
    df = spark.createDataFrame([(1, "a\tb"), (2, None)], "k int, s string")
    writers.tsv(df, str(tmp_path / "o"))
    writers.keyed(df, str(tmp_path / "keyed"), "k", 2)
    assert spark.read.parquet(str(tmp_path / "keyed")).count() == 2
    out = scratch(spark, "t")
    assert writers.append_missing(df, out, "k").count() == 2
    more = writers.append_missing(df.unionByName(spark.createDataFrame([(3, "c")], df.schema)), out, "k")
    assert spark.read.parquet(out).count() == 3 and more is not None


def test_stream_equals_fold(spark, tmp_path):
    msgs = [("a", 1, "uppercase: foo"), ("b", 1, "who is Foba Kuket?"), ("a", 2, "tell Sara a joke"), ("a", 3, "cancel"), ("b", 2, "again")]
    df = spark.createDataFrame(msgs, "session string, seq long, text string")
    want = sorted(map(tuple, dialogue.fold(df).collect()))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = dialogue.stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("quern_dialogue").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("quern_dialogue").collect())) == want


def test_style_ends():
    state = dialogue.turn({}, "echo: x")
    for _ in range(dialogue.STYLE_TURNS):
        assert state["style"] == "echo"
        state = dialogue.turn(state, "hello")
    assert state["style"] is None


def test_counts_of_several_runs(spark, tmp_path):
    """Each input row counts once, over several runs; unchanged keys aren't written again."""
    import datetime as dt

    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    day = lambda d: dt.datetime(2024, 1, d)
    schema = "event_type string, ts timestamp"
    for rows in ([("a", day(1)), ("a", day(1)), ("b", day(2))], [("a", day(1)), ("c", day(3))], []):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        dialogue.incremental_counts(spark, src, spark.createDataFrame([], schema).schema, out, mark)
    assert sorted((r.event_type, r.n) for r in dialogue.latest(spark, out, ["event_type", "day"]).collect()) == [("a", 3), ("b", 1), ("c", 1)]
    assert spark.read.parquet(out).where("event_type = 'b'").count() == 1


def test_late_events_are_dropped_in_a_stream(spark, tmp_path):
    """Windows of event time close an hour behind the latest event; what comes later isn't counted."""
    import datetime as dt

    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "event_type string, ts timestamp_ntz"
    for rows in ([("a", at(8)), ("a", at(8, 5)), ("b", at(12))], [("a", at(8, 9)), ("b", at(12, 1))], [("c", at(20))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = dialogue.windowed(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("append").option("checkpointLocation", mark).trigger(availableNow=True).format("parquet").option("path", out).start()
        q.awaitTermination()
    assert sorted((r.event_type, r.n) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 2)]


def test_shares_and_first_values(spark):
    import pytest

    from quern.plans.more import first_unique
    from quern.plans.shaping import share_totals

    plan = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5), ("n", "a", 1.0)], "mix string, source string, target_share double")
    assert {(r.mix, r.total, r.ok) for r in share_totals(plan, {("m", "a"): 0.25}).collect()} == {("m", 0.75, False), ("n", 1.0, True)} and all(r.ok for r in share_totals(plan).collect())
    assert first_unique(plan, "source", "s", 2).count() == 2
    with pytest.raises(ValueError):
        first_unique(plan, "source", "s", 3)
