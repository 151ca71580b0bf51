import json

from quern.llm import copies, queries


def brute(recs):
    fold = lambda s: None if s is None else "".join(c for c in s.upper().lower() if c.isalnum())
    first = {}
    for i, p, a in sorted(recs):
        first.setdefault((fold(p), fold(a)), []).append(i)
    return sorted((g[0], x) for g in first.values() for x in g[1:])


def test_hot_and_rare_groups(spark):
    recs = [(i, "Same  prompt", "an answer!" if i % 3 else "AN ANSWER") for i in range(60)] + [(100 + i, f"p{i // 2}", None if i % 4 < 2 else "") for i in range(20)] + [(200, None, None), (201, None, None), (202, "Straße", "x"), (203, "STRASSE", "x")]
    df = spark.createDataFrame(recs, "id long, prompt string, answer string")
    for hot in (10, 10_000):
        g = copies.grouped(df, hot_rows=hot, salts=4)
        got = sorted((r.first_id, r.id) for r in g.where("id > first_id").collect())
        assert got == brute(recs)
        assert {r.copies for r in g.where("first_id = 0").collect()} == {60}
    for most in (0, 100):  # many hot keys: salted joins instead of a broadcast
        assert sorted((r.first_id, r.id) for r in copies.grouped(df, 10, 4, most).where("id > first_id").collect()) == brute(recs)
        one = {r.id: r.copies for r in copies.collapsed(df, 10, 4, most).collect()}
        assert sum(one.values()) == len(recs) and one[0] == 60 and set(one) == {r[0] for r in recs} - {x for _, x in brute(recs)}


def test_json_lines(spark):
    bodies = ['{"prompt": "a", "answer": "b"}', '{"answer":"b","prompt":"a","answer":"c"}', '{"prompt": "a"} x', '["a"]', "", None, '{"prompt": "a", "ans', '{"prompt": 5}', json.dumps({"prompt": "\ud800x", "answer": None})]
    df = spark.createDataFrame(list(enumerate(bodies)), "line_id long, body string")
    assert [tuple(r) for r in copies.json_records(df).orderBy("id").collect()] == [(0, "a", "b"), (1, "a", "c"), (7, "5", None), (8, "?x", None)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, prompt string, answer string")
    assert copies.grouped(df).collect() == []


def test_sql(spark, sf, same):
    for name, sql in queries.SQL.items():
        same(queries.QUERIES[name](spark, sf), sql)
