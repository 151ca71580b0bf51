import pytest

from quern.functions import questions as Q
from quern.functions import wiki
from quern.operators import retrieval
from quern.plans import knowledge

PAGES = [
    (1, "Ada Benner", None, 90_000, "{{Infobox person\n| name = Ada Benner\n| birth_date = {{Birth date|1815|12|10}}\n| death_date = 27 November 1852\n| birth_place = [[Loham]]\n}}\n'''Ada Benner''' (10 December 1815 - 27 November 1852) was a mathematician from Loham, known for her notes on engines."),
    (2, "Norland", None, 50_000, "{{Infobox country\n| name = Norland\n| population_total = 1,234,567\n}}\n'''Norland''' is a country in the north of the old continent, with many rivers and lakes."),
    (3, "Velga", None, 9_000, "'''Velga''' is the capital of Norland and lies on the river Tem, where the old market stands today."),
    (4, "Battle of Tem", None, 4_000, "{{Infobox military conflict\n| date = 3 May 1701 - 5 May 1701\n| place = [[Tem valley]]\n}}\nThe '''Battle of Tem''' was fought between two armies near the river for three days."),
    (5, "Mercury (planet)", None, 30_000, "'''Mercury''' is the smallest planet and is the closest one to the sun of them all."),
    (6, "Mercury (element)", None, 30_100, "'''Mercury''' is a chemical element that is liquid at room temperature, unlike other metals."),
    (7, "Ada B.", "Ada Benner", None, None), (8, "Countess B", "Ada B.", None, None), (9, "Lost", "Nowhere", None, None), (10, "Old War II", None, 800, "{{Infobox military conflict\n| date = 44 BC\n}}\nThe '''Old War II''' was a long war between the towns of the southern coast and the island."),
]


@pytest.fixture(scope="module")
def kb(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, t string, r string, n long, w string")
    x = knowledge.entities(pages).persist()
    return knowledge.key_candidates(pages, x).persist(), knowledge.entity_fields(x).drop("prov").persist(), x


def test_typed_fields(kb):
    got = {(r.t, r.etype): {k: (v.value, v.prov) for k, v in r.typed.items()} for r in kb[2].collect()}
    assert got["Ada Benner", "person"] == {"birth_date": ("1815-12-10", "infobox"), "death_date": ("1852-11-27", "infobox"), "birth_place": ("Loham", "infobox"), "occupation": ("mathematician", "lead_text"), "surname": ("Benner", "title")}
    assert got["Norland", "country"] == {"quantity": ("1234567", "infobox"), "capital": ("Velga", "reverse")}
    assert got["Battle of Tem", "event"] == {"date_range": ("1701-05-03/1701-05-05", "infobox"), "location": ("Tem valley", "infobox")}
    assert got["Old War II", "event"] == {}
    assert {(r.t, r.rel) for r in kb[1].where("missing").collect()} >= {("Ada Benner", "death_place"), ("Old War II", "date_range"), ("Norland", "location")}


QUESTIONS = {
    "when was Ada Benner born?": ("answer_present", "birth_date", "Ada Benner was born on 10 December 1815."), "where was ada benner born": ("answer_present", "birth_place", "Ada Benner was born in Loham."), "what is the last name of ada benner": ("answer_present", "surname", "The last name of Ada Benner is Benner."),
    "what is the capital of Norland": ("answer_present", "capital", "The capital of Norland is Velga."), "what is the population of norland": ("answer_present", "quantity", "Norland has a population of 1234567."), "when was the battle of tem": ("answer_present", "date_range", "Battle of Tem was from 3 May 1701 to 5 May 1701."),
    "where was the battle of tem": ("answer_present", "location", "Battle of Tem is in Tem valley."), "where did Ada Benner die": ("field_missing", "death_place", None), "who is Countess B": ("answer_present", "definition", None), "what is mercury": ("ambiguous", "definition", None),
    "when was ada bener born": ("answer_present", "birth_date", "Ada Benner was born on 10 December 1815."), "when was ada benner borrn": ("answer_present", "birth_date", "Ada Benner was born on 10 December 1815."), "what is the captial of norlnad": ("answer_present", "capital", "The capital of Norland is Velga."),
    "who is Zed Quux": ("no_match", "definition", None), "hello you": ("gated", None, None), "print(x)": ("gated", None, None), "what is 3 + 4": ("gated", None, None), "what is five times six plus two": ("gated", None, None), "tell 'me' what": ("gated", None, None), "norland is big": ("gated", None, None), "what is the height of norland": ("field_missing", "height", None),
    "": ("gated", None, None), None: ("gated", None, None), "what " * 40: ("gated", None, None),
}


def test_statuses(spark, kb):
    df = spark.createDataFrame(list(enumerate(QUESTIONS)), "qid int, question string").selectExpr("*", "1 as key", "2 as t")
    got = {r.qid: r for r in retrieval.retrieved(df, kb[0], kb[1]).collect()}
    assert len(got) == len(QUESTIONS)
    for i, (q, (status, rel, context)) in enumerate(QUESTIONS.items()):
        assert (got[i].status, got[i].relation) == (status, rel), (q, got[i])
        assert context is None or got[i].context == context, (q, got[i])
    assert got[list(QUESTIONS).index("who is Countess B")].title == "Ada Benner"


def test_words_in_any_order_and_floor(spark, kb):
    qs = ["when was benner ada born", "who is Tem's battle", "when was ada benner born", "who is the old ada benner of great loham town hall"]
    df = spark.createDataFrame(list(enumerate(qs)), "qid int, question string")
    got = {r.qid: (r.status, r.title) for r in retrieval.retrieved(df, kb[0], kb[1], aliases=True).collect()}
    assert got[0] == ("answer_present", "Ada Benner") and got[1] == ("answer_present", "Battle of Tem") and got[2] == ("answer_present", "Ada Benner") and got[3][0] in ("no_match", "ambiguous")
    plain = {r.qid: r.status for r in retrieval.retrieved(df, kb[0], kb[1]).collect()}
    assert plain[0] != "answer_present"


def test_corrupt_dates(spark, kb):
    fields = spark.createDataFrame([("Norland", "date_range", "1900-13", False), ("Velga", "date_range", "-0300", False)], "t string, rel string, value string, missing boolean")
    df = spark.createDataFrame([(1, "when was norland founded"), (2, "when was velga founded")], "qid int, question string")
    assert {(r.qid, r.status, r.context) for r in retrieval.retrieved(df, kb[0], fields).collect()} == {(1, "corrupt_kb", None), (2, "answer_present", "Velga was in 300 BC.")}


def test_empty(spark, kb):
    df = spark.createDataFrame([], "qid int, question string")
    assert retrieval.retrieved(df, kb[0], kb[1]).collect() == []
    one = spark.createDataFrame([(1, "who is Ada Benner")], df.schema)
    assert [r.status for r in retrieval.retrieved(one, kb[0].limit(0), kb[1].limit(0)).collect()] == ["no_match"]


def test_keys():
    assert wiki.keys_for("The Foo Bar (x)") == [("the foo bar x", 0), ("the foo bar", 2), ("foo bar x", 3)]
    assert ("benner", 3) in wiki.keys_for("Ada Benner", "person", 40) and ("benner", 3) not in wiki.keys_for("Ada Benner", "person", 3)
    assert set(wiki.keys_for("Old War II", "event")) == {("old war ii", 0), ("old war 2", 3), ("owii", 3), ("ow2", 3)}


def test_gates():
    assert Q.gate("hi there", ["hi", "there"]) is None and Q.gate("hi you", ["hi", "you"]) == "conversation" and Q.gate("what's up", ["what", "s", "up"]) is None
    assert Q.v0_gate("who was Foo") and not Q.v0_gate("foo is what") and not Q.v0_gate("what does sort do") and not Q.v0_gate("what is half of eighty") and not Q.v0_gate("who is Foo " * 20)
    assert Q.wants_context("who is Foo " * 20) and not Q.wants_context("what is 3*4")
    assert [Q.relation(x.split()) for x in ("how long is the tem", "how long did it last", "how old is foo", "what did foo do", "who wrote it", "when was it written", "how tall is it", "where is it")] == ["length", "date_range", "birth_date", "occupation", "creator", "date_range", "height", "location"]
    assert Q.grams([1, 0, 1]) == [(0, 3, 2)] and Q.edit1("captial", "capital") and not Q.edit1("ab", "ab")
