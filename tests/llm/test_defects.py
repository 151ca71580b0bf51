import re
from collections import Counter

import numpy as np
import pytest

from quern.llm import defects as D


@pytest.fixture(scope="module")
def model():
    return D.Languages()


PAIRS = [
    ("list the files in a_b by size", None, "empty"), ("x y z", " ​\n", "empty"), ("x y z", "N/A", "empty"), ("x y z", "<answer></answer>", "empty"), ("x y z", "...", "empty"),
    ("how old is Foo", "None", "empty"), ("what does a_b.append(3) return", "None", None), ("how big is the folder x_y", "How big is the folder x_y?", "copy"),
    ("how big is the folder x_y", "You asked: how big is the folder x_y", "copy"), ("say exactly: Foo opens at 9", "Foo opens at 9", None), ("fix: for x in a print(x)", "for x in a: print(x)", None),
    ("who is Foo Bar", "I'm sorry, but I can't help with that.", "refusal"), ("who is Foo Bar", "As an AI, I have no opinions about Foo.", "refusal"), ("who is Foo Bar", "that one is not in my notes.", None),
    ("why can't i remove it", "You can't remove a folder with plain rm. Use rmdir for it.", None), ("write a note that i can't come, for Foo", "Sorry, Foo, I cannot make it today.", None),
    ("what is the result of the count", "Najpierw trzeba porozmawiać z sąsiadem i policzyć wszystko jeszcze raz.", "other_language"), ("what is the result of the count", "次に大きい数を探して、結果を確かめます。", "other_language"),
    ("translate to spanish: the boy lives near the river with many goats", "el niño vive cerca del río con muchas cabras", None), ("count everything in a_b", "len(", "truncated"), ("what did he say to her", 'he said "and then', "truncated"),
]


@pytest.mark.parametrize(("prompt", "answer", "want"), PAIRS)
def test_rules(prompt, answer, want, model):
    got = D.defect(prompt, answer, model)
    assert (None if got == "maybe" else got) == want


def test_null_prompt_and_long_text(model):
    assert D.defect(None, "", model) == "empty"
    assert D.defect(None, "word " * 50_000 + "end", model) in (None, "maybe")


def test_contexts_hash_equal_ends_alike():
    of, order, key, ends = D.contexts(["abcdef", "xxcdef", ""])
    last = lambda t: key[(of == t) & (order == len(D.ORDERS) - 1)][-1]
    assert last(0) == last(1) and ends[(of == 0)].any() and not (of == 2).any()
    assert np.array_equal(np.unique(of), [0, 1])


def test_end_of_text(spark):
    whole = [(i, f"how do i stop job {i % 7}", "Find it in the list first, then wait until the prompt returns.") for i in range(300)]
    cut = [(1000, "how do i stop job 3", "Find it in the list first, then wait unt"), (1001, "how do i stop job 2", "Find it in the list first, then wait until the prompt returns")]
    df = spark.createDataFrame([*whole, *cut, (1000, "how do i stop job 3", "Find it in the list first, then wait unt")], "pair_id long, prompt string, answer string").selectExpr("*", "'x' as defect", "1 as h")
    got = sorted(map(tuple, D.defects(df).collect()))
    assert got == [(1000, "truncated")] * 2


def test_common_cut_does_not_vouch_for_itself(spark):
    """Copies of a cut answer (here 5 % of its context, or 50 % for the hot one) are no evidence that answers end there."""
    names = [f"zefu_{x}" for x in "abcdefghijklmnopqrst"]
    whole = [(i, f"what does chmod 600 {names[i % 20]} do", f"It lets only the owner open and change {names[i % 20]}, and nobody else may even look at it.") for i in range(380)]
    cut = [(1000 + i, f"what does chmod 600 {names[i]} do", f"It lets only the owner open and change {names[i]},") for i in range(20)]
    hot = [(2000 + i, "what does chmod 600 zefu_a do", "It lets only the owner open and change zefu_a, and nobody else may ev") for i in range(380)]
    df = spark.createDataFrame([*whole, *cut, *hot], "pair_id long, prompt string, answer string")
    assert sorted(map(tuple, D.defects(df).collect())) == sorted((r[0], "truncated") for r in [*cut, *hot])


def test_common_whole_answer_is_no_cut(spark):
    """A frequent answer that others continue is whole."""
    rows = [(i, f"how do i stop job {i % 7}", "Find it in the list of jobs first." if i % 2 else "Find it in the list of jobs first and then wait for it.") for i in range(300)]
    assert D.defects(spark.createDataFrame(rows, "pair_id long, prompt string, answer string")).collect() == []


def test_empty_table(spark):
    assert D.defects(spark.createDataFrame([], "pair_id long, prompt string, answer string")).collect() == []


def test_reformatted_answers_are_asked_too(spark):
    """Blanks, case, camel case and marks don't keep a break-off from being found."""
    words = "The town lies in the north of the country, where people call getName to read the name".split()
    whole = [(i, f"where is town {i}", "The town lies in the north of the country.") for i in range(150)] + [(200 + i, f"how do i read {i}", "You call getName to read the name of it.") for i in range(150)]
    cut = ["The town lies in the nor ", "The  town lies in the nor", "THE TOWN LIES IN THE NOR", "The Town Lies In The Nor", "\u00abThe town lies in the nor\u00bb", "tHe towN lieS in thE nor", "You call getName to read the na"]
    fine = ["THE TOWN LIES IN THE NORTH OF THE COUNTRY", " The Town Lies  In The North Of The Country! "]
    rows = [*whole, *[(1000 + k, "where is town 5", a) for k, a in enumerate(cut)], *[(2000 + k, "where is town 6", a) for k, a in enumerate(fine)]]
    got = {r.pair_id: r.defect for r in D.defects(spark.createDataFrame(rows, "pair_id long, prompt string, answer string")).collect()}
    assert got == {1000 + k: "truncated" for k in range(len(cut))} and words


def test_refusals_beyond_the_seed_phrases():
    counts, texts = D.Refusals.seeds()
    model, refusals = D.Languages(), D.Refusals(counts, texts)
    for p, a in (
        ("who is Foo Bar", "Sorry, I must turn this request down."), ("who is Foo Bar", "That falls outside what I am willing to write."), ("who is Foo Bar", "I won't be answering that."), ("wer ist Foo Bar", "Leider kann ich dazu nichts sagen."),
        ("wo liegt Foo", "Tut mir leid, ich kann dabei nicht helfen."), ("¿quién es Foo?", "Lo siento, no puedo responder a eso."), ("qui est Foo", "Désolé, je ne peux pas répondre à cela."),
    ):
        assert D.defect(p, a, model, refusals) == "refusal", a
    for p, a in (
        ("why can't i remove it", "You can't remove a folder with plain rm. Use rmdir for it."), ("say exactly: Sorry, I must turn this request down", "Sorry, I must turn this request down."), ("where do i go", "I think the house is near the river and we went there before the evening."),
        ("wo liegt Foo", "Das Haus steht am Fluss und wir sind vor dem Abend dort gewesen."), ("¿dónde está?", "La casa está junto al río y estuvimos allí antes de la noche."),
    ):
        assert D.defect(p, a, model, refusals) != "refusal", a


def test_no_switches_by_length(model):
    for a in ("N/A", "N/A...", "N/A............................", "<b>N/A</b>                                        ."):
        assert D.defect("x y z", a, model) == "empty"
    assert not D.is_empty("x y z", "Unknownplaceholder is a word that stands here")
    assert D.is_copy("why is the old red house near the river not open", "near the river why is the old red house not open") and not D.is_copy("fix the old red house near the river is opne now", "the old red house near the river is open now")


def test_case_lost(spark):
    texts = ["THE TOWN", "Kado Sodak", "tHe towN lieS in thE nor", "call getName to read", "The town lies", "12 + 3", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    assert [r[0] for r in df.orderBy("i").select(D.case_lost(df["a"])).collect()] == [True, True, True, False, False, False, False]
    known = {"town", "lies", "in"}.__contains__
    assert D.cased_skeleton("THE TOWN LIES  IN FOO_BAR, KADO 12.", known) == "N town lies in I, N 0"


def test_refusal_phrases_share_their_boundary():
    """One look for a word boundary at each character, not one for each phrase; the words' n-grams are counted once a word."""
    first = re._parser.parse(D._REFUSAL.pattern, D._REFUSAL.flags)[0]
    assert str(first[1]) == "AT_BOUNDARY"
    total, words = np.zeros((D.BUCKETS, len(D.LANGS))), [Counter({"niño": 3, "the": 2}), *[Counter() for _ in D.LANGS[1:]]]
    want = np.zeros(D.BUCKETS)
    np.add.at(want, D._grams("niño") * 3 + D._grams("the") * 2, 1)
    D.spread(words, total)
    assert np.array_equal(total[:, 0], want) and not total[:, 1:].any() and not any(words)


def test_skeleton_ends(spark):
    want = {
        " 'Take it.\" ": "N it", "\"' ,": ",", "it , ;": "it", "take it -. ": "take it", "take it,": "take it,", "it .\u2028": "it\u2028", "?!": "", "\"'": "", "": "", None: "",
        "call getName and a_b2_c of Foo Bar 12 times": "call I and I of N N 0 times", "_é aBé Fooé": "_é aBé Fooé", "a\t b\n": "a b",
    }
    df = spark.createDataFrame(list(enumerate(want)), "i int, a string")
    assert [r[0] for r in df.orderBy("i").select(D.skeleton(df["a"])).collect()] == list(want.values())
