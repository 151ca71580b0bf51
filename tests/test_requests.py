import pytest

from quern.functions import questions as Q
from quern.functions import requests as R


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("please uppercase hello there", ("upper", "HELLO THERE")), ("make 'my code' uppercase", ("upper", "MY CODE")), ("reverse the word stone", ("reverse", "enots")), ("reverse the words in red old box", ("reverse_words", "box old red")), ("how many letters are in kettle?", ("count_letters", "6")),
        ("count the vowels in audio", ("count_vowels", "4")), ("how many words in: a b  c", ("count_words", "3")), ("how many characters in a b c without spaces", ("count_chars_nospace", "3")), ("remove the spaces from a b c", ("remove_spaces", "abc")), ("repeat ha three times", ("repeat", "ha ha ha")),
        ("replace a with o in banana", ("replace", "bonono")), ("initials of ada benner", ("initials", "A. B.")), ("acronym for north old town", ("acronym", "NOT")), ("sort the words pear apple fig", ("sort_words", "apple fig pear")), ("what is the first word of blue moon", ("first_word", "blue")),
        ("last word of 'blue moon'", ("last_word", "moon")), ("is level a palindrome?", ("palindrome", "yes")), ("spell cat", ("spell", "c-a-t")), ("title case: a tale of o'neil", ("title", "A Tale Of O'Neil")), ("capitalize hELLO wORLD", ("capitalize", "Hello world")), ("lowercase ABC please", ("lower", "abc")),
        ("uppercase a python list", None), ("what does uppercase mean", None), ("how do i reverse a list", None), ("reverse it", None), ("who was Ada", None), ("", None), (None, None), ("uppercase " + "x" * 130, None), ("repeat abcdefghij fifty times", None), ("repeat ha 20 times", ("repeat", " ".join(["ha"] * 20))), ("uppercase é", None),
    ],
)
def test_text_requests(q, want):
    assert R.text_request(q) == want


def test_styles_and_lengths():
    for q, want in {
        "shout hello": ("literal", "upper", "hello"), "say 'good day' in caps": ("literal", "upper", "good day"), "answer in lowercase: who was Ada": ("wrap", "lower", "who was Ada"), "all caps: who was Ada": ("prefix", "upper", "who was Ada"), "who was Ada in all caps please": ("suffix", "upper", "who was Ada"),
        "from now on answer in title case": ("free", "title", ""), "who was Ada": None, "": None, None: None,
    }.items():
        assert R.style_request(q) == want, q
    assert R.styled("title", "a b-c") == "A B-C"
    assert R.length_literal("length of kettle") == ("kettle", False) and R.length_literal("how long is the word 'a b'?") == ("a b", True) and R.length_literal("how long is the river") is None and R.length_literal("length of it") is None and R.length_literal("the length of string red box") == ("red box", True)


def test_dialogue():
    assert R.with_entity("when was he born", "Ada Benner", Q.ENT_STOP) == "when was Ada Benner born" and R.with_entity("when was Tom born", "Ada", Q.ENT_STOP) is None and R.with_entity("when was he born", None, Q.ENT_STOP) is None and R.with_entity("is it", "x" * 130, Q.ENT_STOP) is None
    for q, want in {"again please": "repeat", "ok, never mind": "cancel", "hmm are you sure about it": "push", "back to normal please": "style_off", "the first one": "first", "the other": "second", "who was the first king": None, "one two three four five six seven eight nine ten eleven": None, None: None}.items():
        assert R.follow_up(q) == want, q
    assert R.spelled_out("hey, whats ur name pls") == "what is your name" and [R.act(q) for q in ("sdfgh jkl", "open ./a/b.txt", "when was he born", "who was Ada", None)] == ["mash", "file", "pronoun", None, None]


def test_arrow_forms(spark):
    df = spark.createDataFrame([("spell cat",), (None,), ("who",)], "q string").selectExpr("*", "1 as op")
    assert [r[0] for r in df.select(R.struct_udf(R.text_request, ["op", "output"])("q").alias("x")).select("x.output").collect()] == ["c-a-t", None, None]
    assert [r[0] for r in df.select(R.udf(R.follow_up, "string")("q")).collect()] == [None, None, None]
