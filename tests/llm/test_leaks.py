import random

import numpy as np

from quern.llm import leaks as L
from quern.llm.fmindex import FMIndex, suffix_array

ITEM = "The ferry from Jibufijut to Fodegirum took four hundred wallets and Vebo Dilul while nobody near Fodegirum believed that Rabi Bitus owned them. Which shovel is meant?"


def block(*items):
    v = L.Vocabulary()
    return v, [L.Tests(list(items), v)]


def test_suffix_array_and_search_like_brute_force():
    rnd = random.Random(3)
    for size in (1, 5, 60, 400):
        seq = np.array([rnd.choice([0, 1, 1, 2, 3, 4]) for _ in range(size)] + [0], np.int64)
        ends = [next(j for j in range(i, len(seq)) if seq[j] == 0) for i in range(len(seq))]
        assert suffix_array(seq).tolist() == sorted(range(len(seq)), key=lambda i: (tuple(seq[i : ends[i]]), i))
        fm = FMIndex(seq, 4)
        phrases = np.array([[rnd.randint(1, 4) for _ in range(3)] for _ in range(40)])
        lo, hi = fm.search(phrases)
        for p, a, b in zip(phrases.tolist(), lo, hi):
            want = [i for i in range(len(seq) - 2) if seq[i : i + 3].tolist() == p]
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


def test_leaks(spark):
    ws = ITEM.split()
    texts = {
        1: ITEM, 2: "before. " + " ".join(ws[3:16]).upper() + " after", 3: " ".join(ws[2:10]) + " and nothing else", 4: "<b>" + "&nbsp;".join(ws[4:18]) + "</b>",
        5: " ".join([*ws[3:8], "sooo", *ws[9:12], *ws[13:20]]), 6: None, 7: "", 8: "the ferry from Aaa to Bbb took nine hundred pots and Cc Dd while nobody near Bbb believed that Ee Ff owned them", 9: "x " * 30_000 + ITEM, 10: ITEM + " " + ITEM,
    }
    df = spark.createDataFrame([("documents", k, "text", v) for k, v in texts.items()], "corpus string, record_id long, field string, text string").selectExpr("*", "1 as item_id")
    items = spark.createDataFrame([("a", ITEM, "short"), ("b", None, None), ("c", "other words", "")], "id string, prompt string, answer string")
    found = L.leaks(items, df).collect()
    assert {(r.record_id, r.item_id) for r in found} == {(k, "a") for k in (1, 2, 4, 5, 9, 10)}
    span = next(r for r in found if r.record_id == 2)
    assert texts[2][span.begin : span.end] == " ".join(ws[3:16]).upper()
    assert {(r.record_id, r.item_id) for r in L.leaks(items, df, block=1).collect()} == {(k, "a") for k in (1, 2, 4, 5, 9, 10)}


def test_two_changed_words_of_a_dozen_wherever_they_stand():
    """Any two words of a run of 12 to 14, or one of a whole item of 11, may be changed, also near its ends; 8 words are no leak."""
    words = "alder birch cedar ebony fig gum hazel iris juniper kapok larch maple nutmeg olive poplar quince rowan sorrel tamarind".split()
    tests, short = block(("a", " ".join(words), None)), block(("b", " ".join(words[:11]), None))

    def text(first, size, changed):
        return "so he said " + " ".join(f"zz{k}" if k in changed else w for k, w in enumerate(words[first : first + size])) + " and went away"

    for size in (12, 13, 14):
        pairs = [(a, b) for a in range(1, size - 1) for b in range(a + 1, size - 1)]
        assert {h[1] for h in L.search([text(3, size, x) for x in pairs], *tests)} == set(range(len(pairs)))
    assert {h[1] for h in L.search([text(0, 11, (k,)) for k in range(11)], *short)} == set(range(11))
    assert L.search([text(k, 8, ()) for k in range(11)] + [text(2, 10, (1, 8))], *tests) == []
    by_chance = " ".join(words[2:10]) + " what larch zz nutmek and went away"
    assert L.search([by_chance], *tests) == []
    (hit,) = L.search([text(3, 12, (1, 6))], *tests)
    assert hit[2:] == (3, 14)


def test_empty(spark):
    items = spark.createDataFrame([], "id string, prompt string, answer string")
    df = spark.createDataFrame([("documents", 1, "text", ITEM)], "corpus string, record_id long, field string, text string")
    assert L.leaks(items, df).collect() == []
    assert L.leaks(spark.createDataFrame([("a", ITEM, "")], items.schema), df.limit(0)).collect() == []


def test_shards_and_blocks_find_the_same():
    rnd = random.Random(5)
    tests = block(("a", ITEM, None))
    texts = [" ".join(rnd.choice(ITEM.split()) for _ in range(30)) for _ in range(50)] + ["x " + ITEM + " y"] * 3
    assert sorted(L.search(texts, *tests)) == sorted((h[0], i, *h[2:]) for i, t in enumerate(texts) for h in L.search([t], *tests))
    v = L.Vocabulary()
    items = [(str(k), " ".join(rnd.sample(ITEM.split(), 20)), None) for k in range(9)]
    texts += [" and ".join(x[1] for x in rnd.sample(items, 2)) for _ in range(20)]
    parts = [L.Tests(items[k : k + 4], v) for k in (0, 4, 8)]
    assert sorted(L.search(texts, v, parts)) == sorted(L.search(texts, *block(*items))) != []


def test_short_prompts_with_one_wrong_word():
    for prompt, wrong in (("copy the red notebook before supper", "copy the blue notebook before supper"), ("why does seven grey horses eat so much hay", "why does seven brown horses eat so much hay"), ("copy the red notebook before supper", "copy the red old notebook before supper")):
        tests = block(("a", prompt, None))
        assert [h[:2] for h in L.search([f"he said {wrong} again", f"he said {prompt} again", "the red notebook"], *tests)] == [("a", 0), ("a", 1)]
    assert L.search(["write it well", "write that down"], *block(("a", "write it down", None))) == []


def test_every_occurrence_gives_a_span_like_brute_force():
    """Whole copies and long parts of two items at random places: the found spans cover them exactly."""
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    a, b = words[:25], words[30:55]
    tests = block(("a", " ".join(a), None), ("b", " ".join(b), None))
    for _ in range(30):
        text, want = [], []
        for _ in range(rnd.randint(1, 5)):
            text += [f"x{rnd.randint(0, 99)}" for _ in range(rnd.randint(3, 9))]
            item, ws = rnd.choice((("a", a), ("b", b)))
            first = rnd.choice((0, rnd.randint(0, 12)))
            part = ws[first : first + rnd.choice((25, 13))]
            if len(part) >= 12:
                want.append((item, 0, len(text), len(text) + len(part) - 1))
            text += part if len(part) >= 12 else []
        assert sorted(L.search([" ".join([*text, "end"])], *tests)) == sorted(want)


def test_a_misspelt_word_is_an_error():
    """Another text of the same pattern with other names, some nearly alike, is no leak."""
    item = "jalu razam repaired the borrowed ladder of femesanak for 466 coins at dusk tulo pagat counted 657 needles"
    other = "juta gazam repaired the borrowed ladder of gatikanak for 128 coins at dusk vosu fagat counted 778 spindles"
    assert L.search([other], *block(("a", item, None))) == []
    assert len(L.search([item.replace("coins", "cions").replace("ladder", "lad der")], *block(("a", item, None)))) == 1


def test_many_items_with_one_hot_phrase_in_bounded_steps(monkeypatch):
    items = [(str(k), f"n{k} a{k} the hot phrase here b{k} c{k} d{k} e{k} f{k} g{k} h{k} i{k}", None) for k in range(300)]
    texts = [f"so x{k} the hot phrase here y{k}" for k in range(300)] + [items[7][1], items[299][1]]
    monkeypatch.setattr(L, "STEP", 1000)
    assert [(h[0], h[1]) for h in sorted(L.search(texts, *block(*items)), key=lambda h: h[1])] == [("7", 300), ("299", 301)]
