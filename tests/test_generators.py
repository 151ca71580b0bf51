from quern.functions import calc
from quern.functions.noise import noisy, typo, typo_title
from quern.functions.questions import edit1
from quern.plans import generators as G
from quern.plans.more import longest_run


def test_typos_are_one_edit():
    for k in range(300):
        t = typo("kettle", f"s{k}")
        assert t == "kettle" or edit1(t, "kettle")
    assert typo("kettle", "a") == typo("kettle", "a") and typo("", "a") == "" and typo_title("", "a") == "" and typo_title("Of Kettles", "a").startswith("Of ")


def test_noise_leaves_slots_and_identifiers_alone():
    kinds = set()
    for k in range(400):
        text, done = noisy("What is the {slot} of my_list in the garden? I cannot see it.", f"s{k}")
        assert "{slot}" in text and "my_list" in text and (not done) == (text == "What is the {slot} of my_list in the garden? I cannot see it.")
        kinds |= set(done)
    assert kinds == {"dropped", "typo", "small", "bare", "contracted", "casual"}


def test_generated_rows_are_right(spark):
    for name, own in G.TEMPLATES.items():
        rows = G.generated(spark, name).collect()
        assert len({(r.template_id, r.prompt) for r in rows}) == len(rows) and all("{" not in r.prompt + r.answer for r in rows if name != "g14")
        assert {t.id for t in own} == {r.template_id for r in rows}
    for r in G.generated(spark, "g9_spelled_arithmetic").collect():
        assert r.answer == f"calc({calc.spoken_expr(r.prompt)})"
    chat = {r.prompt: r.answer for r in G.generated(spark, "g7_chat_prompts").collect()}
    assert chat["what day comes after sunday"] == "monday" and chat["which month comes before january"] == "december"


def test_requests_parse_and_look_alikes_do_not(spark, sf):
    for r in G.QUERIES["g18_text_requests"](spark, sf).collect():
        assert r.found == r.wanted, r


def test_longest_run():
    assert longest_run("a b c d", "x b c, d") == 3 and longest_run("a", "") == 0 and longest_run("a a a", "a a") == 2


def test_dispatch_asks_each_prompt_once(spark, tmp_path):
    """Every prompt gets its first stage; the plan keeps to one reading of the questions, whose copies filled the driver."""
    pages = [(1, "Norland", None, 50_000, "{{Infobox country\n| name = Norland\n| capital = [[Velga]]\n}}\n'''Norland''' is a country in the north of the old continent, with many rivers."), (2, "Mercury (planet)", None, 30_000, "'''Mercury''' is the smallest planet and is the closest one to the sun of them all."), (3, "Mercury (element)", None, 30_100, "'''Mercury''' is a chemical element that is liquid at room temperature, unlike others.")]
    want = {
        "uppercase kettle": ("text", "KETTLE"), "what is five plus six": ("calc", "11"), "what is 5 divided by 0": ("calc", "error"), "what is the capital of Norland": ("facts", "The capital of Norland is Velga."), "what is the captial of norlnad": ("facts", "The capital of Norland is Velga."),
        "what is mercury": ("clarify", None), "who is Zed Quux": ("clarify", None), "hello you": ("clarify", None), "print(x)": ("clarify", None), "": ("clarify", None),
    }
    spark.createDataFrame(pages, "page_id long, t string, r string, n long, w string").write.parquet(f"{tmp_path}/wiki_pages.parquet")
    spark.createDataFrame([*enumerate(want), (99, None)], "pair_id long, prompt string").write.parquet(f"{tmp_path}/pairs.parquet")
    df = G.QUERIES["r9_dispatch"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted((i, *x) for i, x in enumerate(want.values()))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 2
