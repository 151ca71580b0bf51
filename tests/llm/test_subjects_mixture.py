import random

import numpy as np
import pytest

from quern.llm import mixture as M
from quern.llm import subjects as S

TERMS = {"food": "oven butter recipe dough pepper soup kitchen spoon".split(), "law": "court judge appeal lawyer verdict statute jury clause".split(), "music": "violin chord melody drummer opera tenor rhythm ballad".split()}
FILL = ["that was the key to the whole story", "nobody could say how it had started", "it was a quiet afternoon in the town"]


def text_of(rnd, subjects, n=8):
    out = []
    for _ in range(n):
        s = rnd.choice([*subjects, None]) if subjects else None
        out.append(f"most people know the {rnd.choice(TERMS[s])} better than the {rnd.choice(TERMS[s])} or the {rnd.choice(TERMS[s])}." if s else rnd.choice(FILL) + ".")
    return " ".join(out)


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(7)
    docs, labels, truth = [], [], {}
    for i in range(400):
        subjects = rnd.sample(sorted(TERMS), rnd.choice([0, 1, 1, 2]))
        t = text_of(rnd, subjects)
        docs.append((i, t, "en", rnd.choice(["a", "a", "A ", "b"]), None))
        truth[i] = {s for s in TERMS if sum(any(w in TERMS[s] for w in x) for x in S.sentences(t)) >= 0.2 * len(S.sentences(t))}
        if i % 2:
            labels += [(i, s, "x") for s in truth[i]] or [(i, None, "x")]
    docs += [(900, None, None, None, None), (901, "  ", "en", "c", None), (902, "", "de", "c", None)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, subject string"), spark.createDataFrame([*labels, labels[0], (None, "food", "x"), (1, "unknown", "x"), (99_999, "law", None)], "doc_id long, subject string, annotator string"),
        spark.createDataFrame([(s,) for s in TERMS], "subject string"), truth,
    )


def test_held_out_accuracy(tables):
    docs, labels, subjects, truth = tables
    got = {(r.doc_id, r.subject) for r in S.assign(docs, S.train(docs, labels, subjects)).collect()}
    want = {(i, s) for i, x in truth.items() if i % 2 == 0 for s in x}
    mine = {x for x in got if x[0] % 2 == 0}
    assert len(mine & want) > 0.93 * len(want) and len(mine & want) > 0.93 * len(mine)
    assert not {i for i, _ in got} & {900, 901, 902}


def test_without_labels(tables):
    docs, labels, subjects, _ = tables
    assert S.assign(docs, S.train(docs, labels.limit(0), subjects)).count() == 0
    assert S.assign(docs.limit(0), S.train(docs.limit(0), labels, subjects)).count() == 0


def test_rake_meets_sources():
    rnd = np.random.default_rng(1)
    have = rnd.integers(10, 1000, 24).astype(float)
    source, lang, topic = np.repeat([0, 1, 2], 8), np.tile([0, 1], 12), np.tile([0, 0, 1, 1], 6)
    w, size = M.rake(have, source, lang, topic, np.array([0.5, 0.3, 0.2, 0.0]), np.array([3, 3, 3, 1]), have.sum())
    got = np.bincount(source, have * w) / size
    assert np.allclose(got, [0.5, 0.3, 0.2], atol=1e-6) and w.max() <= 3 + 1e-9
    w, size = M.rake(np.array([10.0, 1000.0]), np.array([0, 1]), np.zeros(2, int), np.zeros(2, int), np.array([0.5, 0.4, 0.1]), np.array([2, 2, 2]), 1010.0)
    assert np.allclose([w[0], size], [2, 36]) and np.isclose(1000 * w[1] / size, 4 / 9)


def test_mix(spark, tables):
    docs, *_ = tables
    plan = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.3, 4), ("m", "gone", 0.2, 3), ("n", "b", 1.0, 1)], "mix string, source string, target_share double, max_repeat int")
    used, report, margins = M.mixes(docs, plan)
    rows = used.collect()
    assert len({(r.mix, r.doc_id) for r in rows}) == len(rows) and all(r.uses <= {"a": 2, "b": 4}[r.source] if r.mix == "m" else r.uses == 1 for r in rows)
    total = {s: sum(r.tokens * r.uses for r in rows if r.mix == "m" and r.source == s) for s in "ab"}
    assert abs(total["a"] / sum(total.values()) - 0.625) < 0.01
    assert {(r.mix, r.source): r.reachable_share for r in report.collect()}[("m", "gone")] == 0
    assert M.mixes(docs, plan.limit(0))[0].count() == 0 and M.mixes(docs.limit(0), plan)[0].count() == 0
    assert {(r.mix, r.kind, r.value): round(r.fitted_share, 3) for r in margins.collect()}[("m", "source", "a")] == 0.625


def test_draw_keeps_cells_and_caps(spark):
    """Every cell of source, language and topic comes as near to its fitted share as its documents' sizes let it."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice("ab"), rnd.choice(["en", "de"]), rnd.choice(["x", "y"]), rnd.randint(1, 60)) for i in range(3000)] + [(5000 + i, "a", "en", "x", 7) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    have = {}
    for _, s, la, t, n in rows:
        have[s, la, t] = have.get((s, la, t), 0) + n
    factors = [("m", *c, k % 3, 0.1 * k, 0.1 * k * n) for k, (c, n) in enumerate(sorted(have.items()))]
    got = M._drawn(df, factors, 7).collect()
    assert len({r.doc_id for r in got}) == len(rows)
    by_source = {}
    for f in factors:
        mine = [r for r in got if (r.source, r.lang, r.topic) == f[1:4]]
        assert {r.uses for r in mine} <= {f[4], f[4] + 1}
        off = sum(r.tokens * (r.uses - f[4]) for r in mine) - f[6]
        assert abs(off) <= 60
        by_source[f[1]] = by_source.get(f[1], 0) + off
    assert all(abs(x) <= 31 for x in by_source.values())


def test_sentences():
    text = "The court ruled for the plaintiff; the judge gave damages. A law f(x) is here. Yes. Normal sentence goes here.\nx = foo(y); z[0] += 1\nfor a in b:\nEnd of it"
    assert [" ".join(x) for x in S.sentences(text)] == ["the court ruled for the plaintiff the judge gave damages", "a law f x is here", "yes normal sentence goes here", "end of it"]
    assert S.sentences("Short one") == [["short", "one"]] and S.sentences(" ") == []


def test_calibration_of_each_subject():
    rnd = np.random.default_rng(3)
    x = np.concatenate([np.zeros(3000), rnd.uniform(0, 1, 3000)])
    y = np.where(rnd.random(6000) < 1 / (1 + np.exp(-40 * (x - 0.23))), 0.85, 0.04)
    got = S.calibrated(np.repeat([0, 1], 6000), np.tile(x, 2), np.concatenate([y, np.zeros(6000)]), 2)
    assert abs(got[0, 0] - 0.23) < 0.015 and got[1].tolist() == [S.SHARE, S.SLOPE]
    assert S.posteriors_of(np.array([[0.0, 0.18]]), np.array([[0.1, 40], [0.18, 40]])).tolist() == [[0.0, 0.5]]
