import re


def test_p_names_are_training_data_operators():
    """A tool that takes the first query of a p and a number takes such an operator."""
    import __spark_entry__ as e
    from quern.llm import queries as llm

    assert {n for n in e.queries() if re.match(r"p\d+_", n)} == set(llm.QUERIES)
    assert next(n for n in e.queries() if n.startswith("p6_")) == "p6_mix" and next(n for n in e.queries() if n.startswith("p5_")) == "p5_ids"
    assert set(llm.SQL) <= set(llm.QUERIES)
