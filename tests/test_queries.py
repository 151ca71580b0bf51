"""Every query with SQL against DuckDB; the others run."""

import pytest

from quern.plans import registry


#: Queries that may find nothing in the smallest tables, and those with several rows for an id.
NONE_HERE, MANY_OF_AN_ID = {"f8_context_sentence", "f38_spoken_expr"}, {"f7_sentences", "s10_random_windows"}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(name, spark, sf, same):
    same(registry.QUERIES[name](spark, sf), registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark, sf):
    """Values are tested in the other modules; here that there are rows, each once where they have an id."""
    df = registry.QUERIES[name](spark, sf).persist()
    n = df.count()
    assert n > 0 or name in NONE_HERE
    ids = [c for c in ("pair_id", "doc_id", "qid", "page_id", "draw") if c in df.columns]
    assert not ids or df.select(ids[0]).distinct().count() == n or name in MANY_OF_AN_ID
    df.unpersist()


def test_core_queries_leave_p_names_to_the_training_data_operators():
    import re

    assert not [n for n in registry.QUERIES if re.match(r"p\d+_", n)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
