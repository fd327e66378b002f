import pytest

from conftest import SF, compare
from ragweave.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, name):
    got, want = compare(spark, name)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name, column", [("context_blocks", "answer_context"), ("trace_context", "traceable_context"), ("display_table", "Text Snippet"), ("experiment_detail", "Model Answer")])
def test_whole_texts_reach_the_operators(spark, name, column):
    texts = [r.text for r in catalogue.read(spark, SF, "documents").select("text").collect()]
    shown = [r[0] for r in catalogue.QUERIES[name](spark, SF).select(column).collect()]
    assert sum(any(t in s for s in shown) for t in texts if len(t) > 200) > 20


def test_reference_answers_are_whole(spark):
    items = dict(catalogue.read(spark, SF, "benchmark").select("item_id", "text").collect())
    assert max(map(len, items.values())) > 80
    assert {r.query_id: r.answer for r in catalogue._questions(spark, SF).collect()} == items


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
