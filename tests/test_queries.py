"""Every query with SQL gives the SQL's rows."""

import pytest
from conftest import SF

from tessera import queries as engine


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_equals_sql(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    cur = duck.execute(engine.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "matches", "first"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_partitions_dont_matter(spark):
    from tessera.operators.token_matcher import TokenMatcher
    from tessera.operators.tokenizer import tokenize_regex_docs

    docs = tokenize_regex_docs(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    m = TokenMatcher().add("r", [[engine._item("lower", "in", ["the", "of"], "one_or_more")]])
    rows = lambda n: sorted(map(tuple, m.find(docs.repartition(n)).collect()))
    assert rows(1) == rows(7) != []
