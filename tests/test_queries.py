import importlib

import pytest
from oracle import connect, same

import __spark_entry__

CORE = {name: (call, module.SQL.get(name)) for module in map(importlib.import_module, __spark_entry__.CORE) for name, call in module.QUERIES.items()}


#: What SQL cannot count.
NO_SQL = {"repo_bpe_tokens"}


@pytest.fixture(scope="module")
def link(data):
    return connect(pytest.importorskip("duckdb"), data)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, data, link, name):
    call, text = CORE[name]
    if name in NO_SQL:
        assert text is None and call(spark, data).count() > 0
    else:
        same(spark, data, link, call, text)


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).columns == ["field", "key_value"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_subpackage_or_what_it_needs(monkeypatch, capsys):
    import sys

    for name in [x for x in sys.modules if x.startswith("billow.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "regex", None)
    monkeypatch.setitem(sys.modules, "billow.llm.queries", None)
    assert set(__spark_entry__.queries()) == set(CORE)
