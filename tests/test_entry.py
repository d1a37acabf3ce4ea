import importlib

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def test_contract():
    q, s = entry.queries(), entry.oracle_sql()
    assert q and set(s) <= set(q)


def test_without_llm(monkeypatch):
    real = importlib.import_module

    def absent(name, *a):
        if name.startswith("gleanspark.llm"):
            raise ModuleNotFoundError(name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", absent)
    assert "p6_found" in entry.queries() and "p1_found" not in entry.queries()


def test_flagship(spark):
    assert entry.entry(spark).columns == ["snapshot_no", "url", "options_fingerprint", "change_status"]


@pytest.mark.parametrize("name", ["url1_crawl_key", "tk2_ranked_links", "ag4_rollup", "jn4_as_of", "ext1_records"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, D).count() >= 0
