import importlib
import sys

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["repo", "requests", "candidates", "resolved", "unresolved", "coverage"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_subpackage(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("lodemap.llm") or name == "corpus_pipeline" else real(name, *a))
    found = __spark_entry__.queries()
    assert "coverage_by_repo" in found and not any(k.startswith("op") or k == "pipeline" for k in found)
    assert "op3_license_scan" not in __spark_entry__.oracle_sql()


def test_nothing_else_imports_the_subpackage():
    kept = {k: v for k, v in sys.modules.items() if k.startswith("lodemap")}
    for k in kept:
        del sys.modules[k]
    try:
        for name in ("functions.urls", "functions.identity", "functions.secrets", "operators.extract", "operators.stitch", "plans.catalog", "plans.build", "sources.repository", "streaming.events"):
            importlib.import_module(f"lodemap.{name}")
        assert not any(k.startswith("lodemap.llm") for k in sys.modules)
    finally:
        for k in [k for k in sys.modules if k.startswith("lodemap")]:
            del sys.modules[k]
        sys.modules.update(kept)
