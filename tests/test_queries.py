"""Every core query against its SQL over the smallest tables."""

import os

import pytest

import verify
from attesto.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    found = verify.compare(spark, SF, name)
    assert found.startswith(("same", "rows")), found


@pytest.mark.parametrize("leaves_folder", [False, True])
def test_entry_imports_without_the_subpackage(tmp_path, leaves_folder):
    """The driver may delete the training-data subpackage and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "attesto", tmp_path / "attesto", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if leaves_folder:
        (tmp_path / "attesto" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.parametrize("name", ["boolean_and_scan", "bm25_top10", "range_join", "asof_join", "phrase", "outcomes_of_passages", "evidence_in_documents", "find_hybrid_by_date", "bm25_skipping_top10"])
def test_plans_have_no_product(spark, name):
    """No cartesian product; top-k is one operator; scans read the columns they need."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name == "bm25_top10":
        assert "TakeOrderedAndProject" in plan
    if name == "boolean_and_scan":
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
