import os
import shutil
import subprocess
import sys

import pytest

from barloom.plans import catalog, tools
from barloom.sources import tables
from tests import duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_twin(spark, sf_dir, con, name):
    assert duck.differing(spark, sf_dir, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name]) == ""


#: The same functions as queries with a twin, at the reference's numbers of replications; test_replicate has their plain loops.
LARGE = {"mcpt_trend_1000", "chooser_drawdown_full"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - LARGE))
def test_query_without_a_twin_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_report(spark):
    text = tools.report(tables.bars(spark, "/root/testdata/sf0.01"), "1-URGENT")
    assert "## Backtest" in text and "p_value" in text


def test_the_rest_works_without_the_corpus_part(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("barloom", "__spark_entry__.py", "bench.py"):
        copy = shutil.copytree if os.path.isdir(f"{here}/{name}") else shutil.copy
        copy(f"{here}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "barloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sma' in q and 'pipeline' not in q and not any(n.startswith('op') for n in e.oracle_sql() if n[2:3].isdigit())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
