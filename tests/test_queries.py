"""Every registered query against its SQL at the smallest scale, and the registry's contract."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from compare import connection, differences

from orefall.plans import registry

ROOT = Path(__file__).resolve().parent.parent
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        assert not differences(got, duck.execute(ORACLES[name]).fetchdf())
    else:
        assert len(got.columns)


def test_only_sampling_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"sampling"}


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "rank"]


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; from orefall.plans import registry; assert set(e.queries()) == set(registry.queries()); assert set(e.oracle_sql()) == set(registry.oracles()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, check=False)
    assert out.returncode == 0 and int(out.stdout) == len(QUERIES), out.stderr
