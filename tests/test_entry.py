from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.abspath(e.__file__))
SMALL = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    assert e.entry(spark).count() > 0


def test_the_library_does_not_need_the_corpus_operators():
    hide = "import sys; sys.modules['wordmesh.llm'] = None; "
    walk = "import pkgutil, importlib, wordmesh; [importlib.import_module(m.name) for m in pkgutil.walk_packages(wordmesh.__path__, 'wordmesh.') if not m.name.startswith('wordmesh.llm')]"
    subprocess.run([sys.executable, "-c", hide + walk], cwd=ROOT, check=True)


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("bare", [True, False])
def test_queries_without_the_corpus_folders(tmp_path, pipeline, bare):
    """Both folders are deleted, with the pipeline's file or without, and perhaps an empty folder stays."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for d in ("wordmesh/llm", "tests/llm"):
        shutil.rmtree(copy / d, ignore_errors=True)
    if bare:
        (copy / "wordmesh/llm/__pycache__").mkdir(parents=True)
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    ask = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 40; assert not [n for n in q if n[:2] == 'op' or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", ask], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, check=True, stdout=subprocess.DEVNULL)
