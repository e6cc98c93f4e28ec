"""The registered queries with and without the part over training text, and that both test folders are collected."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from fleetlens.catalog.oracle import ORACLES
from fleetlens.catalog.queries import QUERIES

REPO = Path(__file__).resolve().parents[1]


def run(folder, *args):
    return subprocess.run([sys.executable, *args], cwd=folder, capture_output=True, text=True, timeout=300)


@pytest.fixture(scope="module")
def without(tmp_path_factory):
    """A copy of the repository without the part over training text."""
    copy = tmp_path_factory.mktemp("fleet") / "repo"
    gone = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    shutil.copytree(REPO, copy, ignore=gone)
    return copy


def test_entry_without_training_text_has_the_fleet_queries(without):
    told = run(without, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))")
    assert told.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], told.stderr


def test_all_tests_are_collected_with_and_without(without):
    for folder in (REPO, without):
        told = run(folder, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
        assert told.returncode == 0, told.stdout
        assert "test_examples" in told.stdout and "test_streaming" in told.stdout


def test_a_missing_dependency_is_not_taken_for_a_missing_part(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    part = tmp_path / "repo/fleetlens/llm"
    part.mkdir()
    (part / "__init__.py").write_text("")
    (part / "queries.py").write_text("import no_such_package\n")
    told = run(tmp_path / "repo", "-c", "import __spark_entry__")
    assert "no_such_package" in told.stderr
