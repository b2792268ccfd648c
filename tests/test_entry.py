"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), len(s), any(k[:2] == 'op' and k[2:3].isdigit() for k in q), 'pipeline' in q)"


def _listed(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"})
    return out.stdout.split(), out.stderr


def _copy(target, without):
    shutil.copytree(ROOT, target, ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__", "docs") or os.path.relpath(os.path.join(d, n), ROOT) in without])
    return target


@pytest.mark.parametrize("gone", [("kestrel/llm", "tests/llm"), ("kestrel/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, gone):
    (n, with_sql, numbered, pipeline), errors = _listed(_copy(tmp_path / "repo", gone))
    assert int(n) == int(with_sql) > 80 and numbered == pipeline == "False", errors


def test_errors_inside_the_subpackage_are_raised(tmp_path):
    if not os.path.isdir(os.path.join(ROOT, "kestrel", "llm")):
        pytest.skip("the subpackage is not here")
    repo = _copy(tmp_path / "repo", ())
    with open(repo / "kestrel" / "llm" / "common.py", "a") as f:
        f.write("import no_such_module\n")
    shown, errors = _listed(repo)
    assert not shown and "no_such_module" in errors
