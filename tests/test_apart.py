"""The engine without its corpus operators."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = """
import __spark_entry__ as entry, bench
from folioframe.plans import catalog
assert set(entry.queries()) == set(catalog.queries()), set(entry.queries()) ^ set(catalog.queries())
assert set(entry.oracle_sql()) == set(catalog.oracle_sql())
"""


def run(folder):
    return subprocess.run([sys.executable, "-c", LOOK], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)}, timeout=120)


def copied(folder, *without):
    shutil.copytree(HERE, folder, ignore=lambda d, names: [n for n in names if n.startswith(".") or n == "__pycache__" or os.path.relpath(os.path.join(d, n), HERE) in without])
    return folder


def test_stands_without_the_corpus_operators(tmp_path):
    for k, without in enumerate((("folioframe/llm", "tests/llm"), ("folioframe/llm", "tests/llm", "corpus_pipeline.py"))):
        done = run(copied(tmp_path / str(k), *without))
        assert done.returncode == 0, done.stderr


def test_other_import_errors_are_raised(tmp_path):
    folder = copied(tmp_path / "broken", "tests/llm")
    (folder / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    done = run(folder)
    assert done.returncode != 0 and "a_module_that_is_not_there" in done.stderr
