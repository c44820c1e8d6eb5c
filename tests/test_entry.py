"""The entry points without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; print(len(e.queries()), sorted(k for k in e.queries() if k.startswith('op')), 'pipeline' in e.queries(), len(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [["panelforge/llm", "corpus_pipeline.py"], ["panelforge/llm"]])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    from panelforge.plans import catalogue

    for name in ("panelforge", "__spark_entry__.py", "corpus_pipeline.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        if name not in gone and (ROOT / name).exists():
            copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "panelforge/llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"}).stdout
    assert said.split() == [str(len(catalogue.QUERIES)), "[]", "False", str(len(catalogue.SQL))]
