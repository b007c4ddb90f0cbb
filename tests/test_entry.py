import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


def test_every_query_with_sql_is_a_query():
    import __spark_entry__ as e

    assert e.oracle_sql().keys() <= e.queries().keys() and all(isinstance(s, str) for s in e.oracle_sql().values())
    assert len(e.queries()) > 95


@pytest.mark.parametrize("emptied", [False, True])
@pytest.mark.parametrize("pipeline", [False, True])
def test_the_engine_does_without_the_optional_folder(tmp_path, emptied, pipeline):
    """What is outside the optional folder imports, lists its queries and passes its tests without it."""
    without = shutil.ignore_patterns("llm", "__pycache__")
    for name in ("steadfield", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=without)
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        shutil.copy(ROOT / name, tmp_path / name)
    if emptied:
        (tmp_path / "steadfield" / "llm").mkdir()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') for n in q) and 'pipeline' not in q, q; e.oracle_sql()"
    env = {"PATH": os.environ.get("PATH", "/usr/bin:/bin"), "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert done.returncode == 0, done.stderr
    collected = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert collected.returncode == 0, collected.stdout


def test_only_the_entry_names_the_optional_folder():
    for p in (ROOT / "steadfield").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
    assert importlib.util.find_spec("steadfield")
