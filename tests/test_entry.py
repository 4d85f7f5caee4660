import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_corpus_operators(tmp_path, pipeline):
    """On a copy without the subpackage and its tests, with and without the pipeline's file."""
    for name in ("tessella", "jobs", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'cell_counts' in q and set(o) <= set(q); assert not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 90, done.stderr


def test_a_fault_inside_the_corpus_operators_is_raised(tmp_path):
    shutil.copytree(ROOT / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "tessella/llm").mkdir()
    (tmp_path / "tessella/llm/__init__.py").write_text("")
    (tmp_path / "tessella/llm/registry.py").write_text("import no_such_module")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr
