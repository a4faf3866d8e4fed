"""The rest of the repository without the training-data operators."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_library_works_without_llm():
    for path in (ROOT / "spindex").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "spindex").parts:
            assert "spindex.llm" not in path.read_text(), path


def test_entry_without_llm(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py", ".pytest_cache")
    for pipeline in (False, True):  # the folders alone, and with the pipeline
        copy = tmp_path / f"copy{pipeline}"
        shutil.copytree(ROOT, copy, ignore=skip)
        if pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", copy)
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'kw_score' in q and s.keys() <= q.keys(); print(sorted(k for k in q if k == 'pipeline' or k.startswith('op')))"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0 and done.stdout.strip() == "[]", done.stderr
