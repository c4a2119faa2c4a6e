import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def _names(folder) -> set[str]:
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True)
    return set(done.stdout.split())


def test_entry_without_the_training_data_part(tmp_path):
    """The entry imports without that subpackage, whether the pipeline's file is left or not, and has all other queries."""
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json")
    whole = {n for n in _names(ROOT) if n != "pipeline" and not n.startswith("op")}
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    assert _names(copy) == whole
    assert len(whole) > 80
    bare = shutil.copytree(ROOT, tmp_path / "bare", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", "corpus_pipeline.py"))
    assert _names(bare) == whole
