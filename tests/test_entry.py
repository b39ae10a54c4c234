import re
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).schema.names == ["region_id", "n_rows", "n_cols", "n_cells", "n_span_cells", "html"]


def test_core_stands_without_the_subpackage(tmp_path):
    """A copy without llm imports and lists the core queries; nothing else names it."""
    import shutil

    shutil.copytree(REPO / "quillgrid", tmp_path / "quillgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 100
    assert not [p for p in (tmp_path / "quillgrid").rglob("*.py") if re.search(r"\bllm\b", p.read_text())]
