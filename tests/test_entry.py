import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(root):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_without_the_text_subpackage(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    left = names(tmp_path / "repo")
    assert "tsnr_map" in left and not any(n.startswith("op") or n == "pipeline" for n in left)


def test_a_mistake_is_not_passed_over(tmp_path):
    """An import that fails inside a module that is there stops the entry."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "llm", "corpus_pipeline.py", ".pytest_cache"))
    held = tmp_path / "repo/gridweave/llm"
    held.mkdir()
    (held / "__init__.py").write_text("")
    (held / "catalogue.py").write_text("import no_such_module_of_ours\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no_such_module_of_ours" in done.stderr


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["x", "y", "z", "tsnr"] and df.count() == 500


def test_nothing_else_imports_the_text_subpackage():
    for p in (ROOT / "gridweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert "gridweave.llm" not in p.read_text() and ".llm" not in p.read_text()
