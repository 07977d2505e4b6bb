import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(at):
    return subprocess.run([sys.executable, "-c", LIST], cwd=at, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split()


def test_the_other_queries_do_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    core = names(tmp_path)
    assert len(core) > 50 and not [n for n in core if n == "pipeline" or n[:2] == "op" and n[2].isdigit()]
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(tmp_path) == core
