import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["stream_key", "revision", "hash", "seq"] and found.count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_names_are_known_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout) > 100


def test_rest_stands_without_the_training_data_package(tmp_path):
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    package = tmp_path / "tessera"
    package.mkdir()
    for part in (REPO / "tessera").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (package / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith(('op1', 'pipeline'))]; print(len(e.queries()))"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        (package / "llm" / "__pycache__").mkdir(parents=True, exist_ok=True)  # a leftover folder is no package either


def test_nothing_else_imports_the_training_data_package():
    for path in [*REPO.glob("tessera/**/*.py"), *REPO.glob("tests/*.py"), REPO / "bench.py"]:
        if "llm" in path.relative_to(REPO).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("tessera.llm", "corpus_pipeline")) for n in names), path
