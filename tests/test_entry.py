"""The driver's contract holds with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), any(k.startswith('op') for k in q), 'pipeline' in q)"


def asked(folder) -> subprocess.CompletedProcess:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, env=env, capture_output=True, text=True, timeout=120)


def copied(to, *without: str) -> str:
    shutil.copytree(ROOT, to, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", *without)])
    return str(to)


def test_entry_without_the_subpackage(tmp_path):
    said = asked(copied(tmp_path / "repo", "llm"))
    assert said.returncode == 0, said.stderr
    n, known, ops, pipeline = said.stdout.split()
    assert int(n) >= 34 and (known, ops, pipeline) == ("True", "False", "False")


def test_entry_without_the_subpackage_and_its_pipeline(tmp_path):
    assert asked(copied(tmp_path / "repo", "llm", "corpus_pipeline.py")).returncode == 0


def test_an_error_inside_the_subpackage_is_an_error(tmp_path):
    folder = copied(tmp_path / "repo")
    if os.path.isdir(f"{folder}/corrolith/llm"):
        with open(f"{folder}/corrolith/llm/common.py", "a") as f:
            f.write("\nimport corrolith.llm.nowhere\n")
        assert "nowhere" in asked(folder).stderr
