"""The driver's entry, whole and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from kindred.plans import storage

ROOT = Path(__file__).resolve().parent.parent
ASK = """
import sys
import __spark_entry__ as e
names = set(e.queries())
assert "exact_classes" in names and set(e.oracle_sql()) <= names
assert any(n.startswith("op1_") for n in names) == (sys.argv[1] == "whole"), names
print(len(names), "pipeline" in names)
"""


def _asked(root: Path, how: str) -> str:
    return subprocess.run([sys.executable, "-c", ASK, how], cwd=root, capture_output=True, text=True, check=True, timeout=120).stdout.strip()


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_core_imports_without_the_corpus_operators(tmp_path, with_pipeline):
    for name in ("__spark_entry__.py", "kindred", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists() and (with_pipeline or name != "corpus_pipeline.py"):
            shutil.copy(ROOT / name, tmp_path / name)
    (tmp_path / "kindred" / "llm" / "__pycache__").mkdir(parents=True)  # a folder left behind is no package
    assert _asked(tmp_path, "core").endswith("False")


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Conf:
        get = staticmethod(lambda key, other=None: other)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
