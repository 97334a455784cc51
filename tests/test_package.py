"""The corpus operators stand apart: the rest works without them."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_imports_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "sketchloom")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert not re.search(r"import.*\bllm\b|from.*\bllm\b.*import", source.read()), f


def test_entry_without_llm(tmp_path):
    shutil.copytree(os.path.join(ROOT, "sketchloom"), tmp_path / "sketchloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry_does_not_hide_failed_imports(tmp_path):
    shutil.copytree(os.path.join(ROOT, "sketchloom"), tmp_path / "sketchloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode and "a_module_that_is_not_there" in done.stderr
