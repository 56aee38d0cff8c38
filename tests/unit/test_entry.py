import os
import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("left_out", [["quillspan/llm"], ["quillspan/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_without_the_optional_parts(tmp_path, left_out):
    for name in ("quillspan", "corpus_pipeline.py", "__spark_entry__.py"):
        if name in left_out or not (ROOT / name).exists():
            continue
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name)
        else:
            shutil.copy(ROOT / name, tmp_path / name)
    if "quillspan/llm" in left_out:
        shutil.rmtree(tmp_path / "quillspan/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), 'pipeline' in q)"
    # Other tests put the repository itself on the path; the copy must stand alone.
    path = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and pathlib.Path(p).resolve() != ROOT)
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": path})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 40
