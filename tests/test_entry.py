import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'face_extraction' in q, any(n.startswith('op') for n in q))"


def test_entry_without_the_optional_parts(tmp_path):
    """The driver contract holds where meshlake/llm and corpus_pipeline.py are not there."""
    for name in ("meshlake", "__spark_entry__.py"):
        source = f"{REPO}/{name}"
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=False)
    assert said.returncode == 0, said.stderr
    n, faces, llm = said.stdout.split()
    assert int(n) > 50 and faces == "True" and llm == "False"


def test_every_oracle_has_a_query():
    said = subprocess.run([sys.executable, "-c", CODE], cwd=REPO, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": REPO}, check=False)
    assert said.returncode == 0, said.stderr
