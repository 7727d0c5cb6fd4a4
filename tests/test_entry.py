import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op1') or n == 'pipeline' for n in e.queries()))"


def test_entry_works_without_the_corpus_operators(tmp_path):
    """With the subpackage away, whether the pipeline's file stands or not, the other queries are there."""
    shutil.copytree(REPO / "marlstone", tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("from marlstone.llm import chat\n")
    for _ in range(2):
        got = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
        assert int(got[0]) > 100 and int(got[1]) > 100 and got[2] == "False"
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
