import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
TELL = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


def test_entry_without_the_text_folders(tmp_path):
    """The other queries are listed whatever goes with the text operators: their folders alone, or corpus_pipeline.py too."""
    for k, gone in enumerate((["tremorlab/llm", "tests/llm"], ["tremorlab/llm", "tests/llm", "corpus_pipeline.py"])):
        copy = tmp_path / str(k)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(g) for g in gone if g.endswith(".py")]))
        for g in gone:
            shutil.rmtree(copy / g, ignore_errors=True)
        done = subprocess.run([sys.executable, "-c", TELL], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
        assert done.returncode == 0, done.stderr[-800:]
        queries, sql, text = map(int, done.stdout.split()[-3:])
        assert queries > 100 and sql > 100 and text == 0
