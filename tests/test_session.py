"""Sessions without a configured folder, and an entry without the corpus operators' packages."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code: str, **env) -> str:
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, env={**os.environ, **env}, timeout=300)
    assert not done.returncode, done.stderr[-2000:]
    return done.stdout


def test_local_session_without_settings(tmp_path):
    code = (
        "from boxline.sources import session\n"
        "spark = session.local_session(cores='2', memory='1g')\n"
        "assert not spark.conf.get('spark.checkpoint.dir', None)\n"
        "rows = session.materialise(spark.range(5), 'x')\n"
        "print(rows.count(), session.shared_folder(spark) == session.shared_folder(spark))\n"
    )
    assert "5 True" in run(code, SPARK_CONF_DIR=str(tmp_path))


def test_entry_without_corpus_packages():
    code = (
        "import sys, warnings\n"
        "sys.modules['boxline.llm'] = None\n"
        "warnings.simplefilter('ignore')\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()) > 100, [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])\n"
    )
    assert "True []" in run(code)
