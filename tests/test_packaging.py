"""Tasks find the package wherever the driver was started."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_tasks_run_from_another_folder(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from corpusweave.operators.bpe import learn_bpe
        from corpusweave.session import build_session
        spark = build_session("elsewhere", 2)
        words = spark.createDataFrame([("low", 5), ("lower", 2)], "word string, count long")
        print("found", [(r.left, r.right) for r in learn_bpe(words, 1).collect()])
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found [('l', 'o')]" in done.stdout, done.stderr[-2000:]
