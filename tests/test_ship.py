import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {repo!r})
from echolith.runtime import build_session
import __spark_entry__
spark = build_session("ship", 2)
print("ROWS", __spark_entry__.queries()["p3_found"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_workers_need_no_installed_package(tmp_path):
    """A session started in another folder, with nothing on the workers' path."""
    repo = str(Path(__file__).resolve().parents[1])
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)} | {k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "PATH", "LD_LIBRARY_PATH")}
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS" in out.stdout and int(out.stdout.split("ROWS")[1]) > 0, out.stderr[-1500:]
