"""Python workers find the package when the driver starts in another folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from vantage.session import build_session
spark = build_session("local[1]", extra={"spark.checkpoint.dir": sys.argv[2]})
sys.path.remove(sys.argv[1])

def where(rows):
    import vantage.streaming.ingest as m
    return [m.__name__ for _ in rows]

print(spark.sparkContext.parallelize(range(3), 1).mapPartitions(where).collect())
spark.stop()
"""


def test_workers_import_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, ROOT, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240
    )
    assert run.stdout.count("vantage.streaming.ingest") == 3, run.stderr[-2000:]
