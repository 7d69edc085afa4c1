"""A job goes on with the right result when an executor dies under it."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

psutil = pytest.importorskip("psutil")

SCRIPT = '''
import random, sys, threading, time
import psutil
from pyspark.sql import SparkSession

root, folder = sys.argv[1:]
sys.path.insert(0, root)
spark = (
    SparkSession.builder.master("local-cluster[2,1,1100]").config("spark.executor.memory", "700m").config("spark.driver.memory", "900m")
    .config("spark.sql.shuffle.partitions", "3").config("spark.checkpoint.dir", "file://" + folder + "/shared").config("spark.ui.enabled", "false")
    .config("spark.executorEnv.PYTHONPATH", root).config("spark.sql.warehouse.dir", folder + "/warehouse").config("spark.deploy.maxExecutorRetries", "-1").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
from panelweave.llm.common import ship
from panelweave.llm.components import connected_components

ship(spark)
rnd = random.Random(1)
links = [(i, i + 1) for i in range(4000) if i % 40 != 39]
rnd.shuffle(links)
table = spark.createDataFrame(links, "a long, b long").repartition(6)
table.count()
killed = []

def strike():
    time.sleep(3)
    for p in psutil.Process().children(recursive=True):
        try:
            if any("CoarseGrainedExecutorBackend" in a for a in p.cmdline()):
                p.kill()
                killed.append(p.pid)
                return
        except psutil.Error:  # short-lived helpers of the JVM
            pass

threading.Thread(target=strike, daemon=True).start()
found = {}
for r in connected_components(table).collect():
    found.setdefault(r["root"], set()).add(r["node"])
assert sorted(map(sorted, found.values())) == [list(range(40 * c, 40 * c + 40)) for c in range(100)]
print("killed", len(killed))
spark.stop()
'''


def test_a_lost_executor(tmp_path):
    import pyspark

    home = tmp_path / "home"
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work in a folder of Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    (tmp_path / "script.py").write_text(SCRIPT)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_PYTHON": sys.executable}
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "script.py", root, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "killed 1" in done.stdout
