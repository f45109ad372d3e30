"""Executors of a cluster give their heaps back between steps, so that these don't add up."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

SCRIPT = """
import sys, time, psutil
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from colferry.scratch import Scratch

spark = SparkSession.builder.master("local-cluster[2,1,1200]").config("spark.executor.memory", "1000m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
rows = spark.range(0, 3_000_000, 1, 4).select((F.col("id") % 4).alias("k"), F.repeat(F.col("id").cast("string"), 20).alias("s"))
rows.groupBy("k").agg(F.collect_list("s").alias("s")).write.format("noop").mode("overwrite").save()

def held():
    own = [p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
    return sorted(p.memory_info().rss >> 20 for p in own)

before = held()
Scratch(spark).settle()
end = time.time() + 30
while sum(before) - sum(held()) < 600 and time.time() < end:  # a JVM gives memory back in the background
    time.sleep(0.5)
print("MB", *before, *held())
spark.stop()
"""


def test_settled_executors_shrink(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # logs of executors go there
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    env["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[2]), env.get("PYTHONPATH", "")])
    for name in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS"):
        env.pop(name, None)
    out = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=240)
    found = [line for line in out.stdout.splitlines() if line.startswith("MB ")]
    assert found, out.stderr[-3000:]
    a, b, c, d = map(int, found[0].split()[1:])
    assert a + b - c - d >= 600, found
