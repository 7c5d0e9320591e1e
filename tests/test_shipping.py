import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "700m").getOrCreate()
from kindred.plans import registry
print("ROWS", registry.QUERIES["fuzzy_osa"](spark, "/root/testdata/sf0.001").count(), registry.QUERIES["embed_custom_metric"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_have_the_package_from_any_folder(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13"}
    import pyspark

    home = tmp_path / "home"  # where the workers write their logs
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env["SPARK_HOME"] = str(home)
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
