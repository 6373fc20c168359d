"""The geometry functions where Spark's Python files come from an archive, as under spark-submit."""

import os
import subprocess
import sys
import zipfile
from pathlib import Path

import pyspark

SCRIPT = """
import pyspark
assert ".zip" in pyspark.__file__, pyspark.__file__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from osmlake.functions.geometry import register
register(spark)
print("found", spark.sql("select geo_as_wkt(geo_point(1.5D, 2D)) w from range(1)").first().w)
"""


def test_functions_with_spark_from_a_zip(tmp_path):
    home = Path(pyspark.__file__).parent
    archive = tmp_path / "pyspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in home.rglob("*"):
            if f.suffix in (".py", ".json", ".typed") and not f.relative_to(home).parts[0] in ("jars", "examples", "tests"):
                z.write(f, f"pyspark/{f.relative_to(home)}")
    (tmp_path / "tmp").mkdir()
    env = os.environ | {"PYTHONPATH": f"{archive}:{Path(__file__).resolve().parents[1]}", "SPARK_HOME": str(home), "TMPDIR": str(tmp_path / "tmp"), "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "found POINT (1.5 2)" in done.stdout, done.stderr[-3000:]
    assert not list((tmp_path / "tmp").glob("osmlake-geo-*"))
