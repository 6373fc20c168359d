"""Geometry functions on WKB columns, run in the JVM by a small jar that is built against Spark's own JTS."""

from __future__ import annotations

import atexit
import os
import shutil
import subprocess
import tempfile
import uuid
import zipfile
from importlib import resources
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: SQL name -> (class, result type).
FUNCTIONS = {
    "geo_point": ("Point_", "binary"),
    "geo_line": ("Line", "binary"),
    "geo_make_polygon": ("MakePolygon", "binary"),
    "geo_union": ("Union", "binary"),
    "geo_build_area": ("BuildArea", "binary"),
    "geo_ring_area": ("RingArea", "binary"),
    "geo_difference": ("Difference", "binary"),
    "geo_collect": ("Collect", "binary"),
    "geo_clean": ("Clean", "binary"),
    "geo_clean_relation": ("CleanRelation", "binary"),
    "geo_simplify": ("Simplify", "binary"),
    "geo_same": ("Same", "boolean"),
    "geo_is_empty": ("IsEmpty", "boolean"),
    "geo_is_valid": ("IsValid", "boolean"),
    "geo_is_closed": ("IsClosed", "boolean"),
    "geo_type": ("Type", "string"),
    "geo_num_points": ("NumPoints", "int"),
    "geo_num_parts": ("NumParts", "int"),
    "geo_num_holes": ("NumHoles", "int"),
    "geo_area": ("Area", "double"),
    "geo_length": ("Length", "double"),
    "geo_envelope": ("Envelope_", "array<double>"),
    "geo_as_wkt": ("Wkt", "string"),
    "geo_as_geojson": ("GeoJson", "string"),
}


#: The jar that this process has built, by nothing else than its source.
_BUILT: dict[str, str] = {}
#: Classes whose jars the source is compiled against.
_NEEDED = ("org.locationtech.jts.geom.Geometry", "org.apache.spark.sql.api.java.UDF1", "scala.collection.Seq")


def class_path(spark: SparkSession) -> str:
    """The jars that the driver's own JVM runs with, wherever Spark was started from."""
    lang = spark._jvm.java.lang
    loader = lang.Thread.currentThread().getContextClassLoader()
    own = [lang.Class.forName(c, False, loader).getProtectionDomain().getCodeSource().getLocation().getPath() for c in _NEEDED]
    return os.pathsep.join(dict.fromkeys(own + lang.System.getProperty("java.class.path").split(os.pathsep)))


def build_jar(spark: SparkSession) -> str:
    """The jar's path on the driver: compiled once in a process, in a private folder that goes with it.

    The compiler is that of the driver's Java, or the one on the path; executors need none.
    """
    if "jar" not in _BUILT:
        work = str(Path(tempfile.mkdtemp(prefix="osmlake-geo-")).resolve())
        atexit.register(shutil.rmtree, work, ignore_errors=True)
        own = Path(spark._jvm.java.lang.System.getProperty("java.home"), "bin", "javac")
        command = [str(own) if own.exists() else "javac", "-nowarn", "-proc:none", "-cp", class_path(spark), "-d", f"{work}/classes", str(_source(work))]
        done = subprocess.run(command, capture_output=True, text=True)
        if done.returncode:
            raise RuntimeError(f"the geometry functions could not be compiled:\n{done.stderr or done.stdout}")
        target = f"{work}/osmlake-geo-{uuid.uuid4().hex}.jar"
        with zipfile.ZipFile(target, "w") as jar:
            for f in sorted(Path(work, "classes").rglob("*.class")):
                jar.write(f, f.relative_to(f"{work}/classes"))
        _BUILT["jar"] = target
    return _BUILT["jar"]


def _source(work: str) -> Path:
    """The source as a file, also where this package itself is read from an archive."""
    target = Path(work, "Geo.java")
    target.write_bytes(resources.files("osmlake.functions").joinpath("java/Geo.java").read_bytes())
    return target


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; Spark ships the jar to the executors.  Repeated calls do nothing."""
    if spark.catalog.functionExists("geo_union"):
        return
    spark.sql(f"ADD JAR '{build_jar(spark)}'")
    for name, (cls, kind) in FUNCTIONS.items():
        spark.udf.registerJavaFunction(name, f"osmlake.Geo${cls}", kind)


def geo(name: str, *columns) -> Column:
    """Call of one of the functions; the session must be registered."""
    return F.call_function(f"geo_{name}", *(F.col(c) if isinstance(c, str) else c for c in columns))
