"""Where jobs of this subpackage keep intermediate tables, and how large inputs are."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A plan's own size figure beyond this is a default, not a measurement.
_UNKNOWN = 1 << 55


#: Folders and tables that this process has made, until ``release``.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see, under ``spark.checkpoint.dir``.

    Where that is unset, a session that runs in one process (``local``) gets a
    temporary folder of its own; on a cluster that is an error, as executors
    wouldn't see the driver's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    _MADE.append(f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}")
    return _MADE[-1]


def block_table_name() -> str:
    """A fresh name for a table in the catalog."""
    _MADE.append(f"llm_blocks_{uuid.uuid4().hex}")
    return _MADE[-1]


def release(spark: SparkSession) -> None:
    """Drop the tables and folders that the operators of this process have left; results not yet written are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    while _MADE:
        name = _MADE.pop()
        if "/" not in name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            continue
        folder = path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def neutral(df: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """``df`` with all columns but ``kept`` renamed by position, so that none clashes; ``toDF`` with the old names undoes it."""
    return df.toDF(*(c if c in kept else f"column{k}" for k, c in enumerate(df.columns)))


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write a table into the shared folder and read it back: a lineage cut that survives lost executors."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """About how many bytes a table has, from the plan's statistics, else counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= _UNKNOWN:
        widths = [F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
        size = df.select(F.sum(sum(widths, F.lit(0)).cast("long"))).first()[0] or 0
    return max(size, 1)


def partitions(df: DataFrame, bytes_each: int) -> int:
    """A partition count that grows with the input, not below the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // bytes_each))


def fold(column: str, modulus: int):
    """``crc32(column as text) mod modulus``; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """At most ``size`` rows, in a fixed pseudo-random order of their keys.

    A threshold on the keys' hash, from the count of all rows, leaves about
    four times as many before they are ordered, so what reaches the driver
    doesn't grow with the table.
    """
    rank = F.xxhash64(*(F.col(k).cast("string") for k in keys), F.lit("sample"))
    share = min(1.0, 4 * size / max(1, df.count()))
    near = df if share == 1 else df.where(F.pmod(rank, F.lit(1 << 30)) < int(share * (1 << 30)))
    return near.orderBy(rank, *keys).limit(size)
