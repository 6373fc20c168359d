"""Files on any file system that Spark reaches, from the driver."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable

from pyspark.sql import SparkSession

#: Bytes that go to the JVM at once.
CHUNK = 4 << 20


class Files:
    """The files below Hadoop paths of any scheme."""

    def __init__(self, spark: SparkSession):
        self._path, self._conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self._copy = spark._jvm.org.apache.commons.io.IOUtils.toByteArray

    def _at(self, path: str):
        target = self._path(path)
        return target.getFileSystem(self._conf), target

    def exists(self, path: str) -> bool:
        store, target = self._at(path)
        return bool(store.exists(target))

    def remove(self, path: str) -> None:
        store, target = self._at(path)
        store.delete(target, True)

    def names(self, folder: str) -> list[str]:
        store, target = self._at(folder)
        return sorted(s.getPath().getName() for s in store.listStatus(target)) if store.exists(target) else []

    def read(self, path: str) -> bytes:
        store, target = self._at(path)
        stream = store.open(target)
        try:
            return bytes(self._copy(stream))
        finally:
            stream.close()

    def write(self, path: str, blocks: Iterable[bytes]) -> None:
        """A whole file or none: it is written under another name and then renamed."""
        store, target = self._at(path)
        part = self._path(f"{path}.{uuid.uuid4().hex}.part")
        out = store.create(part, True)
        try:
            for block in blocks:
                for k in range(0, len(block), CHUNK):
                    out.write(bytearray(block[k : k + CHUNK]))
        finally:
            out.close()
        if not store.rename(part, target):
            store.delete(part, False)
            raise OSError(f"{path} could not be written")


def write_stream(spark: SparkSession, path: str, blocks: Iterable[bytes], compress: bool = False) -> None:
    """Write blocks to a file, gathered into larger ones and gzipped on the way if asked."""

    def gathered() -> Iterable[bytes]:
        coder = zlib.compressobj(6, zlib.DEFLATED, 31) if compress else None
        held, size = [], 0
        for block in blocks:
            held.append(coder.compress(block) if coder else block)
            size += len(held[-1])
            if size >= CHUNK:
                yield b"".join(held)
                held, size = [], 0
        yield b"".join(held) + (coder.flush() if coder else b"")

    Files(spark).write(path, gathered())


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which a cluster must name; one process without it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="osmlake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
