"""A snapshot table store on Parquet, merged on read.

``{root}/{table}/data/{commit}/*.parquet`` holds rows or keys that are gone,
``{root}/{table}/_meta/{n}.json`` a snapshot: schema, files with the range of
their keys, properties, parent and time.  A commit writes data, then its
snapshot file under a temporary name, and renames it, so a reader sees all of
a commit or none.

Tables are distributed by ranges of their key and sorted by it, so a look-up
by key opens only files whose range can hold one of the keys, and within them
the bloom filters and page statistics say more.  A merge rewrites nothing: it
adds the new rows and a list of the keys whose older rows are gone; reading
takes them into account.  What has gathered that way is folded into the files
it touches by ``compact``, which a merge calls once it exceeds a share of the
table.  A table may instead be split by the values of a column, each replaced
as a whole.  One writer at a time is assumed; a commit fails if the next
snapshot is already there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from osmlake.config import TableConfig

#: The commit that a row is from, and that a key was gone in.
SEQ, GONE_AT = "_seq", "_gone_at"
#: Lists of gone keys with up to so many rows (16 bytes each) are broadcast to the rows; longer ones are joined as Spark sees fit.
BROADCAST_ROWS = 4_000_000
#: A table is compacted when its merges hold this share of its rows, at least so many, or when there are so many of them.
COMPACT_SHARE, COMPACT_ROWS, COMPACT_COMMITS = 0.1, 200_000, 24
#: So few files are all opened by a look-up, without asking first which of them can hold its keys.
FEW_FILES = 6


class SnapshotStore:
    """Tables below one root folder, local or on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- files

    def _write_text(self, path: str, text: str) -> None:
        temporary = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        target = self._path(path)
        if self._fs.exists(target):
            raise RuntimeError(f"{path} was committed by another writer")
        out = self._fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(temporary, target):
            raise RuntimeError(f"{path} could not be committed")

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _versions(self, table: str) -> list[int]:
        folder = self._path(f"{self.root}/{table}/_meta")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def snapshot(self, table: str, version: int | None = None) -> dict:
        """The newest snapshot, or that of a version."""
        versions = self._versions(table)
        if not versions or version is not None and version not in versions:
            raise LookupError(f"no table {table}" + ("" if version is None else f" at version {version}"))
        return json.loads(self._read_text(f"{self.root}/{table}/_meta/{versions[-1] if version is None else version:010d}.json"))

    def _commit(self, table: str, parent: dict | None, **changes) -> dict:
        now = {**(parent or {}), **changes, "version": parent["version"] + 1 if parent else 0, "parent": parent["version"] if parent else None, "time": time.time()}
        self._write_text(f"{self.root}/{table}/_meta/{now['version']:010d}.json", json.dumps(now))
        return now

    # -- tables

    def exists(self, table: str) -> bool:
        return bool(self._versions(table))

    def drop(self, table: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{table}"), True)

    def create(self, table: str, schema: str, config: TableConfig | None = None, key: str | None = "id", partition: str | None = None, guard: str | None = None) -> None:
        """An empty table; one of that name is dropped first.

        ``key``: the column that files are distributed and sorted by.
        ``guard``: the column by which rows are replaced, the key unless given.
        ``partition``: instead, a column each of whose values is replaced as a whole.
        """
        self.drop(table)
        config = config or TableConfig()
        options = config.writer_options(key or partition)
        self._commit(
            table, None, schema=StructType.fromDDL(schema).jsonValue(), key=None if partition else key, guard=guard or key, partition=partition,
            parts=config.files, options=options, sort=config.sorted_files, data=[], gone=[], properties={}, operation="create",
        )

    def _schema(self, meta: dict) -> StructType:
        return StructType.fromJson(meta["schema"])

    def _frame(self, schema: StructType, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _load(self, meta: dict, entries: list[dict] | None = None) -> DataFrame:
        """The rows of some data files (all, if not given) that no later commit has taken away."""
        schema, guard = self._schema(meta), meta["guard"]
        entries = meta["data"] if entries is None else entries
        last = max((g["seq"] for g in meta["gone"]), default=-1)
        settled = self._frame(schema, [e["path"] for e in entries if e["seq"] >= last])
        by_seq: dict[int, list[str]] = {}
        for e in entries:
            if e["seq"] < last:
                by_seq.setdefault(e["seq"], []).append(e["path"])
        if not by_seq:
            return settled
        open_rows = reduce(DataFrame.union, [self._frame(schema, paths).withColumn(SEQ, F.lit(seq)) for seq, paths in by_seq.items()])
        kind = StructType([schema[guard]])
        lists = [self._frame(kind, [g["path"]]).withColumn(GONE_AT, F.lit(g["seq"])) for g in meta["gone"] if g["seq"] > min(by_seq)]
        gone = reduce(DataFrame.union, lists).groupBy(guard).agg(F.max(GONE_AT).alias(GONE_AT))
        if sum(g["rows"] for g in meta["gone"]) <= BROADCAST_ROWS:
            gone = F.broadcast(gone)
        gone = gone.withColumnRenamed(guard, "_gone_key")
        left = open_rows.join(gone, (F.col(guard) == F.col("_gone_key")) & (F.col(SEQ) < F.col(GONE_AT)), "left_anti").drop(SEQ)
        return left if len(by_seq) == len({e["seq"] for e in entries}) else left.union(settled)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table now, or as of a version."""
        return self._load(self.snapshot(table, version))

    def read_as_of(self, table: str, when: datetime) -> DataFrame:
        """The table as of a time (naive: UTC)."""
        at = (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp()
        for version in reversed(self._versions(table)):
            meta = self.snapshot(table, version)
            if meta["time"] <= at:
                return self._load(meta)
        raise LookupError(f"{table} has no snapshot at {when}")

    def touched(self, table: str, ids: DataFrame, version: int | None = None) -> list[dict]:
        """The data files whose range of keys holds one of the ids (one column); what it collects is at most one number a file."""
        return self._touched(self.snapshot(table, version)["data"], ids)

    def _touched(self, entries: list[dict], ids: DataFrame) -> list[dict]:
        if len(entries) <= FEW_FILES:
            return entries
        low, high = (np.array([e[k] for e in entries], np.int64) for k in ("lo", "hi"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = np.zeros(len(low), bool)
            for batch in batches:
                own = np.sort(batch.column(0).drop_null().to_numpy())
                met |= np.searchsorted(own, low, "left") < np.searchsorted(own, high, "right")
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(met), pa.int32())], ["k"])

        found = ids.select(F.col(ids.columns[0]).cast("long")).mapInArrow(run, "k int").distinct().collect()
        return [entries[k] for k in sorted(r.k for r in found)]

    def lookup(self, table: str, ids: DataFrame, version: int | None = None) -> DataFrame:
        """The rows whose key is among the ids (one column), read from the files that can hold them."""
        meta = self.snapshot(table, version)
        wanted = ids.select(F.col(ids.columns[0]).alias(meta["key"])).distinct()
        return self._load(meta, self._touched(meta["data"], wanted)).join(wanted, meta["key"], "left_semi")

    def history(self, table: str) -> list[dict]:
        """(version, parent, time, operation, properties) of all snapshots."""
        return [{k: self.snapshot(table, v).get(k) for k in ("version", "parent", "time", "operation", "properties")} for v in self._versions(table)]

    # -- writing

    def _rows(self, meta: dict, df: DataFrame) -> tuple[DataFrame, str]:
        """Rows in the table's types (or those of its columns that there are), and the column that they are sorted by."""
        schema = StructType([f for f in self._schema(meta).fields if f.name in df.columns])
        rows = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
        return rows, meta["key"] if meta["key"] in schema.names else schema.names[0]

    def _write(self, table: str, meta: dict, df: DataFrame, parts: int | None, finish: Callable[[DataFrame], DataFrame] | None = None) -> list[dict]:
        """Write a table's rows, distributed by range and sorted by key; what is known of each file.

        ``parts``: how many files, by their size unless given (adaptive
        execution joins small ranges).  ``finish``: what is done to every row
        after they are dealt out, so that drawing the ranges doesn't do it too.
        """
        key = meta["key"]
        rows = df.repartitionByRange(parts, key) if parts else df.repartitionByRange(key)
        rows, key = self._rows(meta, finish(rows) if finish else rows)
        path = f"{self.root}/{table}/data/{uuid.uuid4().hex}"
        (rows.sortWithinPartitions(key) if meta["sort"] else rows).write.options(**meta["options"]).parquet(path)
        stats = self._frame(rows.schema, [path]).groupBy(F.col("_metadata.file_path").alias("path"))
        return [r.asDict() for r in stats.agg(F.count("*").alias("rows"), *self._ends(rows, key)).collect()]  # at most one row a file

    def _write_some(self, table: str, meta: dict, df: DataFrame, stray=None) -> list[dict]:
        """Write what one commit adds, by the tasks that have the rows; one entry for all of it, counted while it is written.

        ``stray``: a condition that no row may meet.
        """
        rows, key = self._rows(meta, df)
        path, seen = f"{self.root}/{table}/data/{uuid.uuid4().hex}", Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.lit(False) if stray is None else stray, 1)).alias("stray"), *self._ends(rows, key))
        (rows.sortWithinPartitions(key) if meta["sort"] else rows).write.options(**meta["options"]).parquet(path)
        found = seen.get
        if found["stray"]:
            raise ValueError(f"{found['stray']} rows are outside their slot")
        return [{"path": path, "rows": found["rows"], "lo": found["lo"], "hi": found["hi"]}] if found["rows"] else []

    def _ends(self, rows: DataFrame, key: str) -> tuple:
        numeric = rows.schema[key].dataType.typeName() == "long"
        return (F.min(key).alias("lo"), F.max(key).alias("hi")) if numeric else (F.max(F.lit(None).cast("long")).alias("lo"), F.max(F.lit(None).cast("long")).alias("hi"))

    def _as(self, seq: int, found: list[dict], **more) -> list[dict]:
        return [{**f, "seq": seq, **more} for f in found]

    def append(self, table: str, df: DataFrame, finish: Callable[[DataFrame], DataFrame] | None = None, **properties) -> None:
        """More rows; ``finish`` turns them into those of the table, one by one."""
        meta = self.snapshot(table)
        new = self._as(meta["version"] + 1, self._write(table, meta, df, meta["parts"], finish))
        self._commit(table, meta, data=meta["data"] + new, properties=meta["properties"] | properties, operation="append")

    def overwrite(self, table: str, df: DataFrame, **properties) -> None:
        """All rows anew; the old snapshot stays readable."""
        meta = self.snapshot(table)
        new = self._as(meta["version"] + 1, self._write(table, meta, df, meta["parts"]))
        self._commit(table, meta, data=new, gone=[], properties=meta["properties"] | properties, operation="overwrite")

    def replace_slot(self, table: str, slot: str, df: DataFrame, **properties) -> None:
        """One value of the partition column anew: writing it twice leaves it as once.  Rows are written by the tasks that have them."""
        meta = self.snapshot(table)
        stray = ~F.coalesce(F.col(meta["partition"]).cast("string"), F.lit("null")).eqNullSafe(F.lit(slot))
        new = self._as(meta["version"] + 1, self._write_some(table, meta, df, stray), slot=slot)
        self._commit(table, meta, data=[e for e in meta["data"] if e.get("slot") != slot] + new, properties=meta["properties"] | properties, operation="replace")

    def merge(self, table: str, upserts: DataFrame, deletes: DataFrame, **properties) -> None:
        """Version-guarded upserts (one row for each id) and deletes, as ``operators.merge.merged`` has them.

        Only versions of the rows that the ids may have are read; what is
        written follows the source, not the table.
        """
        meta = self.snapshot(table)
        gone = deletes.select("id").distinct()
        source = upserts.join(gone, "id", "left_anti").where("version is not null")
        ids = source.select("id")
        stored = self._load(meta, self._touched(meta["data"], ids)).select("id", F.col("version").alias("_stored"), F.lit(True).alias("_there")).join(ids, "id", "left_semi")
        wins = F.col("_there").isNull() | F.coalesce(F.col("version") >= F.col("_stored"), F.lit(False))
        self._add(table, meta, source.join(stored, "id", "left").where(wins).drop("_stored", "_there"), gone, True, properties, "merge")

    def replace_edges(self, table: str, dirty_ids: DataFrame, edges: DataFrame, **properties) -> None:
        """The edges of dirty parents (the guard column) become ``edges``; nothing is read."""
        meta = self.snapshot(table)
        self._add(table, meta, edges, dirty_ids.select(F.col("id").alias(meta["guard"])).distinct(), False, properties, "refresh")

    def _add(self, table: str, meta: dict, rows: DataFrame, gone: DataFrame, replaces: bool, properties: dict, operation: str) -> None:
        """Commit rows and gone keys; ``replaces``: the rows' own keys are gone from older files too."""
        seq, guard = meta["version"] + 1, meta["guard"]
        new = self._write_some(table, meta, rows)
        lists = [gone.select(F.col(gone.columns[0]).alias(guard))]
        if replaces and new:
            lists.append(self._frame(self._schema(meta), [n["path"] for n in new]).select(guard))
        taken = self._write_some(table, meta, reduce(DataFrame.union, lists))
        meta = self._commit(
            table, meta, data=meta["data"] + self._as(seq, new), gone=meta["gone"] + self._as(seq, taken) if meta["data"] else [], properties=meta["properties"] | properties, operation=operation
        )
        base = min((e["seq"] for e in meta["data"]), default=0)
        held = sum(e["rows"] for e in meta["data"] if e["seq"] > base) + sum(g["rows"] for g in meta["gone"])
        whole = sum(e["rows"] for e in meta["data"])
        if held > max(COMPACT_ROWS, COMPACT_SHARE * whole) or len({e["seq"] for e in meta["data"]}) > COMPACT_COMMITS:
            self.compact(table)

    def compact(self, table: str) -> None:
        """Fold what merges have added into the files it touches; the others stay as they are.  The rows stay the same."""
        meta = self.snapshot(table)
        if not meta["gone"] and len({e["seq"] for e in meta["data"]}) <= 1:
            return
        base = min(e["seq"] for e in meta["data"])
        own, later = [e for e in meta["data"] if e["seq"] == base], [e for e in meta["data"] if e["seq"] != base]
        if meta["guard"] == meta["key"]:
            schema = StructType([self._schema(meta)[meta["key"]]])
            changed = self._frame(schema, [e["path"] for e in later + meta["gone"]])
            chosen = self._touched(own, changed)
        else:
            chosen = own  # the ranges of files say nothing of the parents that are gone
        kept = [e for e in own if e not in chosen]
        parts = meta["parts"] and max(1, meta["parts"] - len(kept))
        new = self._as(base, self._write(table, meta, self._load(meta, chosen + later), parts))
        self._commit(table, meta, data=kept + new, gone=[], operation="compact")

    # -- old snapshots

    def expire(self, table: str, keep: int = 1) -> int:
        """Forget all but the newest ``keep`` snapshots and remove files that none of those has; how many folders went.

        Folders that a run has written and never committed go as well, so no
        other writer may be at work.
        """
        versions = self._versions(table)
        for v in versions[: -max(1, keep)]:
            self._fs.delete(self._path(f"{self.root}/{table}/_meta/{v:010d}.json"), False)
        used = set()
        for v in versions[-max(1, keep) :]:
            meta = self.snapshot(table, v)
            used |= {e["path"].rpartition("/data/")[2].split("/")[0] for e in meta["data"] + meta["gone"]}
        folder, removed = self._path(f"{self.root}/{table}/data"), 0
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
            if status.getPath().getName() not in used:
                removed += bool(self._fs.delete(status.getPath(), True))
        return removed

    # -- properties

    def properties(self, table: str) -> dict:
        return self.snapshot(table)["properties"]

    def set_properties(self, table: str, **properties) -> None:
        meta = self.snapshot(table)
        self._commit(table, meta, properties=meta["properties"] | properties, operation="properties")
