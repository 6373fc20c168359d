"""Applying change files, one at a time, resumable at every commit.

Every table is committed together with its sequence stamp.  Which nodes moved
and which ways became dirty is written to staging tables before the table
they were found from changes, so a run that is resumed after any commit sees
the same sets.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.functions.geometry import register
from osmlake.operators import changes as ch
from osmlake.operators import dirty, edges
from osmlake.operators.finalize import finalize
from osmlake.operators.merge import merged
from osmlake.operators.nodes import build_node_geometry
from osmlake.operators.relations import POLYGON_TYPES
from osmlake.operators.ways import build_way_lines, promote_areas
from osmlake.plans.database import APPLIED, ARCHIVE, ARCHIVED, CURRENT, TYPED, Database
from osmlake.plans.initial_load import build_relations
from osmlake.sources.changes import read_changes, sequence_of
from osmlake.sources.files import Files
from osmlake.sources.replication import Server, next_change_file

log = logging.getLogger(__name__)


class SequenceGap(ValueError):
    """A change file isn't the next one."""


def archived(latest: DataFrame, sequence: int | None, name: str) -> DataFrame:
    """Rows of the archive for one file."""
    return latest.select(F.lit(sequence).cast("bigint").alias("sequence"), F.lit(name).alias("osc_file"), F.current_timestamp().alias("applied_at"), *[c for c in latest.columns if c != "latest_ts"])


class Staging:
    """Small tables that one file's sections hand on, kept until the file is done."""

    def __init__(self, db: Database, name: str):
        self.db, self.base = db, f"{db.store.root}/_staging/{name}"

    def keep(self, table: str, df: DataFrame) -> DataFrame:
        """Write once; a resumed run reads what the first one found."""
        path = f"{self.base}/{table}"
        done = self.db.store._path(f"{path}/_SUCCESS")
        if not self.db.store._fs.exists(done):
            df.write.mode("overwrite").parquet(path)
        return self.db.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        self.db.store._fs.delete(self.db.store._path(self.base), True)


def apply_records(db: Database, records: DataFrame, name: str, sequence: int | None, allow_gaps: bool = False, max_depth: int = 1) -> None:
    """Apply raw change records of one file.

    Tables already stamped with the sequence (or a later one) are left alone.
    Without a sequence nothing is stamped and a repeated run applies again,
    which the version guard makes harmless except in the archive.
    """
    register(db.spark)
    if sequence is None:
        log.warning("%s has no sequence number; nothing is stamped", name)
    stamps = {k: db.stamp(t) for k, t in TYPED.items()}
    known = [s for s in stamps.values() if s is not None]
    if sequence is not None and known and not allow_gaps and sequence > min(known) + 1:
        raise SequenceGap(f"sequence {sequence} doesn't follow {min(known)}")
    done = {k: sequence is not None and s is not None and s >= sequence for k, s in stamps.items()}
    was = db.stamp(ARCHIVE, ARCHIVED)
    staging = Staging(db, str(sequence) if sequence is not None else name.replace("/", "_"))
    if sequence is None:
        staging.clear()
    latest = staging.keep("latest", ch.dedup(records))
    if sequence is None:
        db.store.append(ARCHIVE, archived(latest, None, name), **{CURRENT: name})
    elif was is None or was < sequence:
        db.store.replace_slot(ARCHIVE, str(sequence), archived(latest, sequence, name), **{ARCHIVED: sequence, CURRENT: name})
    stamp = {} if sequence is None else {APPLIED: sequence}

    node_rows = ch.upserts(latest, "node")
    old_nodes = db.lookup("nodes", node_rows.select("id"))
    moved = staging.keep("moved_nodes", ch.classify_nodes(node_rows, old_nodes).where("moved").select("id"))
    if not done["node"]:
        carried = ch.carry_changesets(node_rows, old_nodes)
        new = staging.keep("nodes", finalize(build_node_geometry(carried), "node"))
        db.store.merge("nodes", new, ch.deletes(latest, "node"), **stamp)

    ways_of_moved = staging.keep("ways_of_moved", db.lookup("node_to_ways", moved))
    way_rows = ch.upserts(latest, "way")
    concerned = dirty.dirty_way_ids(moved, ways_of_moved).union(way_rows.select("id"))
    rows = staging.keep("dirty_ways", dirty.dirty_ways(db.lookup("ways", concerned), way_rows, moved, ways_of_moved))
    gone = ch.deletes(latest, "way")
    if not done["way"]:
        lines = build_way_lines(rows, db.lookup("nodes", rows.select(F.explode("refs").alias("id"))))
        new = staging.keep("ways", finalize(promote_areas(lines), "way"))
        _refresh(db, "node_to_ways", rows.select("id").union(gone), "ways", new, gone)
        db.store.merge("ways", new, gone, **stamp)

    gone = ch.deletes(latest, "relation")
    if not done["relation"]:
        changed = ch.upserts(latest, "relation")
        near = staging.keep("dirty_relation_ids", _dirty_relation_ids(db, changed, rows, moved, max_depth))
        stored = db.lookup("relations", near.union(changed.select("id")))
        rows = staging.keep("dirty_relations", dirty.widened(stored, changed, near, "members"))
        used = rows.select(F.explode("members").alias("m"))
        of = lambda kind: used.where(F.col("m.type") == kind).select(F.col("m.ref").alias("id"))
        children = db.lookup("relations", of("relation")).join(rows.select("id"), "id", "left_anti").where(F.col("tags")["type"].isin(*POLYGON_TYPES))
        children = children.select("id", F.col("geometry").alias("geom"))
        new = staging.keep("relations", build_relations(rows, db.with_geom("way", of("way")), db.with_geom("node", of("node")), children, db.rules))
        touched = rows.select("id").union(gone)
        for edge in ("way_to_relations", "node_to_relations", "relation_to_relations"):
            _refresh(db, edge, touched, "relations", new, gone)
        db.store.merge("relations", new, gone, **stamp)
    staging.clear()


def _dirty_relation_ids(db: Database, changed: DataFrame, ways: DataFrame, moved: DataFrame, max_depth: int) -> DataFrame:
    """Ids of relations that depend on something changed, by look-ups in the edge tables, a level of parents at a time."""
    found = dirty.dirty_relation_ids(changed, ways, db.lookup("way_to_relations", ways.select("id")), moved, db.lookup("node_to_relations", moved))
    level = changed.select("id")
    for _ in range(max_depth):
        level = db.lookup("relation_to_relations", level).select(F.col("parent_relation_id").alias("id")).distinct()
        found = found.union(level)
    return found.distinct()


def _refresh(db: Database, name: str, touched: DataFrame, parents: str, new: DataFrame, gone: DataFrame) -> None:
    """Edges of touched parents as they will be after the merge; doing it twice leaves them as once.

    It comes before the merge: stamped parents always have their edges.
    """
    derive, _, _ = edges.DERIVED[name]
    after = merged(db.lookup(parents, touched), new, gone)
    db.store.replace_edges(name, touched, derive(after))


def apply_change_file(db: Database, path: str, allow_gaps: bool = False, max_depth: int = 1) -> None:
    """Apply one change file."""
    apply_records(db, read_changes(db.spark, path), path.rsplit("/", 1)[-1], sequence_of(path), allow_gaps, max_depth)


def apply_next(db: Database, server: Server, folder: str, keep_file: bool = True) -> str | None:
    """Fetch and apply the next pending file; its path, or None when up to date.

    ``folder``: where fetched files go, on a file system that the executors
    share.  ``keep_file=False`` removes the file once it is applied.
    """
    applied = db.min_applied()
    path = next_change_file(server, folder, applied, db.max_timestamp() if applied is None else None)
    if path is not None:
        apply_change_file(db, path)
        if not keep_file:
            Files(db.spark).remove(path)
    return path


def apply_all(db: Database, server: Server, folder: str) -> list[str]:
    """Apply pending files one by one until none is left."""
    applied = []
    while (path := apply_next(db, server, folder)) is not None:
        applied.append(path)
    return applied
