"""Which ways and relations a change file makes dirty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.operators.changes import carry_changesets

_META = ["version", "timestamp", "uid", "user", "changeset", "tags"]


def widened(base: DataFrame, direct: DataFrame, ids: DataFrame, own: str) -> DataFrame:
    """Direct changes, with the history stored for them, and stored rows of the other ids."""
    columns = ["id", *_META, own, "additional_changesets"]
    stored = base.join(ids.union(direct.select("id")).distinct(), "id", "left_semi").select(*columns)
    changed = carry_changesets(direct, stored).select(*columns)
    return changed.unionByName(stored.join(direct.select("id"), "id", "left_anti"))


def dirty_way_ids(moved_nodes: DataFrame, node_to_ways: DataFrame) -> DataFrame:
    """Ids of the ways that refer to a moved node."""
    return node_to_ways.join(moved_nodes.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi").select(F.col("way_id").alias("id")).distinct()


def dirty_ways(base_ways: DataFrame, way_upserts: DataFrame, moved_nodes: DataFrame, node_to_ways: DataFrame) -> DataFrame:
    """Changed ways, and stored ways one of whose nodes moved."""
    return widened(base_ways, way_upserts, dirty_way_ids(moved_nodes, node_to_ways), "refs")


def dirty_relation_ids(
    changed_relations: DataFrame,
    dirty_way_rows: DataFrame,
    way_to_relations: DataFrame,
    moved_nodes: DataFrame | None = None,
    node_to_relations: DataFrame | None = None,
    relation_to_relations: DataFrame | None = None,
    max_depth: int = 1,
) -> DataFrame:
    """Ids of relations with a dirty way, a moved node, or a changed child (``max_depth`` levels up)."""
    found = [way_to_relations.join(dirty_way_rows.select(F.col("id").alias("way_id")).distinct(), "way_id", "left_semi").select(F.col("relation_id").alias("id"))]
    if moved_nodes is not None and node_to_relations is not None:
        found.append(node_to_relations.join(moved_nodes.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi").select(F.col("relation_id").alias("id")))
    level = changed_relations.select("id").distinct()
    for _ in range(max_depth if relation_to_relations is not None else 0):
        level = relation_to_relations.join(level.select(F.col("id").alias("child_relation_id")), "child_relation_id", "left_semi").select(F.col("parent_relation_id").alias("id")).distinct()
        found.append(level)
    return reduce(DataFrame.union, found).distinct()


def dirty_relations(
    base_relations: DataFrame,
    relation_upserts: DataFrame,
    dirty_way_rows: DataFrame,
    way_to_relations: DataFrame,
    moved_nodes: DataFrame | None = None,
    node_to_relations: DataFrame | None = None,
    relation_to_relations: DataFrame | None = None,
    max_depth: int = 1,
) -> DataFrame:
    """Changed relations, and stored relations that depend on something changed."""
    ids = dirty_relation_ids(relation_upserts, dirty_way_rows, way_to_relations, moved_nodes, node_to_relations, relation_to_relations, max_depth)
    return widened(base_relations, relation_upserts, ids, "members")
