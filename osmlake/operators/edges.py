"""Reverse-index edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.operators.relations import need_geometry


def node_to_ways(ways: DataFrame) -> DataFrame:
    """(node_id, way_id) for every reference; a closed way gives its first node twice."""
    return ways.select(F.explode("refs").alias("node_id"), F.col("id").alias("way_id"))


def _by_member(relations: DataFrame, kind: str, child: str, parent: str) -> DataFrame:
    return relations.select(F.col("id").alias(parent), F.explode("members").alias("m")).where(F.col("m.type") == kind).select(F.col("m.ref").alias(child), parent)


def way_to_relations(relations: DataFrame, all_types: bool = False) -> DataFrame:
    """(way_id, relation_id); of the seven geometry types only, unless ``all_types``."""
    return _by_member(relations if all_types else need_geometry(relations), "way", "way_id", "relation_id")


def node_to_relations(relations: DataFrame) -> DataFrame:
    return _by_member(relations, "node", "node_id", "relation_id")


def relation_to_relations(relations: DataFrame) -> DataFrame:
    return _by_member(relations, "relation", "child_relation_id", "parent_relation_id")


#: Edge table -> (how it derives from parents, its parent column, the parents' kind).
DERIVED = {
    "node_to_ways": (node_to_ways, "way_id", "way"),
    "way_to_relations": (way_to_relations, "relation_id", "relation"),
    "node_to_relations": (node_to_relations, "relation_id", "relation"),
    "relation_to_relations": (relation_to_relations, "parent_relation_id", "relation"),
}


def refresh(edges: DataFrame, parents: DataFrame, dirty_ids: DataFrame, name: str) -> DataFrame:
    """The edge table after its dirty parents' edges are replaced by those they now have.

    ``parents``: the parent table as it is now; a deleted parent has no edges.
    """
    derive, column, _ = DERIVED[name]
    ids = dirty_ids.select("id").distinct()
    kept = edges.join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*edges.columns)
    return kept.unionByName(derive(parents.join(ids, "id", "left_semi")))
