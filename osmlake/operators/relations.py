"""Relation geometry: multipolygons, routes, sites, and collections as a fallback.

Members are exploded once and joined once to the ways, nodes and child
relations; what the families need is gathered by conditional aggregation.
Exploded members are never broadcast (``hint("merge")``): Spark estimates them
by the rows they come from, so millions can seem small enough for the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from osmlake.functions.geometry import geo
from osmlake.operators.nodes import no_changesets, own_changesets, typed_metadata

#: Fixed values: ``type`` tags by family.
POLYGON_TYPES = ("multipolygon", "boundary", "building", "bridge")
LINE_TYPES = ("route", "waterway")
COLLECTION_TYPES = ("site",)
GEOMETRY_TYPES = POLYGON_TYPES + LINE_TYPES + COLLECTION_TYPES
#: Roles that mean an outer ring, besides none.
OUTER_ROLES = ("outer", "outline", "part", "")


@dataclass(frozen=True)
class Rules:
    """Choices in how relations are built, where the plain rule loses something.

    ``require_closed``: rings count only if the union of their ways is closed
    part by part, so rings of several open ways fall through.
    ``polygon_parents_only``: sub-relations count for polygon parents only;
    else a parent of any type gets the polygons of its children, and where it
    has a shape of its own family as well, that of the polygons.
    ``member_timestamps``: ``latest_ts`` covers direct members, not the
    relation alone.
    """

    require_closed: bool = False
    polygon_parents_only: bool = True
    member_timestamps: bool = True


#: The plain rules: only closed unions, children for parents of any type, own timestamps.
PLAIN = Rules(require_closed=True, polygon_parents_only=False, member_timestamps=False)


def need_geometry(relations: DataFrame) -> DataFrame:
    """Relations of the seven types that get a geometry of their own."""
    return relations.where(F.col("tags")["type"].isin(*GEOMETRY_TYPES))


def normal_role(role: Column) -> Column:
    """inner, outer, or the role as it is (which polygons ignore)."""
    return F.when(role.isNull() | role.isin(*OUTER_ROLES), F.lit("outer")).otherwise(role)


def members(relations: DataFrame) -> DataFrame:
    """One row for each member: relation_id, kind, pos, member_type, ref, role."""
    return relations.select(F.col("id").alias("relation_id"), F.col("tags")["type"].alias("kind"), F.posexplode("members").alias("pos", "m")).select(
        "relation_id", "kind", "pos", F.col("m.type").alias("member_type"), F.col("m.ref").alias("ref"), F.col("m.role").alias("role")
    )


def _shapes(df: DataFrame) -> DataFrame:
    return df.where(F.col("geom").isNotNull() & ~geo("is_empty", "geom")).select(F.col("id").alias("ref"), "geom")


def build_relation_geometry(
    relations: DataFrame, ways: DataFrame, nodes: DataFrame | None = None, children: DataFrame | None = None, require_closed: bool = False, polygon_parents_only: bool = True
) -> DataFrame:
    """(id, geom) for relations of the three families.

    Polygons: outer area less inner area; only inner rings give the inner
    area.  Children of polygon parents that have a polygon of their own, in
    this batch or in ``children`` (id, geom), are collected with it.  Lines:
    the union of member ways, whatever their roles.  Collections: ways and
    nodes collected.  ``require_closed``: rings count only if their union is
    closed, so rings of several open ways fall through.
    ``polygon_parents_only=False``: parents of any type, also those of no
    family, take the polygons of their children.
    """
    batch = need_geometry(relations)
    parts = members(batch)
    ways_in = parts.where("member_type = 'way'").withColumn("role", normal_role(F.col("role"))).select("relation_id", "kind", "ref", "role").distinct()
    ways_in = ways_in.hint("merge").join(_shapes(ways), "ref")
    pick = lambda cond: F.collect_list(F.when(cond, F.col("geom")))
    kind = F.col("kind")
    gathered = ways_in.groupBy("relation_id").agg(
        F.first("kind").alias("kind"),
        pick(kind.isin(*POLYGON_TYPES) & (F.col("role") == "outer")).alias("outer"),
        pick(kind.isin(*POLYGON_TYPES) & (F.col("role") == "inner")).alias("inner"),
        pick(~kind.isin(*POLYGON_TYPES)).alias("any"),
    )
    own = gathered.select(
        "relation_id",
        geo("ring_area", "outer", "inner", F.lit(require_closed)).alias("polygon"),
        F.when(kind.isin(*LINE_TYPES), geo("union", "any")).alias("line"),
        F.when(kind.isin(*COLLECTION_TYPES), geo("union", "any")).alias("site_ways"),
    )
    polygons = own.where("polygon is not null").select(F.col("relation_id").alias("ref"), F.col("polygon").alias("geom"))
    if children is not None:
        stored = _shapes(children).join(batch.select(F.col("id").alias("ref")), "ref", "left_anti")
        polygons = polygons.unionByName(stored)
    parents = parts.where(kind.isin(*POLYGON_TYPES)) if polygon_parents_only else members(relations)
    nested = parents.where("member_type = 'relation'").select("relation_id", "ref").distinct().hint("merge").join(polygons, "ref")
    nested = nested.groupBy("relation_id").agg(geo("union", F.collect_list("geom")).alias("sub"))
    out = (batch if polygon_parents_only else relations).select(F.col("id").alias("relation_id")).join(own, "relation_id", "left").join(nested, "relation_id", "left")
    site = F.col("site_ways")
    if nodes is not None:
        points = parts.where((F.col("member_type") == "node") & kind.isin(*COLLECTION_TYPES)).select("relation_id", "ref").distinct().hint("merge").join(_shapes(nodes), "ref")
        out = out.join(points.groupBy("relation_id").agg(geo("union", F.collect_list("geom")).alias("site_nodes")), "relation_id", "left")
        site = F.when(F.col("site_ways").isNotNull() & F.col("site_nodes").isNotNull(), geo("collect", F.array("site_ways", "site_nodes"))).otherwise(F.coalesce("site_ways", "site_nodes"))
    polygon = F.when(F.col("polygon").isNotNull() & F.col("sub").isNotNull(), geo("collect", F.array("polygon", "sub"))).otherwise(F.coalesce("polygon", "sub"))
    return out.select(F.col("relation_id").alias("id"), F.coalesce(polygon, F.col("line"), site).alias("geom")).where("geom is not null")


def merge_relation_geometry(relations: DataFrame, geometry: DataFrame, ways: DataFrame | None = None, nodes: DataFrame | None = None, member_timestamps: bool = True) -> DataFrame:
    """All relations with their geometry, attribution and newest timestamp.

    Where ``ways`` are given, a relation of any type without geometry falls
    back to the union of its way and node members.  ``ways``/``nodes``: id,
    geom, changeset, latest_ts.  Changesets of direct way and node members
    that are above the relation's own are added.  ``member_timestamps``:
    ``latest_ts`` is the greatest over the relation and its direct members,
    else the relation's own timestamp.
    """
    base = relations.select(*typed_metadata(relations), "members", own_changesets(relations).alias("stored"))
    out = base.join(geometry.select("id", "geom"), "id", "left")
    known = [(kind, df) for kind, df in (("way", ways), ("node", nodes)) if df is not None]
    parts = members(relations).hint("merge").join(relations.select(F.col("id").alias("relation_id"), F.col("changeset").cast("bigint").alias("own")), "relation_id")
    gathered = None
    for kind, df in known:
        slim = df.select(F.col("id").alias("ref"), F.col("geom").alias("part"), F.col("changeset").alias("cs"), F.col("latest_ts").cast("timestamp").alias("ts"))
        rows = parts.where(F.col("member_type") == kind).select("relation_id", "own", "ref").distinct().hint("merge").join(slim, "ref")
        gathered = rows if gathered is None else gathered.unionByName(rows)
    if gathered is None:
        out = out.withColumns({"fallback": F.lit(None).cast("binary"), "newer": no_changesets(), "member_ts": F.lit(None).cast("timestamp")})
    else:
        bare = geometry.select(F.col("id").alias("relation_id"), F.lit(True).alias("has"))
        solid = F.col("has").isNull() & F.col("part").isNotNull()
        grouped = (
            gathered.join(bare, "relation_id", "left")
            .groupBy("relation_id")
            .agg(F.collect_list(F.when(solid, F.col("part"))).alias("parts"), F.collect_set(F.when(F.col("cs") > F.col("own"), F.col("cs"))).alias("newer"), F.max("ts").alias("member_ts"))
        )
        fallback = F.when(F.size("parts") > 0, geo("union", "parts")) if ways is not None else F.lit(None).cast("binary")
        out = out.join(grouped.select(F.col("relation_id").alias("id"), fallback.alias("fallback"), "newer", "member_ts"), "id", "left")
    ts = F.greatest("timestamp", "member_ts") if member_timestamps else F.col("timestamp")
    return out.select(
        *[c for c in base.columns if c != "stored"],
        ts.alias("latest_ts"),
        F.array_distinct(F.array_union("stored", F.coalesce("newer", no_changesets()))).alias("additional_changesets"),
        F.coalesce("geom", "fallback").alias("geom"),
    )
