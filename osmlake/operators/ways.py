"""Way geometry: ordered lines from node references, and areas from closed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from osmlake.functions.geometry import geo
from osmlake.functions.native import is_closed, snapped
from osmlake.operators.nodes import no_changesets, own_changesets, typed_metadata

#: Tag keys that make a closed way an area.
AREA_KEYS = (
    "aeroway", "amenity", "building", "building:part", "golf", "harbour", "historic", "landuse", "man_made", "military", "natural",
    "office", "place", "power", "public_transport", "shop", "sport", "tourism", "water", "waterway", "wetland", "area",
)
#: Keys that make an area unless they have this value, and a prefix of keys that do.
AREA_UNLESS = {"boundary": "place", "leisure": "track"}
AREA_PREFIX = "area:"


def flatten_refs(raw: DataFrame) -> DataFrame:
    """``nds array<struct<ref>>`` becomes ``refs array<bigint>``."""
    return raw.withColumn("refs", F.transform("nds", lambda n: n["ref"])).withColumn("additional_changesets", own_changesets(raw)).drop("nds")


def build_way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """A line for each way from its nodes in order; null below two resolved positions.

    ``nodes``: id, lat, lon, latest_ts, changeset.  ``points`` are the resolved
    positions.  ``latest_ts`` is the greatest of the way's own timestamp and
    those of its nodes; ``additional_changesets`` adds the nodes' changesets
    that are above the way's own.  One shuffle joins references to nodes, a
    second gathers them by way; both hold only narrow rows.  Neither side is
    broadcast: Spark's estimate of exploded rows is that of the rows before.
    """
    refs = ways.select(F.col("id").alias("way_id"), F.col("changeset").cast("bigint").alias("own"), F.posexplode("refs").alias("pos", "node_id"))
    slim = nodes.select(
        F.col("id").alias("node_id"),
        snapped(F.col("lon")).alias("x"),
        snapped(F.col("lat")).alias("y"),
        F.col("latest_ts").cast("timestamp").alias("node_ts"),
        F.col("changeset").alias("node_changeset"),
    ).where("x is not null and y is not null")
    gathered = (
        refs.hint("merge").join(slim, "node_id")
        .groupBy("way_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("at"),
            F.max("node_ts").alias("node_ts"),
            F.collect_set(F.when(F.col("node_changeset") > F.col("own"), F.col("node_changeset"))).alias("newer"),
        )
    )
    points = F.transform("at", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    meta = ways.select(*typed_metadata(ways), "refs", own_changesets(ways).alias("additional_changesets"))
    joined = meta.hint("merge").join(gathered.select(F.col("way_id").alias("id"), points.alias("points"), "node_ts", "newer"), "id", "left")
    line = geo("line", F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"]))
    return joined.select(
        *meta.drop("additional_changesets").columns,
        F.greatest("timestamp", "node_ts").alias("latest_ts"),
        F.array_distinct(F.array_union("additional_changesets", F.coalesce("newer", no_changesets()))).alias("additional_changesets"),
        "points",
        F.when(F.size("points") >= 2, line).alias("geom"),
    )


def is_area(tags: Column) -> Column:
    """Whether tags say that a closed way is an area (never null)."""
    known = [tags[k].isNotNull() for k in AREA_KEYS]
    known += [tags[k].isNotNull() & (tags[k] != value) for k, value in AREA_UNLESS.items()]
    any_key = known[0]
    for k in known[1:]:
        any_key = any_key | k
    return F.coalesce(any_key | F.exists(F.map_keys(tags), lambda k: k.startswith(AREA_PREFIX)), F.lit(False))


def promotes(points: Column, tags: Column) -> Column:
    """Whether a way becomes a polygon: over three points, closed, area tags, and area isn't 'no'."""
    return (F.size(points) > 3) & is_closed(points) & is_area(tags) & (F.coalesce(tags["area"], F.lit("")) != "no")


def promote_areas(lines: DataFrame) -> DataFrame:
    """Closed ways with area tags become counter-clockwise polygons; all else stays a line."""
    polygon = F.when(F.col("geom").isNotNull() & promotes(F.col("points"), F.col("tags")), geo("make_polygon", "geom"))
    return lines.withColumn("geom", F.coalesce(polygon, F.col("geom")))
