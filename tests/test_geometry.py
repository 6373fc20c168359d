"""Hand-computed shapes through the geometry functions and the way and relation operators."""

import pytest
from pyspark.sql import functions as F

from osmlake import schemas
from osmlake.functions.geometry import geo, register
from osmlake.operators.finalize import finalize
from osmlake.operators.nodes import build_node_geometry
from osmlake.operators.relations import build_relation_geometry, merge_relation_geometry
from osmlake.operators.ways import build_way_lines, flatten_refs, is_area, promote_areas

T = "2024-01-01 00:00:00"
#: id -> (x, y)
POINTS = {1: (0, 0), 2: (1, 0), 3: (1, 1), 4: (0, 1), 11: (0, 0), 12: (4, 0), 13: (4, 4), 14: (0, 4), 21: (1, 1), 22: (3, 1), 23: (3, 3), 24: (1, 3), 50: (9, 9)}
WAYS = {
    1: ([1, 2], {}),
    2: ([1, 99], {}),
    3: ([1, 2, 3, 4, 1], {"building": "yes"}),
    4: ([1, 2, 3, 4, 1], {"building": "yes", "area": "no"}),
    5: ([1, 2, 3, 4, 1], {"boundary": "place"}),
    6: ([1, 2, 3, 4, 1], {"leisure": "track"}),
    7: ([1, 2, 3, 4, 1], {"area:highway": "x"}),
    8: ([1, 2, 1], {"building": "yes"}),
    10: ([11, 12, 13, 14, 11], {}),
    20: ([21, 22, 23, 24, 21], {}),
    31: ([1, 2, 3], {}),
    32: ([3, 4, 1], {}),
    40: ([1, 3, 2, 4, 1], {"building": "yes"}),
}
RELATIONS = {
    100: ("multipolygon", [("way", 10, "outer"), ("way", 20, "inner")]),
    101: ("multipolygon", [("way", 20, "inner")]),
    102: ("boundary", [("way", 31, "outline"), ("way", 32, None)]),
    103: ("multipolygon", [("way", 10, "label")]),
    104: ("route", [("way", 31, "inner"), ("way", 10, "outer")]),
    105: ("site", [("way", 31, ""), ("node", 50, "")]),
    106: ("restriction", [("way", 31, "from"), ("node", 50, "via")]),
    107: ("multipolygon", [("way", 3, "part"), ("relation", 100, "")]),
    108: ("restriction", []),
}


@pytest.fixture(scope="module")
def graph(spark):
    register(spark)
    meta = "version bigint, timestamp string, changeset bigint, uid bigint, user string, tags map<string,string>"
    nodes = spark.createDataFrame([(i, 1, T, 5, 1, "u", {}, float(y), float(x)) for i, (x, y) in POINTS.items()] + [(77, 1, T, 5, 1, "u", {}, None, 3.0)], f"id bigint, {meta}, lat double, lon double")
    ways = spark.createDataFrame([(i, 1, T, 3, 1, "u", tags, refs) for i, (refs, tags) in WAYS.items()], f"id bigint, {meta}, refs array<bigint>")
    relations = spark.createDataFrame([(i, 1, T, 4, 1, "u", {"type": k}, m) for i, (k, m) in RELATIONS.items()], f"id bigint, {meta}, members {schemas.MEMBERS}")
    points = build_node_geometry(nodes)
    lines = promote_areas(build_way_lines(ways, points)).cache()
    return points, lines, relations


def test_nodes_without_a_coordinate_are_dropped(graph):
    rows = {r.id: r.wkt for r in graph[0].select("id", geo("as_wkt", "geom").alias("wkt")).collect()}
    assert 77 not in rows and rows[13] == "POINT (4 4)"


def test_ways_are_lines_or_areas(graph):
    rows = {r.id: (r.t, r.a) for r in graph[1].select("id", geo("type", "geom").alias("t"), geo("area", "geom").alias("a")).collect()}
    assert rows[1] == ("ST_LineString", 0) and rows[2] == (None, None)
    assert rows[3] == ("ST_Polygon", 1) and rows[7][0] == "ST_Polygon"
    assert {rows[k][0] for k in (4, 5, 6, 8, 10)} == {"ST_LineString"}


def test_finalize_drops_unresolved_ways_and_cleans(graph):
    rows = {r.id: r for r in finalize(graph[1], "way").select("id", "bbox", "additional_changesets", geo("is_valid", "geometry").alias("valid"), geo("same", geo("clean", "geometry"), F.col("geometry")).alias("same")).collect()}
    assert 2 not in rows and all(r.valid and r.same for r in rows.values())
    assert tuple(rows[1].bbox) == (0, 1, 0, 0) and rows[1].additional_changesets == [5]
    with pytest.raises(ValueError):
        finalize(graph[1], "area")


def test_unique_by_id_takes_the_highest_version(graph):
    twice = graph[0].unionByName(graph[0].withColumn("version", F.lit(9).cast("bigint")))
    assert {r.version for r in finalize(twice, "node").collect()} == {9} and finalize(twice, "node").count() == len(POINTS)


def test_relation_families(graph):
    points, lines, relations = graph
    shapes = build_relation_geometry(relations, lines, points)
    rows = {r.id: r for r in merge_relation_geometry(relations, shapes, lines, points).select("id", geo("type", "geom").alias("t"), geo("area", "geom").alias("a"), geo("num_holes", "geom").alias("h"), "additional_changesets", "latest_ts").collect()}
    assert (rows[100].a, rows[100].h) == (12, 1) and rows[101].a == 4 and rows[102].a == 1
    assert rows[103].t == "ST_LineString"  # its role is ignored by polygons, so it falls back
    assert rows[104].t == "ST_MultiLineString" and rows[105].t == "ST_GeometryCollection" and rows[106].t == "ST_GeometryCollection"
    assert rows[107].a == 13 and rows[108].t is None and rows[106].additional_changesets == [5]


def test_require_closed_drops_rings_of_open_ways(graph):
    points, lines, relations = graph
    found = {r.id for r in build_relation_geometry(relations, lines, points, require_closed=True).collect()}
    assert 100 in found and 102 not in found


def test_children_of_other_batches_count(graph):
    points, lines, relations = graph
    stored = build_relation_geometry(relations.where("id = 100"), lines)
    alone = build_relation_geometry(relations.where("id = 107"), lines, points, children=stored)
    assert alone.select(geo("area", "geom")).first()[0] == 13


def test_area_tags_and_null_tags(spark):
    rows = spark.createDataFrame([(1, None), (2, {}), (3, {"shop": "x"}), (4, {"boundary": "place", "area:x": "y"})], "id int, tags map<string,string>")
    assert [r[0] for r in rows.orderBy("id").select(is_area(F.col("tags"))).collect()] == [False, False, True, True]


def test_flatten_refs_and_empty_tables(spark, graph):
    raw = spark.createDataFrame([(1, [(4,), (5,)])], "id bigint, nds array<struct<ref:bigint>>")
    assert flatten_refs(raw).first().asDict() == {"id": 1, "refs": [4, 5], "additional_changesets": []}
    points, lines, relations = graph
    assert build_relation_geometry(relations.limit(0), lines, points).count() == 0


def test_null_and_geojson(spark, graph):
    row = spark.sql("select geo_union(array(cast(null as binary))) u, geo_clean(cast(null as binary)) c, geo_as_geojson(geo_point(1.5D, -2D)) j, geo_envelope(geo_point(1D, 2D)) e").first()
    assert row.u is None and row.c is None and row.j == '{"type":"Point","coordinates":[1.5,-2]}' and row.e == [1, 1, 2, 2]


def test_union_of_invalid_polygons_falls_back(graph):
    bow = graph[1].where("id in (3, 40)").agg(geo("union", F.collect_list("geom")).alias("g")).select(geo("is_valid", "g"), geo("is_empty", "g")).first()
    assert bow[0] and not bow[1]
