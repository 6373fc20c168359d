"""The registered queries of the engine, each with its DuckDB equivalent where SQL can say it.

Arrays are returned as joined strings and timestamps as text, so that values
compare alike in any engine.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from osmlake.config import TableConfig
from osmlake.functions import native
from osmlake.functions.geometry import geo, register
from osmlake.operators import changes as ch
from osmlake.operators import dirty, edges
from osmlake.operators import relations as rel
from osmlake.operators import ways as wy
from osmlake.operators.finalize import finalize, unique_by_id
from osmlake.operators.merge import merged
from osmlake.operators.nodes import build_node_geometry
from osmlake.plans import inspect
from osmlake.plans.apply import apply_all, archived
from osmlake.plans.database import TABLES, TYPED, Database
from osmlake.plans.initial_load import build_relations, initialise
from osmlake.schemas import KINDS
from osmlake.sources import synthetic as syn
from osmlake.sources.changes import read_changes, write_changes
from osmlake.sources.files import Files, workspace
from osmlake.sources.replication import SharedServer, State, fetch_change_files, pending_sequences, state_text
from osmlake.streaming.feed import start, start_merges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True) -> Callable[[Query], Query]:
    """Register a query by its function's name; ``sql`` may use the tables of ``syn.SQL``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"with {syn.SQL} {sql}" if graph else sql
        return f

    return add


def _text(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _joined(values: str | Column) -> Column:
    return F.array_join(F.transform(F.sort_array(values), lambda x: x.cast("string")), ",")


_JOINED = "coalesce(array_to_string(list_sort(list(distinct {0})), ','), '')"
_TEXT = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    return wy.build_way_lines(syn.ways(spark, sf), syn.node_rows(spark, sf))


def _final(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ways, nodes, relations) as the relation operators take them."""
    lines = _lines(spark, sf)
    with_geom = wy.promote_areas(lines).where("geom is not null")
    nodes = build_node_geometry(syn.nodes(spark, sf))
    return with_geom, nodes, syn.relations(spark, sf)


# -- nodes


@query(f"select id, version, changeset, floor(lon * 1e7 + 0.5) / 1e7 x, floor(lat * 1e7 + 0.5) / 1e7 y, {_TEXT.format('ts')} latest_ts from n")
def node_points(spark, sf):
    register(spark)
    return build_node_geometry(syn.nodes(spark, sf)).select("id", "version", "changeset", "x", "y", _text("latest_ts").alias("latest_ts"))


@query("select usr, count(*) n from n where id % 97 <> 0 group by usr")
def node_drop_null_coords(spark, sf):
    register(spark)
    nodes = syn.nodes(spark, sf).withColumn("lat", F.when(F.col("id") % 97 != 0, F.col("lat")))
    return build_node_geometry(nodes).groupBy(F.col("user").alias("usr")).agg(F.count("*").alias("n"))


# -- ways


@query("select id, coalesce(array_to_string(refs, ','), '') refs from w")
def flatten_refs(spark, sf):
    raw = syn.ways(spark, sf).withColumn("nds", F.transform("refs", lambda x: F.struct(x.alias("ref")))).drop("refs", "additional_changesets")
    return wy.flatten_refs(raw).select("id", F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("refs"))


@query("select id, string_agg(cast(floor(x * 100 + 0.5) as bigint), ',' order by pos) xs from wp group by id")
def way_refs_ordered(spark, sf):
    return _lines(spark, sf).where("points is not null").select("id", F.array_join(F.transform("points", lambda p: F.floor(p["x"] * 100.0 + 0.5).cast("string")), ",").alias("xs"))


_AREA_RULE = "(pri = '1-URGENT' or pri = '4-NOT SPECIFIED') and closed and n_points > 3"


@query(f"""
select wa.id, n_points, closed, {_AREA_RULE} area, cast(xmin as float) xmin, cast(xmax as float) xmax, cast(ymin as float) ymin, cast(ymax as float) ymax, {_TEXT.format("greatest(w.ts, wa.nts)")} latest_ts,
       (select {_JOINED.format("ncs")} from wp where wp.id = wa.id and ncs > own) additional_changesets
from wa join w using (id)""")
def way_assembly(spark, sf):
    """Flagship: for every way its points, closedness, area rule, box, newest timestamp and newer changesets."""
    box = native.bbox(F.col("points"))
    return (
        _lines(spark, sf)
        .where("points is not null")
        .withColumn("b", box)
        .select(
            "id", F.size("points").cast("bigint").alias("n_points"), native.is_closed(F.col("points")).alias("closed"), wy.promotes(F.col("points"), F.col("tags")).alias("area"),
            "b.xmin", "b.xmax", "b.ymin", "b.ymax", _text("latest_ts").alias("latest_ts"), _joined("additional_changesets").alias("additional_changesets"),
        )
    )


@query(f"select w.id, {_TEXT.format('greatest(w.ts, wa.nts)')} latest_ts from w left join wa using (id)")
def way_latest_ts(spark, sf):
    return _lines(spark, sf).select("id", _text("latest_ts").alias("latest_ts"))


@query("select w.id, cast(count(distinct ncs) filter (ncs > own) as bigint) n_newer, coalesce(array_to_string(list_sort(list(distinct ncs) filter (ncs > own)), ','), '') changesets from w left join wp using (id) group by w.id")
def way_additional_changesets(spark, sf):
    return _lines(spark, sf).select("id", F.size("additional_changesets").cast("bigint").alias("n_newer"), _joined("additional_changesets").alias("changesets"))


@query("select id, cast(xmin as float) xmin, cast(xmax as float) xmax, cast(ymin as float) ymin, cast(ymax as float) ymax from wa where n_points >= 2")
def way_bbox(spark, sf):
    return finalize(_lines(spark, sf), "way").select("id", "bbox.xmin", "bbox.xmax", "bbox.ymin", "bbox.ymax")


@query("select closed, count(*) n from wa where n_points >= 2 group by closed")
def way_closed(spark, sf):
    return _lines(spark, sf).where("geom is not null").groupBy(geo("is_closed", "geom").alias("closed")).agg(F.count("*").alias("n"))


@query("select id, 'LINESTRING (' || string_agg(regexp_replace(cast(x as varchar), '\\.0$', '') || ' ' || regexp_replace(cast(y as varchar), '\\.0$', ''), ', ' order by pos) || ')' wkt from wp group by id having count(*) >= 2")
def way_wkt(spark, sf):
    """Every line as text, read back from its stored form."""
    return _lines(spark, sf).where("geom is not null").select("id", geo("as_wkt", "geom").alias("wkt"))


@query("select w.id, cast(len(refs) as bigint) n_refs, cast(count(pos) filter (node_id % 97 <> 0) as bigint) n_points, count(pos) filter (node_id % 97 <> 0) >= 2 built from w left join wr using (id) group by w.id, len(refs)")
def way_unresolved_refs(spark, sf):
    register(spark)
    lines = wy.build_way_lines(syn.ways(spark, sf), syn.node_rows(spark, sf).where("id % 97 <> 0"))
    return lines.select("id", F.size("refs").cast("bigint").alias("n_refs"), F.coalesce(F.size("points"), F.lit(0)).cast("bigint").alias("n_points"), F.col("geom").isNotNull().alias("built"))


@query("select pri, pri in ('1-URGENT', '4-NOT SPECIFIED', '5-LOW') area_tags, count(*) n from w group by all")
def area_predicate(spark, sf):
    ways = syn.ways(spark, sf).join(syn.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("pri")), "id")
    return ways.groupBy("pri", wy.is_area(F.col("tags")).alias("area_tags")).agg(F.count("*").alias("n"))


@query(f"select case when {_AREA_RULE} then 'ST_Polygon' else 'ST_LineString' end geometry_type, count(*) n from wa join w using (id) where n_points >= 2 group by 1")
def area_promotion(spark, sf):
    return wy.promote_areas(_lines(spark, sf)).where("geom is not null").groupBy(geo("type", "geom").alias("geometry_type")).agg(F.count("*").alias("n"))


@query("select wa.id, 'ST_LineString' geometry_type from wa join w using (id) where pri = '5-LOW' and closed and n_points > 3")
def area_no_override(spark, sf):
    ways = wy.promote_areas(_lines(spark, sf)).where((F.col("tags")["area"] == "no") & native.is_closed(F.col("points")) & (F.size("points") > 3))
    return ways.select("id", geo("type", "geom").alias("geometry_type"))


_STEPS = "select id, pos, x, y, lead(x) over (partition by id order by pos) x2, lead(y) over (partition by id order by pos) y2 from wp"


@query(f", s as ({_STEPS}) select id, cast(round(coalesce(sum(sqrt(power(x2 - x, 2) + power(y2 - y, 2))), 0) * 1000) as bigint) milli from s group by id")
def way_length_planar(spark, sf):
    return _lines(spark, sf).where("points is not null").select("id", F.round(native.length(F.col("points")) * 1000).cast("bigint").alias("milli"))


@query(f", s as ({_STEPS}) select s.id, cast(round(sum(x * y2 - x2 * y) / 2 * 1000) as bigint) milli from s join wa using (id) where closed and n_points > 3 group by s.id")
def way_ring_area_shoelace(spark, sf):
    return _lines(spark, sf).where("points is not null").select("id", F.round(native.ring_area(F.col("points")) * 1000).cast("bigint").alias("milli")).where("milli is not null")


# -- relations


@query("select id, kind from r where kind <> 'restriction'")
def relation_type_filter(spark, sf):
    return rel.need_geometry(syn.relations(spark, sf)).select("id", F.col("tags")["type"].alias("kind"))


@query("select id, mtype, case when role = '' then 'outer' else role end as role, count(*) n from m group by all")
def member_role_normalised(spark, sf):
    parts = rel.members(syn.relations(spark, sf))
    return parts.groupBy(F.col("relation_id").alias("id"), F.col("member_type").alias("mtype"), rel.normal_role(F.col("role")).alias("role")).agg(F.count("*").alias("n"))


@query("select id, kind, count(*) n from m group by all")
def relation_member_counts(spark, sf):
    return rel.members(syn.relations(spark, sf)).groupBy(F.col("relation_id").alias("id"), "kind").agg(F.count("*").alias("n"))


@query("select m.id, cast(count(distinct ref) filter (role in ('outer', '')) as bigint) n_outer, cast(count(distinct ref) filter (role = 'inner') as bigint) n_inner from m join wa on wa.id = m.ref and n_points >= 2 where mtype = 'way' and kind in ('multipolygon', 'boundary') group by m.id")
def polygon_outer_inner_presence(spark, sf):
    ways, _, relations = _final(spark, sf)
    parts = rel.members(rel.need_geometry(relations)).where(F.col("kind").isin(*rel.POLYGON_TYPES) & (F.col("member_type") == "way")).withColumn("role", rel.normal_role(F.col("role")))
    found = parts.join(ways.select(F.col("id").alias("ref")), "ref")
    count = lambda role: F.countDistinct(F.when(F.col("role") == role, F.col("ref")))
    return found.groupBy(F.col("relation_id").alias("id")).agg(count("outer").alias("n_outer"), count("inner").alias("n_inner"))


def _built(spark: SparkSession, sf: str, kinds: tuple[str, ...]) -> DataFrame:
    ways, nodes, relations = _final(spark, sf)
    chosen = relations.where(F.col("tags")["type"].isin(*kinds))
    return rel.build_relation_geometry(chosen, ways, nodes)


@query("select distinct m.id from m join wa on wa.id = m.ref and n_points >= 2 where mtype = 'way' and kind = 'route'")
def line_relations(spark, sf):
    return _built(spark, sf, rel.LINE_TYPES).select("id")


@query("select m.id, case when count(wa.id) > 0 then 'ST_GeometryCollection' else 'ST_Point' end geometry_type from m left join wa on wa.id = m.ref and n_points >= 2 and mtype = 'way' where kind = 'site' group by m.id")
def collection_relations(spark, sf):
    return _built(spark, sf, rel.COLLECTION_TYPES).select("id", geo("type", "geom").alias("geometry_type"))


@query("select r.id, true has_geometry from r where kind = 'restriction'")
def fallback_relations(spark, sf):
    """Every restriction has a node member, so every one falls back to a geometry."""
    ways, nodes, relations = _final(spark, sf)
    chosen = relations.where(F.col("tags")["type"] == "restriction")
    out = rel.merge_relation_geometry(chosen, rel.build_relation_geometry(chosen, ways, nodes), ways, nodes)
    return out.select("id", F.col("geom").isNotNull().alias("has_geometry"))


@query()
def relation_bbox(spark, sf):
    """Boxes of all relations that have a geometry (exact overlay isn't for SQL)."""
    out = build_relations(syn.relations(spark, sf), _lines(spark, sf), build_node_geometry(syn.nodes(spark, sf)))
    return out.where("bbox is not null").select("id", "bbox.xmin", "bbox.xmax", "bbox.ymin", "bbox.ymax")


#: SQL for a part of a query's rows: the boxes of routes are those of their ways.
PART_SQL = {
    "relation_bbox": f"with {syn.SQL} select m.id, cast(min(xmin) as float) xmin, cast(max(xmax) as float) xmax, cast(min(ymin) as float) ymin, cast(max(ymax) as float) ymax from m join wa on wa.id = m.ref and n_points >= 2 where mtype = 'way' and kind = 'route' group by m.id"
}


_SIDES = "4 + c_custkey % 5 as s, 1 + c_custkey % 3 as h, c_custkey % 300 as x, c_custkey % 150 - 75 as y"


@query(f"""
select c_custkey id, 'ST_Polygon' geometry_type, cast(s * s - h * h as bigint) area, 1 holes, 10 points, true valid, cast(x as float) xmin, cast(x + s as float) xmax, cast(y as float) ymin, cast(y + s as float) ymax
from (select c_custkey, {_SIDES} from customer)""", graph=False)
def multipolygon_area_grid(spark, sf):
    """A square with a square hole for every customer, its outer ring one closed way or two open ones: shapes whose area has a closed form."""
    register(spark)
    squares = syn.table(spark, sf, "customer").selectExpr("c_custkey id", *(x.strip() for x in _SIDES.split(",")))
    meta = [F.lit(1).cast("bigint").alias("version"), F.lit("2024-01-01 00:00:00").alias("timestamp"), F.lit(1).cast("bigint").alias("changeset"), F.lit(1).cast("bigint").alias("uid"), F.lit("u").alias("user")]
    none = F.create_map().cast("map<string,string>").alias("tags")
    corner = lambda k, size, at: (F.lit(k), F.col("x") + at + (size if k % 4 in (1, 2) else 0), F.col("y") + at + (size if k % 4 in (2, 3) else 0))
    corners = [corner(k, F.col("s"), F.lit(0.0)) for k in range(4)] + [corner(k, F.col("h"), F.lit(0.5)) for k in range(4, 8)]
    points = F.explode(F.array(*[F.struct(k.alias("k"), x.cast("double").alias("x"), y.cast("double").alias("y")) for k, x, y in corners]))
    nodes = squares.select("id", points.alias("p")).select((F.col("id") * 10 + F.col("p.k")).alias("id"), *meta, none, F.col("p.y").alias("lat"), F.col("p.x").alias("lon"))
    line = lambda way, *ks: F.struct(F.lit(way).alias("way"), F.array(*[F.col("id") * 10 + k for k in ks]).alias("refs"))
    whole, halves = F.array(line(0, 0, 1, 2, 3, 0), line(2, 4, 5, 6, 7, 4)), F.array(line(0, 0, 1, 2), line(1, 2, 3, 0), line(2, 4, 5, 6, 7, 4))
    drawn = squares.select("id", F.explode(F.when(F.col("id") % 2 == 0, whole).otherwise(halves)).alias("w"))
    ways = drawn.select((F.col("id") * 10 + F.col("w.way")).alias("id"), *meta, none, "w.refs")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int"))
    member = lambda way, role: F.struct(F.lit("way").alias("type"), (F.col("id") * 10 + way).alias("ref"), role.alias("role"))
    outer = pick(rel.OUTER_ROLES)
    relations = squares.select("id", *meta, F.create_map(F.lit("type"), pick(rel.POLYGON_TYPES)).alias("tags"), F.array(member(0, outer), member(1, outer), member(2, F.lit("inner"))).alias("members"))
    points = build_node_geometry(nodes)
    out = build_relations(relations, wy.promote_areas(wy.build_way_lines(ways, points)), points)
    shape = [geo(n, "geometry").alias(a) for n, a in (("type", "geometry_type"), ("num_holes", "holes"), ("num_points", "points"), ("is_valid", "valid"))]
    return out.select("id", *shape, F.round(geo("area", "geometry")).cast("bigint").alias("area"), "bbox.xmin", "bbox.xmax", "bbox.ymin", "bbox.ymax")


_MEMBER_META = ", mm as (select m.id, w.changeset cs, greatest(w.ts, wa.nts) ts from m join wa on wa.id = m.ref and mtype = 'way' and n_points >= 2 join w on w.id = m.ref union all select m.id, n.changeset, n.ts from m join n on n.id = m.ref and mtype = 'node')"


def _attributed(spark: SparkSession, sf: str) -> DataFrame:
    ways, nodes, relations = _final(spark, sf)
    no_shapes = relations.select("id", F.lit(None).cast("binary").alias("geom")).limit(0)
    return rel.merge_relation_geometry(relations, no_shapes, ways, nodes)


@query(f"{_MEMBER_META} select r.id, coalesce(array_to_string(list_sort(list(distinct cs) filter (cs > changeset)), ','), '') changesets from r left join mm using (id) group by r.id")
def relation_additional_changesets(spark, sf):
    return _attributed(spark, sf).select("id", _joined("additional_changesets").alias("changesets"))


@query(f"{_MEMBER_META} select r.id, {_TEXT.format('greatest(any_value(r.ts), max(mm.ts))')} latest_ts from r left join mm using (id) group by r.id")
def relation_latest_ts(spark, sf):
    return _attributed(spark, sf).select("id", _text("latest_ts").alias("latest_ts"))


@query()
def multipolygon_area(spark, sf):
    """Polygons by exact overlay: area, validity, and that the inner area isn't in it."""
    shapes = _built(spark, sf, rel.POLYGON_TYPES)
    return shapes.select("id", geo("type", "geom").alias("geometry_type"), F.round(geo("area", "geom"), 6).alias("area"))


@query()
def wkb_roundtrip(spark, sf):
    """Final ways, their geometry as text and numbers of points."""
    return finalize(wy.promote_areas(_lines(spark, sf)), "way").select("id", geo("type", "geometry").alias("geometry_type"), geo("num_points", "geometry").alias("n_points"), geo("is_valid", "geometry").alias("valid"))


@query("select 0 changed from (select 1) where false")
def geo_clean_idempotent(spark, sf):
    """Ways that a second cleaning changes: none."""
    ways = finalize(wy.promote_areas(_lines(spark, sf)), "way")
    return ways.where(~geo("same", geo("clean", "geometry"), F.col("geometry"))).select(F.lit(0).alias("changed"))


# -- edges


@query("select node_id, id way_id from wr")
def idx_node_to_ways(spark, sf):
    return edges.node_to_ways(syn.ways(spark, sf))


@query("select ref way_id, id relation_id from m where mtype = 'way' and kind <> 'restriction'")
def idx_way_to_relations(spark, sf):
    return edges.way_to_relations(syn.relations(spark, sf))


@query("select ref node_id, id relation_id from m where mtype = 'node'")
def idx_node_to_relations(spark, sf):
    return edges.node_to_relations(syn.relations(spark, sf))


@query("select ref child_relation_id, id parent_relation_id from m where mtype = 'relation'")
def idx_relation_to_relations(spark, sf):
    return edges.relation_to_relations(syn.relations(spark, sf))


@query("select node_id, id way_id from wr where id % 7 <> 0 union all select node_id, id from wr where id % 7 = 0 and pos > 0")
def idx_refresh(spark, sf):
    """The first reference of every seventh way is taken away, then its edges are refreshed."""
    ways = syn.ways(spark, sf)
    now = ways.withColumn("refs", F.when(F.col("id") % 7 == 0, F.slice("refs", F.lit(2), F.greatest(F.size("refs") - 1, F.lit(0)))).otherwise(F.col("refs")))
    return edges.refresh(edges.node_to_ways(ways), now, ways.where("id % 7 = 0").select("id"), "node_to_ways")


# -- changes


_LATEST = ", l as (select *, row_number() over (partition by seq, type, id order by version desc) k from ch)"


def _by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Each day's changes deduplicated as a file of its own: the type carries the file through one pass."""
    rows = syn.changes(spark, sf)
    tagged = rows.withColumn("type", F.concat_ws(":", F.lpad(F.col("sequence").cast("string"), 6, "0"), "type"))
    return ch.dedup(tagged).withColumn("sequence", F.substring("type", 1, 6).cast("bigint")).withColumn("type", F.substring("type", 8, 20))


@query(f"{_LATEST} select seq as sequence, type, id, op, version, changeset, {_TEXT.format('ts')} latest_ts from l where k = 1")
def change_dedup(spark, sf):
    return _by_file(spark, sf).select("sequence", "type", "id", "op", "version", "changeset", _text("latest_ts").alias("latest_ts"))


@query(f"{_LATEST} select seq as sequence, type, id, cast(count(*) as bigint) n_losers, array_to_string(list_sort(list(distinct changeset)), ',') losers from l where k > 1 group by all")
def change_losers(spark, sf):
    rows = _by_file(spark, sf).where(F.size("additional_changesets") > 0)
    return rows.select("sequence", "type", "id", F.size("additional_changesets").cast("bigint").alias("n_losers"), _joined("additional_changesets").alias("losers"))


@query(f"{_LATEST} select seq as sequence, type, op = 'delete' deleted, count(*) n from l where k = 1 group by all")
def change_slices(spark, sf):
    latest = _by_file(spark, sf)
    slices = [ch.upserts(latest, k) for k in KINDS] + [latest.where("op = 'delete'")]
    return reduce(DataFrame.unionByName, slices).groupBy("sequence", "type", (F.col("op") == "delete").alias("deleted")).agg(F.count("*").alias("n"))


def _workspace(spark: SparkSession) -> str:
    """A fresh root for a query's own store."""
    return workspace(spark, "store")


@query(f"{_LATEST} select seq as sequence, concat(seq, '.osc.gz') osc_file, count(*) n, cast(sum(changeset) as bigint) total from l where k = 1 group by all")
def change_archive_by_sequence(spark, sf):
    """Every file of the feed archived, one of them twice: each is there once."""
    db = Database(spark, _workspace(spark))
    db.create_archive()
    latest = _by_file(spark, sf).persist()
    sequences = sorted(r[0] for r in latest.select("sequence").distinct().collect())
    for k in sequences + sequences[len(sequences) // 2 :][:1]:
        db.store.replace_slot("osc_archive", str(k), archived(latest.where(F.col("sequence") == k).drop("sequence"), k, f"{k}.osc.gz"))
    latest.unpersist()
    return db.read("osc_archive").groupBy("sequence", "osc_file").agg(F.count("*").alias("n"), F.sum("changeset").alias("total"))


_NODE_UPSERTS = ", u as (select * from (select *, row_number() over (partition by id order by version desc) k from ch where type = 'node') where k = 1 and op <> 'delete')"


def _node_upserts(spark: SparkSession, sf: str) -> DataFrame:
    return ch.upserts(ch.dedup(syn.changes(spark, sf)), "node")


@query(f"{_NODE_UPSERTS} select u.id, n.id is null or u.lat is distinct from n.lat or u.lon is distinct from n.lon moved from u left join n using (id)")
def classify_nodes_moved(spark, sf):
    return ch.classify_nodes(_node_upserts(spark, sf), syn.nodes(spark, sf)).select("id", "moved")


_WAY_UPSERTS = ", x as (select * from (select *, row_number() over (partition by id order by version desc) k from ch where type = 'way') where k = 1 and op <> 'delete')"
_DIRTY_WAYS = ", mv as (select u.id from u left join n using (id) where n.id is null or u.lat is distinct from n.lat or u.lon is distinct from n.lon), dw as (select id from x union select wr.id from wr where node_id in (select id from mv))"


def _dirty_ways(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ways = syn.ways(spark, sf)
    moved = ch.classify_nodes(_node_upserts(spark, sf), syn.nodes(spark, sf)).where("moved").select("id")
    return dirty.dirty_ways(ways, ch.upserts(ch.dedup(syn.changes(spark, sf)), "way"), moved, edges.node_to_ways(ways)), moved


@query(f"{_NODE_UPSERTS}{_WAY_UPSERTS}{_DIRTY_WAYS} select dw.id, coalesce(x.version, w.version) as version, coalesce(x.changeset, w.changeset) changeset from dw left join x using (id) left join w using (id)")
def dirty_ways(spark, sf):
    return _dirty_ways(spark, sf)[0].select("id", "version", "changeset")


_REL_UPSERTS = ", y as (select * from (select *, row_number() over (partition by id order by version desc) k from ch where type = 'relation') where k = 1 and op <> 'delete')"


@query(f"""{_NODE_UPSERTS}{_WAY_UPSERTS}{_DIRTY_WAYS}{_REL_UPSERTS}
select id from y union select id from m where kind <> 'restriction' and mtype = 'way' and ref in (select id from dw) union select id from m where mtype = 'node' and ref in (select id from mv)
union select id from m where mtype = 'relation' and ref in (select id from y)""")
def dirty_relations(spark, sf):
    ways, moved = _dirty_ways(spark, sf)
    relations = syn.relations(spark, sf)
    changed = ch.upserts(ch.dedup(syn.changes(spark, sf)), "relation")
    out = dirty.dirty_relations(relations, changed, ways, edges.way_to_relations(relations), moved, edges.node_to_relations(relations), edges.relation_to_relations(relations))
    return out.select("id")


@query(f"{_REL_UPSERTS} select distinct id from m where mtype = 'relation' and ref in (select id from y)")
def dirty_relations_via_child(spark, sf):
    relations = syn.relations(spark, sf)
    changed = ch.upserts(ch.dedup(syn.changes(spark, sf)), "relation")
    nothing = edges.way_to_relations(relations).limit(0)
    return dirty.dirty_relation_ids(changed, changed.limit(0), nothing, relation_to_relations=edges.relation_to_relations(relations))


@query(f"{_NODE_UPSERTS} select u.id, u.version, cast(u.changeset as bigint) changeset, 0 stored from u left join n using (id)")
def carry_forward_changesets(spark, sf):
    """Every node has stored its own changeset; an update of it keeps that among its changesets."""
    base = syn.nodes(spark, sf).withColumn("additional_changesets", F.array("changeset"))
    out = ch.carry_changesets(_node_upserts(spark, sf), base)
    missing = out.join(base.select("id", F.col("changeset").alias("own")), "id", "left").withColumn("stored", F.when(F.col("own").isNotNull() & ~F.array_contains("additional_changesets", F.col("own")), 1).otherwise(0))
    return missing.select("id", "version", "changeset", "stored")


# -- merge and tables


_TARGET = ", t as (select id, version, changeset from n), d as (select distinct id from ch where type = 'node' and op = 'delete'), s as (select id, version, changeset from u)"


def _target(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    deletes = syn.changes(spark, sf).where("type = 'node' and op = 'delete'").select("id")
    return syn.nodes(spark, sf).select("id", "version", "changeset"), _node_upserts(spark, sf).select("id", "version", "changeset"), deletes


@query(f"{_NODE_UPSERTS}{_TARGET} select coalesce(t.id, s.id) id, case when s.id is not null and (t.id is null or s.version >= t.version) then s.version else t.version end as version, case when s.id is not null and (t.id is null or s.version >= t.version) then s.changeset else t.changeset end changeset from (select * from t where id not in (select id from d)) t full join (select * from s where id not in (select id from d)) s on s.id = t.id")
def merge_upsert_delete(spark, sf):
    return merged(*_target(spark, sf))


@query(f"{_NODE_UPSERTS}{_TARGET} select t.id, t.version from t join s using (id) where s.version < t.version")
def merge_version_guard(spark, sf):
    """Rows that keep a version above that of their upsert."""
    target, source, _ = _target(spark, sf)
    out = merged(target, source, source.select("id").limit(0))
    return out.join(source.select("id", F.col("version").alias("v")), "id").where("v < version").select("id", "version")


@query(f"{_NODE_UPSERTS}{_TARGET} select count(*) n from (select id from t union select id from s) where id not in (select id from d)")
def merge_deletes_win(spark, sf):
    return merged(*_target(spark, sf)).agg(F.count("*").alias("n"))


def _small_store(spark: SparkSession, sf: str) -> Database:
    """A store with the three typed tables' ids, versions and timestamps, stamped 7, 5 and 6."""
    db = Database(spark, _workspace(spark))
    for table, rows, stamp in (("nodes", syn.nodes, 7), ("ways", syn.ways, 5), ("relations", syn.relations, 6)):
        db.store.create(table, "id bigint, version bigint, timestamp timestamp")
        db.store.append(table, rows(spark, sf).select("id", "version", "timestamp"), last_applied_sequence=stamp)
    return db


@query("select 'node' kind, count(*) n from n union all select 'way', count(*) from w union all select 'relation', count(*) from r")
def table_counts(spark, sf):
    return spark.createDataFrame(list(_small_store(spark, sf).counts().items()), "kind string, n long")


@query(f"select {_TEXT.format('max(ts)')} newest from (select max(ts) ts from n union all select max(ts) from w union all select max(ts) from r)")
def max_timestamp(spark, sf):
    newest = _small_store(spark, sf).max_timestamp()
    return spark.createDataFrame([(newest.strftime("%Y-%m-%d %H:%M:%S"),)], "newest string")


@query("select unnest(range(11, 14)) as sequence union all select 100", graph=False)
def pending_sequence_list(spark, sf):
    found = [s for a, b in ((100, 100), (10, 13), (50, 40), (99, 100)) for s in pending_sequences(a, b)]
    return spark.createDataFrame([(s,) for s in found], "sequence long")


@query("select cast(5 as bigint) min_applied", graph=False)
def min_applied_sequence(spark, sf):
    return spark.createDataFrame([(_small_store(spark, sf).min_applied(),)], "min_applied long")


@query("select id, max(version) as version, max(changeset) changeset from ch where type = 'node' group by id")
def unique_by_id_rows(spark, sf):
    rows = syn.changes(spark, sf).where("type = 'node'").withColumn("latest_ts", F.col("latest_ts").cast("timestamp"))
    return unique_by_id(rows).select("id", "version", "changeset")


@query(f"select wa.id, {_TEXT.format('w.ts')} ts from wa join w using (id) where {_AREA_RULE} order by w.ts desc, wa.id limit 10")
def sample_recent_by_type(spark, sf):
    ways = finalize(wy.promote_areas(_lines(spark, sf)), "way")
    return inspect.sample_rows(ways, "Polygon", 10).select("id", _text("timestamp").alias("ts"))


_PARTS = "case when seq < 11 then 1 when seq <= 20 then 2 when seq <= 30 then 3 else 4 end"
#: Nodes and relations: the last operation.  Ways: the last version, after any delete, of which two references resolve when its file is applied.
_END = f"""
, f as (select *, {_PARTS} part from ch),
k as (select * exclude (rk) from (select *, row_number() over (partition by part, type, id order by version desc) rk from f) where rk = 1),
nd as (select p.part, k.id from (select distinct part from k) p join k on k.type = 'node' and k.part <= p.part qualify row_number() over (partition by p.part, k.id order by k.version desc) = 1 and k.op <> 'delete'),
wy as (select part, id, version, changeset, unnest([id, id + 1, id + 2, changeset % 100]) node_id from k where type = 'way' and op <> 'delete'),
ok as (select wy.part, wy.id, wy.version, wy.changeset from wy join nd on nd.part = wy.part and nd.id = wy.node_id group by all having count(*) >= 2),
dl as (select id, max(part) gone from k where type = 'way' and op = 'delete' group by id),
lw as (select ok.id, version, changeset from ok left join dl using (id) where part > coalesce(gone, 0) qualify row_number() over (partition by ok.id order by part desc) = 1)
select type, id, version, changeset from ch where type <> 'way' qualify row_number() over (partition by type, id order by version desc) = 1 and op <> 'delete'
union all select 'way', id, version, changeset from lw"""


def _feed(spark: SparkSession, sf: str) -> SharedServer:
    """The whole feed as change files of about ten days on a server of its own, with their states."""
    folder, rows = f"{_workspace(spark)}/feed", syn.changes(spark, sf).withColumn("part", F.expr(_PARTS.replace("seq", "sequence")))
    for k in range(1, 5):
        write_changes(rows.where(F.col("part") == k), f"{folder}/{k}.osc.gz")
        Files(spark).write(f"{folder}/{k}.state.txt", [state_text(State(k, datetime(2024, 1, k, tzinfo=timezone.utc))).encode()])
    return SharedServer(spark, folder)


def _empty_database(spark: SparkSession, sf: str) -> Database:
    db = Database(spark, _workspace(spark))
    initialise(db, {"node": syn.nodes(spark, sf).limit(0), "way": syn.ways(spark, sf).limit(0), "relation": syn.relations(spark, sf).limit(0)}, sequence=0)
    return db


@query(_END)
def apply_all_end_state(spark, sf):
    """The whole feed, written as change files, fetched from a server and applied to an empty database: what the typed tables hold at the end."""
    db = _empty_database(spark, sf)
    apply_all(db, _feed(spark, sf), f"{_workspace(spark)}/fetched")
    return _typed_rows(db, "id", "version", "changeset")


@query(_END)
def feed_stream_end_state(spark, sf):
    """The same change files as a stream: one after another as they are found in a folder."""
    db = _empty_database(spark, sf)
    start(db, _feed(spark, sf).folder, f"{_workspace(spark)}/checkpoint").awaitTermination()
    return _typed_rows(db, "id", "version", "changeset")


def _typed_rows(db: Database, *columns: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [db.read(t).select(F.lit(k).alias("type"), *columns) for k, t in TYPED.items()])


@query("select case event_id % 3 when 0 then 'node' when 1 then 'way' else 'relation' end as type, user_id id, event_id as version from events qualify event_id = max(event_id) over (partition by user_id, event_id % 3) and event_type <> 'error'", graph=False)
def stream_end_state(spark, sf):
    """The feed as a stream into a table for each type, versions being event ids."""
    db = Database(spark, _workspace(spark))
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    for kind, name in TYPED.items():
        db.store.create(name, "id bigint, version bigint")
        events = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")  # as a pattern it may be a file
        records = syn.from_events(events).where(F.col("type") == kind).withColumn("version", F.col("event_id"))
        to_rows = lambda latest, kind=kind: (ch.upserts(latest, kind).select("id", "version"), ch.deletes(latest, kind))
        start_merges(db.store, name, records, to_rows, f"{_workspace(spark)}/checkpoint").awaitTermination()
    return _typed_rows(db, "id", "version")


@query("select type, op, count(*) n, cast(sum(version) as bigint) versions, cast(sum(changeset) as bigint) changesets, cast(sum(case type when 'way' then 4 else 0 end) as bigint) refs, cast(sum(case type when 'relation' then 1 else 0 end) as bigint) members, cast(sum(floor(lat * 100 + 0.5)) as bigint) lats, cast(sum(length(event_type)) as bigint) tags from ch group by all")
def change_file_round_trip(spark, sf):
    """The whole feed written as one change file and read back."""
    path = f"{_workspace(spark)}/1.osc.gz"
    write_changes(syn.changes(spark, sf), path)
    size = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0))).cast("bigint")
    return read_changes(spark, path).groupBy("type", "op").agg(
        F.count("*").alias("n"), F.sum("version").alias("versions"), F.sum("changeset").alias("changesets"), F.sum(F.when(F.col("refs").isNotNull(), F.size("refs")).otherwise(0)).cast("bigint").alias("refs"),
        F.sum(F.when(F.col("members").isNotNull(), F.size("members")).otherwise(0)).cast("bigint").alias("members"), F.sum(F.floor(F.col("lat") * 100 + 0.5)).cast("bigint").alias("lats"), F.sum(F.length(F.col("tags")["event"])).cast("bigint").alias("tags"),
    )


@query("select cast(day(ts) as bigint) as sequence, count(*) n from events group by all", graph=False)
def replication_fetch(spark, sf):
    """A server with a file for each day of the feed: all that is pending after day 0 is fetched, then each file is read."""
    folder, files = f"{_workspace(spark)}/server", Files(spark)
    days = sorted(map(tuple, syn.changes(spark, sf).groupBy("sequence").count().collect()))
    for day, n in days:
        body = f'<osmChange><create><node id="{day}" version="1" timestamp="2024-01-01T00:00:00Z" changeset="{n}"/></create></osmChange>'
        files.write(f"{folder}/{day}.osc.gz", [gzip.compress(body.encode())])
        files.write(f"{folder}/{day}.state.txt", [state_text(State(day, datetime(2024, 1, day, tzinfo=timezone.utc))).encode()])
    paths = fetch_change_files(SharedServer(spark, folder), f"{_workspace(spark)}/fetched", last_applied=0)
    return read_changes(spark, *paths).select(F.col("id").alias("sequence"), F.col("changeset").alias("n"))


@query("""select 'nodes' as tbl, count(*) n from n union all select 'ways', count(*) from wa where n_points >= 2 union all select 'relations', count(*) from r
union all select 'node_to_ways', count(*) from wr where id in (select id from wa where n_points >= 2) union all select 'way_to_relations', count(*) from m where mtype = 'way' and kind <> 'restriction'
union all select 'node_to_relations', count(*) from m where mtype = 'node' union all select 'relation_to_relations', count(*) from m where mtype = 'relation' union all select 'osc_archive', 0""")
def initial_load_counts(spark, sf):
    """All tables loaded from the whole graph, in two runs: the first without its last edge tables, the second resuming it."""
    db, extract = Database(spark, _workspace(spark)), {"node": syn.nodes(spark, sf), "way": syn.ways(spark, sf), "relation": syn.relations(spark, sf)}
    initialise(db, extract, sequence=7)
    for lost in ("node_to_relations", "relation_to_relations"):
        db.store.drop(lost)
    initialise(db, extract, resume=True)
    return reduce(DataFrame.unionAll, [db.read(t).agg(F.lit(t).alias("tbl"), F.count("*").alias("n")) for t in TABLES])


@query("select count(*) n, cast(sum(version) as bigint) versions, cast(count(*) filter (id % 1000 = 0) as bigint) written, cast(count(*) filter (id % 1000 in (0, 1)) as bigint) gone, 0 rewritten from (select id, case when id % 1000 = 0 then version + 1 else version end as version from n)")
def merge_writes_the_change(spark, sf):
    """A merge of every thousandth node, and deletes of ids that aren't there: the rows it writes, and the older files it rewrites."""
    db = Database(spark, _workspace(spark))
    db.store.create("nodes", "id bigint, version bigint", TableConfig(files=16))
    rows = syn.nodes(spark, sf).select("id", "version")
    db.store.append("nodes", rows)
    before = {e["path"] for e in db.store.snapshot("nodes")["data"]}
    changed = rows.where("id % 1000 = 0").withColumn("version", F.col("version") + 1)
    db.store.merge("nodes", changed, rows.where("id % 1000 = 1").select((-F.col("id")).alias("id")))
    after = db.store.snapshot("nodes")
    counts = [F.lit(sum(e["rows"] for e in after[k] if e["path"] not in before)).cast("bigint").alias(a) for k, a in (("data", "written"), ("gone", "gone"))]
    return db.read("nodes").agg(F.count("*").alias("n"), F.sum("version").alias("versions")).select("n", "versions", *counts, F.lit(len(before - {e["path"] for e in after["data"]})).alias("rewritten"))


@query("select id, case when id % 10 = 0 then 'deleted' else 'modified' end change from n where id % 10 = 0 or id % 10 = 1")
def snapshot_diff(spark, sf):
    """Two snapshots of a store: every tenth node deleted, the next one modified."""
    register(spark)
    db = Database(spark, _workspace(spark))
    db.create_typed("node")
    rows = finalize(build_node_geometry(syn.nodes(spark, sf)), "node")
    db.store.append("nodes", rows)
    before = db.store.snapshot("nodes")["version"]
    newer = rows.where("id % 10 = 1").withColumn("version", F.col("version") + 1)
    db.store.merge("nodes", newer, rows.where("id % 10 = 0").select("id"))
    return inspect.snapshot_diff(db.store.read("nodes", before), db.read("nodes")).select("id", "change")


@query("select count(*) n, cast(sum(version) as bigint) versions from n")
def store_time_travel(spark, sf):
    """The table as it was before a merge that deleted half of it."""
    db = Database(spark, _workspace(spark))
    db.store.create("nodes", "id bigint, version bigint")
    rows = syn.nodes(spark, sf).select("id", "version")
    db.store.append("nodes", rows)
    version = db.store.snapshot("nodes")["version"]
    db.store.merge("nodes", rows.limit(0), rows.where("id % 2 = 0").select("id"))
    return db.store.read("nodes", version).agg(F.count("*").alias("n"), F.sum("version").alias("versions"))
