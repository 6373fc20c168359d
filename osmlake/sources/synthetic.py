"""A deterministic feature graph over star-schema tables, by integer arithmetic that any SQL engine repeats.

Nodes come from ``part``, ways from ``orders`` and ``lineitem``, relations from
``customer``, the change feed from ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tags of ways by order priority, and relation types by market segment.
WAY_TAGS = {
    "1-URGENT": {"building": "yes"},
    "2-HIGH": {"boundary": "place"},
    "3-MEDIUM": {"leisure": "track"},
    "4-NOT SPECIFIED": {"area:highway": "yes"},
    "5-LOW": {"building": "yes", "area": "no"},
}
RELATION_TYPES = {"AUTOMOBILE": "multipolygon", "BUILDING": "boundary", "FURNITURE": "route", "HOUSEHOLD": "site", "MACHINERY": "restriction"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coordinate(key: Column, factor: int, modulus: int, shift: int) -> Column:
    return ((key * factor) % modulus).cast("double") / F.lit(100.0) - F.lit(float(shift))


def latitude(key: Column) -> Column:
    return _coordinate(key, 37, 18001, 90)


def longitude(key: Column) -> Column:
    return _coordinate(key, 101, 36001, 180)


def _no_changesets() -> Column:
    return F.array().cast("array<bigint>").alias("additional_changesets")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    stamp = F.timestamp_add("DAY", (key % 1500).cast("int"), F.lit("1996-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "part").select(
        key.alias("id"), (1 + F.col("p_size") % 5).cast("bigint").alias("version"), stamp.alias("timestamp"), (1000 + key % 9973).alias("changeset"), F.col("p_size").cast("bigint").alias("uid"),
        F.col("p_brand").alias("user"), F.create_map(F.lit("type"), F.col("p_type")).alias("tags"), latitude(key).alias("lat"), longitude(key).alias("lon"), _no_changesets(),
    )


def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the derived columns that way assembly needs."""
    return nodes(spark, sf_dir).withColumn("latest_ts", F.col("timestamp"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways; references in order of (line number, part).  Closed where the status is F and there are three or more."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    refs = F.coalesce(F.transform("l", lambda x: x["l_partkey"]), F.array().cast("array<bigint>"))
    closed = (F.col("o_orderstatus") == "F") & (F.size("r") >= 3)
    tags = F.lit(None).cast("map<string,string>")
    for priority, own in WAY_TAGS.items():
        tags = F.when(F.col("o_orderpriority") == priority, F.create_map(*[F.lit(x) for kv in own.items() for x in kv])).otherwise(tags)
    return orders.withColumn("r", refs).select(
        F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 7).alias("version"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), (1000 + F.col("o_custkey")).alias("changeset"),
        (F.col("o_custkey") % 50).alias("uid"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user"), tags.alias("tags"),
        F.when(closed, F.concat("r", F.slice("r", 1, 1))).otherwise(F.col("r")).alias("refs"), _no_changesets(),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations: the customer's orders as ways (in order of id), a node, and for every tenth the next relation."""
    n_parts = table(spark, sf_dir, "part").count()
    role = F.when(F.col("o_orderstatus") == "F", "outer").when(F.col("o_orderstatus") == "O", "inner").otherwise("")
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("ref"), role.alias("role")))).alias("o"))
    key = F.col("c_custkey")
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), ref.cast("bigint").alias("ref"), role.alias("role"))
    none = F.array().cast("array<struct<type:string,ref:bigint,role:string>>")
    members = F.concat(
        F.coalesce(F.transform("o", lambda x: member("way", x["ref"], x["role"])), none),
        F.array(member("node", key % n_parts, F.lit("label"))),
        F.when(key % 10 == 0, F.array(member("relation", key + 1, F.lit("subarea")))).otherwise(none),
    )
    kind = F.lit(None).cast("string")
    for segment, name in RELATION_TYPES.items():
        kind = F.when(F.col("c_mktsegment") == segment, name).otherwise(kind)
    stamp = F.timestamp_add("DAY", (key % 1000).cast("int"), F.lit("1995-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "customer").join(by, key == F.col("o_custkey"), "left").select(
        key.alias("id"), (1 + key % 3).alias("version"), stamp.alias("timestamp"), (1000 + key % 5000).alias("changeset"), F.col("c_nationkey").cast("bigint").alias("uid"), F.col("c_name").alias("user"),
        F.create_map(F.lit("type"), kind).alias("tags"), members.alias("members"), _no_changesets(),
    )


def from_events(events: DataFrame) -> DataFrame:
    """Change records of event rows, without a version."""
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "node").when(e % 3 == 1, "way").otherwise("relation")
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("modify")
    return events.select(
        F.dayofmonth("ts").cast("bigint").alias("sequence"), F.col("user_id").alias("id"), kind.alias("type"), op.alias("op"), F.col("ts").cast("timestamp").cast("string").alias("timestamp"),
        F.lit(None).cast("bigint").alias("uid"), F.lit("feed").alias("user"), e.alias("changeset"), F.create_map(F.lit("event"), F.col("event_type")).alias("tags"),
        latitude(e).alias("lat"), longitude(e).alias("lon"),
        F.when(kind == "way", F.array(F.col("user_id"), F.col("user_id") + 1, F.col("user_id") + 2, e % 100)).alias("refs"),
        F.when(kind == "relation", F.array(F.struct(F.lit("way").alias("type"), F.col("user_id").alias("ref"), F.lit("").alias("role")))).alias("members"),
        F.col("ts").alias("ts"), e.alias("event_id"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with versions: the rank of a change among those of its element, by time."""
    rows = from_events(table(spark, sf_dir, "events"))
    rank = F.row_number().over(Window.partitionBy("type", "id").orderBy("ts", "event_id")).cast("bigint")
    return rows.withColumn("version", rank).withColumn("latest_ts", F.col("timestamp")).drop("ts", "event_id")


_COORD = "cast(({0} * {1}) % {2} as double) / cast(100 as double) - cast({3} as double)"
_LAT, _LON = (lambda k: _COORD.format(k, 37, 18001, 90)), (lambda k: _COORD.format(k, 101, 36001, 180))

#: The same graph as common table expressions (DuckDB): n, w, wp (resolved points), r, m (members), ch (changes).
SQL = f"""
n as (select p_partkey id, cast(1 + p_size % 5 as bigint) version, timestamp '1996-01-01' + to_days(cast(p_partkey % 1500 as integer)) ts, 1000 + p_partkey % 9973 changeset, p_brand usr, p_type ptype,
      {_LAT("p_partkey")} lat, {_LON("p_partkey")} lon from part),
w0 as (select o_orderkey id, 1 + o_orderkey % 7 as version, o_orderdate ts, 1000 + o_custkey changeset, o_orderpriority pri, o_orderstatus st, o_custkey cust,
       coalesce(list(l_partkey order by l_linenumber, l_partkey) filter (l_partkey is not null), []) r0
       from orders left join lineitem on l_orderkey = o_orderkey group by all),
w as (select * exclude (r0), case when st = 'F' and len(r0) >= 3 then list_concat(r0, r0[1:1]) else r0 end refs from w0),
wr as (select id, changeset own, unnest(refs) node_id, unnest(range(len(refs))) pos from w),
wp as (select wr.id, pos, own, floor(lon * 1e7 + 0.5) / 1e7 x, floor(lat * 1e7 + 0.5) / 1e7 y, n.ts nts, n.changeset ncs from wr join n on n.id = node_id),
wa as (select id, count(*) n_points, min(x) xmin, max(x) xmax, min(y) ymin, max(y) ymax, arg_min(x, pos) = arg_max(x, pos) and arg_min(y, pos) = arg_max(y, pos) closed, max(nts) nts from wp group by id),
r as (select c_custkey id, 1 + c_custkey % 3 as version, timestamp '1995-01-01' + to_days(cast(c_custkey % 1000 as integer)) ts, 1000 + c_custkey % 5000 changeset,
      case c_mktsegment when 'AUTOMOBILE' then 'multipolygon' when 'BUILDING' then 'boundary' when 'FURNITURE' then 'route' when 'HOUSEHOLD' then 'site' when 'MACHINERY' then 'restriction' end kind from customer),
m as (select r.id, r.kind, 'way' mtype, o_orderkey ref, case o_orderstatus when 'F' then 'outer' when 'O' then 'inner' else '' end role from r join orders on o_custkey = r.id
      union all select id, kind, 'node', id % (select count(*) from part), 'label' from r
      union all select id, kind, 'relation', id + 1, 'subarea' from r where id % 10 = 0),
ch as (select cast(day(ts) as bigint) seq, user_id id, case event_id % 3 when 0 then 'node' when 1 then 'way' else 'relation' end type,
       case event_type when 'signup' then 'create' when 'error' then 'delete' else 'modify' end op, event_id changeset, ts, event_type, {_LAT("event_id")} lat, {_LON("event_id")} lon,
       row_number() over (partition by event_id % 3, user_id order by ts, event_id) version from events)
"""
