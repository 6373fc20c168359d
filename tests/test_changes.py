"""Change records, dirty sets, edges and merges on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from osmlake import schemas
from osmlake.operators import changes as ch
from osmlake.operators import dirty, edges
from osmlake.operators.merge import merged


def records(spark, rows):
    """rows: (id, type, op, version, changeset[, lat, refs, members])."""
    full = []
    for r in rows:
        i, kind, op, version, cs, lat, refs, members = [*r, None, None, None][:8]
        full.append((i, kind, op, version, f"2024-01-01T00:00:{version or 0:02d}Z", 1, "u", cs, {}, lat, lat, refs, members, None))
    return spark.createDataFrame(full, schemas.CHANGES)


def test_dedup_keeps_winner_and_losers(spark):
    rows = [(1, "node", "modify", 5, 70), (1, "node", "modify", 6, 80), (1, "way", "create", 1, None), (2, "node", "modify", 5, 1), (2, "node", "delete", 6, 2), (3, "node", "modify", None, 9), (3, "node", "modify", 1, 8)]
    got = {(r.id, r.type): r for r in ch.dedup(records(spark, rows)).collect()}
    assert (got[1, "node"].version, got[1, "node"].changeset, got[1, "node"].additional_changesets) == (6, 80, [70])
    assert got[1, "way"].changeset == 0 and got[1, "way"].additional_changesets == []
    assert got[2, "node"].op == "delete" and got[3, "node"].version == 1
    assert ch.dedup(records(spark, rows).limit(0)).count() == 0


def test_slices_and_classification(spark):
    latest = ch.dedup(records(spark, [(1, "node", "modify", 2, 1, 1.0), (2, "node", "modify", 2, 1, 5.0), (3, "node", "create", 1, 1, 1.0), (4, "node", "delete", 3, 1), (5, "node", "modify", 2, 1)]))
    base = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (5, None, None)], "id bigint, lat double, lon double")
    got = {r.id: r.moved for r in ch.classify_nodes(ch.upserts(latest, "node"), base).collect()}
    assert got == {1: False, 2: True, 3: True, 5: False}
    assert [r.id for r in ch.deletes(latest, "node").collect()] == [4]


def test_dirty_ways_carry_history_for_direct_and_widened(spark):
    columns = "id bigint, version bigint, timestamp timestamp, uid bigint, user string, changeset bigint, tags map<string,string>, refs array<bigint>, additional_changesets array<bigint>"
    base = spark.createDataFrame([(1, 1, None, 1, "u", 3, {}, [10], [30]), (2, 1, None, 1, "u", 3, {}, [11], [31]), (3, 1, None, 1, "u", 3, {}, [12], [])], columns)
    latest = ch.dedup(records(spark, [(1, "way", "modify", 2, 9, None, [10, 12])]))
    moved = spark.createDataFrame([(11,)], "id bigint")
    got = {r.id: (r.version, sorted(r.additional_changesets)) for r in dirty.dirty_ways(base, ch.upserts(latest, "way"), moved, edges.node_to_ways(base)).collect()}
    assert got == {1: (2, [30]), 2: (1, [31])}


def _relations(spark):
    member = lambda kind, ref: (kind, ref, "")
    rows = [(1, {"type": "route"}, [member("way", 5)]), (2, {"type": "restriction"}, [member("way", 5), member("node", 7)]), (3, {"type": "site"}, [member("relation", 1)]), (4, {"type": "site"}, [member("relation", 3)]), (5, None, None)]
    return spark.createDataFrame(rows, f"id bigint, tags map<string,string>, members {schemas.MEMBERS}")


def test_edges_and_widening(spark):
    rel = _relations(spark)
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(edges.way_to_relations(rel)) == [(5, 1)] and pairs(edges.way_to_relations(rel, all_types=True)) == [(5, 1), (5, 2)]
    assert pairs(edges.node_to_relations(rel)) == [(7, 2)] and pairs(edges.relation_to_relations(rel)) == [(1, 3), (3, 4)]
    one, none = spark.createDataFrame([(1,)], "id bigint"), spark.createDataFrame([], "id bigint")
    up = lambda depth: sorted(r.id for r in dirty.dirty_relation_ids(one, none, edges.way_to_relations(rel), relation_to_relations=edges.relation_to_relations(rel), max_depth=depth).collect())
    assert up(1) == [3] and up(2) == [3, 4]
    moved = spark.createDataFrame([(7,)], "id bigint")
    assert [r.id for r in dirty.dirty_relation_ids(none, none, edges.way_to_relations(rel), moved, edges.node_to_relations(rel)).collect()] == [2]


def test_refresh_replaces_edges_of_dirty_parents(spark):
    ways = spark.createDataFrame([(1, [4, 5, 4]), (2, [6])], "id bigint, refs array<bigint>")
    old = edges.node_to_ways(ways)
    now = spark.createDataFrame([(1, [8]), (2, [9])], "id bigint, refs array<bigint>")
    got = edges.refresh(old, now, spark.createDataFrame([(1,), (3,)], "id bigint"), "node_to_ways")
    assert sorted(map(tuple, old.collect())) == [(4, 1), (4, 1), (5, 1), (6, 2)] and sorted(map(tuple, got.collect())) == [(6, 2), (8, 1)]


@pytest.mark.parametrize(
    ("target", "upsert", "delete", "expected"),
    [
        ([(1, 5)], [(1, 4)], [], [(1, 5)]),
        ([(1, 5)], [(1, 5)], [], [(1, 5, "new")]),
        ([(1, 5)], [(1, 6)], [1], []),
        ([(1, 5)], [], [2], [(1, 5)]),
        ([(1, 5)], [(2, None)], [], [(1, 5)]),
        ([(1, None)], [(1, 6)], [], [(1, None)]),
        ([], [(3, 1)], [], [(3, 1, "new")]),
    ],
)
def test_merge(spark, target, upsert, delete, expected):
    ddl = "id bigint, version bigint, note string"
    t = spark.createDataFrame([(*r, "old") for r in target], ddl)
    u = spark.createDataFrame([(*r, "new") for r in upsert], ddl)
    d = spark.createDataFrame([(x,) for x in delete], "id bigint")
    assert sorted(map(tuple, merged(t, u, d).collect()), key=str) == sorted([(*r, "old") if len(r) == 2 else r for r in expected], key=str)


def test_carry_changesets(spark):
    u = spark.createDataFrame([(1, [5]), (2, None)], "id bigint, additional_changesets array<bigint>")
    b = spark.createDataFrame([(1, [6, 5])], "id bigint, additional_changesets array<bigint>")
    assert {r.id: sorted(r.additional_changesets) for r in ch.carry_changesets(u, b).collect()} == {1: [5, 6], 2: []}
    assert ch.carry_changesets(u, b.limit(0)).where(F.col("id") == 2).first().additional_changesets == []
