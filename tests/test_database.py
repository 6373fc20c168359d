"""Store, initial load, change files, resume, streaming and inspection, end to end on a tiny graph."""

import gzip
import io
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from osmlake import schemas
from osmlake.config import preset
from osmlake.functions.geometry import geo, register
from osmlake.plans import apply as ap
from osmlake.plans.database import Database, qualified
from osmlake.plans.initial_load import initialise
from osmlake.plans.inspect import sample_geojson, snapshot_diff
from osmlake.sources.changes import read_changes, sequence_of
from osmlake.sources.replication import DirectoryServer, fetch_change_files, next_change_file, pending_sequences, resolve_target_sequence
from osmlake.sources.store import SnapshotStore
from osmlake.sql import register_views
from osmlake.streaming import feed

CONFIG = preset("testing")
CONFIGS = dict.fromkeys(("node", "way", "relation", "edges", "archive"), CONFIG)
STAMP = 'timestamp="2024-01-0{d}T00:00:00Z" uid="3" user="a"'


def extract(spark):
    meta = "version bigint, timestamp string, changeset bigint, uid bigint, user string, tags map<string,string>"
    own = (1, "2024-01-01 00:00:00", 10, 1, "u")
    points = {1: (0, 0), 2: (1, 0), 3: (1, 1), 4: (0, 1), 5: (5, 5), 6: (6, 6)}
    return {
        "node": spark.createDataFrame([(i, *own, {}, float(y), float(x)) for i, (x, y) in points.items()], f"id bigint, {meta}, lat double, lon double"),
        "way": spark.createDataFrame([(1, *own, {"building": "yes"}, [1, 2, 3, 4, 1]), (2, *own, {}, [5, 6])], f"id bigint, {meta}, refs array<bigint>"),
        "relation": spark.createDataFrame([(1, *own, {"type": "multipolygon"}, [("way", 1, "outer")]), (2, *own, {"type": "route"}, [("way", 2, "")]), (3, *own, {"type": "multipolygon"}, [("relation", 1, "")])], f"id bigint, {meta}, members {schemas.MEMBERS}"),
    }


FILES = {
    11: '<modify><node id="3" version="2" {s} changeset="20" lat="2" lon="2"/></modify><create><node id="7" version="1" {s} lat="7" lon="7"><tag k="a" v="b"/></node></create>',
    12: '<modify><way id="2" version="2" {s} changeset="21"><nd ref="5"/><nd ref="6"/><nd ref="7"/></way></modify><modify><node id="5" version="2" {s} changeset="22" lat="5" lon="5"/><node id="5" version="3" {s} changeset="23" lat="5" lon="5"/></modify>',
    13: '<delete><node id="7" version="2" {s}/><relation id="2" version="2" {s}/></delete><modify><relation id="1" version="2" {s} changeset="24"><member type="way" ref="1" role="outer"/><member type="node" ref="6"/><tag k="type" v="multipolygon"/></relation></modify>',
}


@pytest.fixture(scope="module")
def server(tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    for n, body in FILES.items():
        text = f'<?xml version="1.0"?><osmChange version="0.6">{body.format(s=STAMP.format(d=n - 9))}</osmChange>'
        (folder / f"{n}.osc.gz").write_bytes(gzip.compress(text.encode()))
        (folder / f"{n}.state.txt").write_text(f"sequenceNumber={n}\ntimestamp=2024-01-0{n - 9}T00\\:00\\:00Z\n")
    return DirectoryServer(str(folder))


def new_db(spark, path):
    db = Database(spark, f"file://{path}")
    initialise(db, extract(spark), CONFIGS, sequence=10)
    return db


def state(db):
    out = {}
    for kind in ("node", "way", "relation"):
        rows = db.read(f"{kind}s").select("id", "version", "changeset", F.sort_array("additional_changesets").alias("a"), geo("as_wkt", "geometry").alias("g"))
        out[kind] = sorted(map(str, rows.collect()))
    for name in schemas.EDGES:
        out[name] = sorted(map(tuple, db.read(name).collect()))
    return out


@pytest.fixture(scope="module")
def applied(spark, server, tmp_path_factory):
    """(database after all files, paths, state after the first file, state at the end)."""
    folder = tmp_path_factory.mktemp("applied")
    db = new_db(spark, folder / "db")
    paths = [ap.apply_next(db, server, str(folder / "down"))]
    first = state(db)
    paths += ap.apply_all(db, server, str(folder / "down"))
    return db, paths, first, state(db)


def test_initial_load_and_resume(spark, tmp_path):
    db = new_db(spark, tmp_path / "db")
    assert db.counts() == {"node": 6, "way": 2, "relation": 3} and db.min_applied() == 10
    assert sorted(map(tuple, db.read("relation_to_relations").collect())) == [(1, 3)] and db.read("osc_archive").count() == 0
    register_views(db, "x_", {"ways": 0})
    assert spark.sql("select count(*) from x_nodes").first()[0] == 6 and spark.sql("select count(geo_type(geom)) from x_ways").first()[0] == 0
    before = state(db)
    versions = [s["version"] for s in db.store.history("nodes")]
    initialise(db, extract(spark), CONFIGS, resume=True)
    assert state(db) == before and [s["version"] for s in db.store.history("nodes")] == versions
    area = db.read("relations").where("id = 3").select(geo("area", "geometry")).first()[0]
    assert area == 1


def test_change_files_one_by_one(applied):
    db, paths, _, _ = applied
    assert [sequence_of(p) for p in paths] == [11, 12, 13] and db.min_applied() == 13
    way = db.read("ways").where("id = 1").select(geo("area", "geometry").alias("a"), "additional_changesets", "latest_ts").first()
    assert way.a == 2 and way.additional_changesets == [20] and str(way.latest_ts) == "2024-01-02 00:00:00"
    assert db.read("relations").where("id = 3").select(geo("area", "geometry")).first()[0] == 2
    assert db.read("nodes").where("id = 5").first().additional_changesets == [22]
    assert db.read("nodes").where("id = 7").count() == 0 and {r.id for r in db.read("relations").collect()} == {1, 3}
    assert db.read("osc_archive").groupBy("sequence").count().count() == 3
    assert sorted(map(tuple, db.read("node_to_relations").collect())) == [(6, 1)] and db.read("way_to_relations").count() == 1


class Killed(Exception):
    pass


@pytest.mark.parametrize("kill_at", [2, 4])
def test_resume_after_a_commit(spark, tmp_path, server, applied, kill_at, monkeypatch):
    db = new_db(spark, tmp_path / "db")
    commit, seen = SnapshotStore._commit, [0]

    def counted(self, *a, **k):
        out = commit(self, *a, **k)
        seen[0] += 1
        if seen[0] == kill_at:
            raise Killed
        return out

    monkeypatch.setattr(SnapshotStore, "_commit", counted)
    try:
        ap.apply_change_file(db, f"{server.folder}/11.osc.gz")
    except Killed:
        pass
    monkeypatch.setattr(SnapshotStore, "_commit", commit)
    ap.apply_change_file(db, f"{server.folder}/11.osc.gz")
    assert state(db) == applied[2] and db.read("osc_archive").count() == 2


def test_gaps_are_refused_and_repeats_do_nothing(spark, tmp_path, server):
    db = new_db(spark, tmp_path / "db")
    with pytest.raises(ap.SequenceGap):
        ap.apply_change_file(db, f"{server.folder}/12.osc.gz")
    assert sequence_of(ap.apply_next(db, server, str(tmp_path / "down"), keep_file=False)) == 11 and not list((tmp_path / "down").iterdir())
    before = state(db)
    ap.apply_change_file(db, f"{server.folder}/11.osc.gz")
    assert state(db) == before


def test_stream_equals_batch(spark, tmp_path, server, applied):
    stream = new_db(spark, tmp_path / "b")
    feed.start(stream, str(server.folder), str(tmp_path / "checkpoint")).awaitTermination()
    assert state(stream) == applied[3] and stream.min_applied() == 13


def test_change_file_parser(spark, tmp_path):
    plain = tmp_path / "5.osc"
    plain.write_text('<osmChange><delete><node id="7" version="2" timestamp="2024-01-01T00:00:00Z"/></delete><create><way id="1" version="1" timestamp="x"><nd ref="1"/><tag k="a" v="é"/></way><relation id="2" version="1" timestamp="x"><member type="node" ref="1"/></relation></create></osmChange>')
    rows = {(r.type, r.op): r for r in read_changes(spark, str(plain)).collect()}
    node, way, relation = rows["node", "delete"], rows["way", "create"], rows["relation", "create"]
    assert (node.lat, node.changeset, node.uid, node.tags) == (None, 0, None, {}) and way.refs == [1] and way.tags == {"a": "é"} and relation.members[0].role == ""
    assert sequence_of("/a/4780.osc.gz") == 4780 and sequence_of("x.osc.gz") is None


def test_store_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.create("t", "id bigint, version bigint", CONFIG)
    rows = lambda *r: spark.createDataFrame(list(r), "id bigint, version bigint")
    assert store.read("t").count() == 0
    store.append("t", rows((1, 1), (2, 1)), a=1)
    when = datetime.now(timezone.utc)
    store.merge("t", rows((1, 2), (3, 1)), rows((2, 0)).select("id"), b=2)
    assert sorted(map(tuple, store.read("t").collect())) == [(1, 2), (3, 1)] and store.properties("t") == {"a": 1, "b": 2}
    assert sorted(map(tuple, store.read_as_of("t", when).collect())) == [(1, 1), (2, 1)] == sorted(map(tuple, store.read("t", 1).collect()))
    assert [h["operation"] for h in store.history("t")] == ["create", "append", "merge"]
    diff = snapshot_diff(*(d.withColumns({"latest_ts": F.lit(None).cast("timestamp"), "changeset": F.lit(0), "geometry": F.lit(None).cast("binary")}) for d in (store.read("t", 1), store.read("t"))))
    assert {r.id: r.change for r in diff.collect()} == {1: "modified", 2: "deleted", 3: "created"}
    with pytest.raises(LookupError):
        store.read("nothing")
    store.drop("t")
    assert not store.exists("t")


def test_sample_geojson(spark, tmp_path):
    register(spark)
    db = new_db(spark, tmp_path / "db")
    path = sample_geojson(db.read("ways"), str(tmp_path / "x.geojson"), "way", "Polygon")
    found = json.loads(open(path).read())["features"]
    assert [f["id"] for f in found] == ["way/1"] and found[0]["geometry"]["type"] == "Polygon" and found[0]["properties"]["building"] == "yes"


def test_replication(server, tmp_path):
    assert [pending_sequences(*x) for x in ((100, 100), (10, 13), (50, 40), (99, 100))] == [[], [11, 12, 13], [], [100]]
    utc = lambda d: datetime(2024, 1, d, 12, tzinfo=timezone.utc)
    assert resolve_target_sequence(server, 13) == 13 and resolve_target_sequence(server, 13, utc(3)) == 12 and resolve_target_sequence(server, 13, utc(9)) == 13
    assert [sequence_of(p) for p in fetch_change_files(server, str(tmp_path / "d"), newest=utc(2))] == [12, 13]
    assert sequence_of(next_change_file(server, str(tmp_path / "d"), 12)) == 13 and next_change_file(server, str(tmp_path / "d"), 13) is None
    with pytest.raises(ValueError):
        fetch_change_files(server, str(tmp_path / "d"))


def test_names_and_presets():
    names = qualified("c", "d")
    assert names["nodes"] == "c.d.nodes" and names["osc_archive"] == "c.d.osc_archive" and len(names) == 8
    assert preset("nodes").writer_options("id")["parquet.bloom.filter.max.bytes"] == str(8 << 20) and preset("ways", files=7).files == 7
    assert "parquet.bloom.filter.max.bytes" not in preset("ways", bloom_filter=False).writer_options("id")


def test_merges_write_what_changes(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.create("t", "id bigint, version bigint", preset("testing", files=8))
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, version bigint")
    store.append("t", frame([(k, 1) for k in range(1000)]))
    first = store.snapshot("t")
    assert len(first["data"]) == 8 and all(e["hi"] - e["lo"] < 300 for e in first["data"])
    ids = frame([(3, 0), (990, 0), (5000, 0)]).select("id")
    assert len(store.touched("t", ids)) == 2 and sorted(r.id for r in store.lookup("t", ids).collect()) == [3, 990]
    want = dict.fromkeys(range(1000), 1)
    for n in range(2, 7):
        store.merge("t", frame([(n, n), (900 + n, n), (2000, n), (2000 + n, 1), (3, 0)]), frame([(n + 20, 0)]).select("id"))
        want |= {n: n, 900 + n: n, 2000: n, 2000 + n: 1}
        del want[n + 20]
    now = store.snapshot("t")
    assert [e for e in now["data"] if e["seq"] == 1] == first["data"] and sum(e["rows"] for e in now["data"]) < 1030
    assert dict(store.read("t").collect()) == want and dict(store.read("t", 1).collect()) == dict.fromkeys(range(1000), 1)
    assert dict(store.lookup("t", frame([(22, 0), (904, 0), (2000, 0)]).select("id")).collect()) == {904: 4, 2000: 6}
    store.compact("t")
    after = store.snapshot("t")
    assert not after["gone"] and dict(store.read("t").collect()) == want and dict(store.read("t", now["version"]).collect()) == want
    assert {e["path"] for e in first["data"]} & {e["path"] for e in after["data"]}  # files that nothing touches stay
    assert store.expire("t") > 0 and dict(store.read("t").collect()) == want and [h["operation"] for h in store.history("t")] == ["compact"]
    monkeypatch.setattr("osmlake.sources.store.COMPACT_ROWS", 3)
    monkeypatch.setattr("osmlake.sources.store.COMPACT_SHARE", 0)
    store.merge("t", frame([(1, 9), (2, 9), (4, 9), (5, 9)]), ids)
    assert [h["operation"] for h in store.history("t")][-1] == "compact" and dict(store.read("t").collect()) == {k: v for k, v in (want | {1: 9, 2: 9, 4: 9, 5: 9}).items() if k not in (3, 990)}


def test_change_files_are_cut_anywhere(spark, tmp_path, monkeypatch):
    from osmlake.sources import changes

    rows = [(k, ("node", "way", "relation")[k % 3], ("create", "modify", "delete")[k // 3 % 3], k, f"2024-01-01T00:00:{k % 60:02}Z", None if k % 5 == 0 else k, 'u"<&>' if k % 2 else None, k * 10, {"k<": f"v>{k}\n"} if k % 4 else {}, None if k % 7 == 0 else k / 8, 1.5, [k, k + 1] if k % 3 == 1 else None, [("node", k, "ä")] if k % 3 == 2 else None) for k in range(1, 400)]
    frame = spark.createDataFrame([(*r, r[4]) for r in rows], schemas.CHANGES)
    changes.write_changes(frame, f"file://{tmp_path}/7.osc.gz")
    changes.write_changes(frame.limit(0), f"file://{tmp_path}/8.osc")
    text = gzip.decompress((tmp_path / "7.osc.gz").read_bytes())
    want = sorted(map(str, frame.collect()))
    assert sorted(map(str, read_changes(spark, f"file://{tmp_path}/7.osc.gz", f"file://{tmp_path}/8.osc").collect())) == want
    for read, piece in ((17, 1), (100, 300), (1 << 20, 900)):
        monkeypatch.setattr(changes, "READ", read)
        monkeypatch.setattr(changes, "PIECE", piece)
        found = [e["id"] for op, p in changes.pieces(io.BytesIO(text)) for e in changes.elements(op, p)]
        assert sorted(found) == list(range(1, 400))
    with pytest.raises(ValueError):
        list(changes.pieces(io.BytesIO(text[: len(text) // 2])))


def test_plain_rules_for_relations(spark, tmp_path):
    from osmlake.operators.relations import PLAIN

    rows = extract(spark)
    own = (1, "2024-01-01 00:00:00", 10, 1, "u")
    more = spark.createDataFrame([(5, *own, {}, [1, 2, 3]), (6, *own, {}, [3, 4, 1])], rows["way"].schema)
    parents = spark.createDataFrame([(7, *own, {"type": "boundary"}, [("way", 5, ""), ("way", 6, "")]), (8, *own, {"type": "site"}, [("relation", 1, "")])], rows["relation"].schema)
    rows |= {"way": rows["way"].union(more), "relation": rows["relation"].union(parents)}
    found = {}
    for name, rules in (("own", None), ("plain", PLAIN)):
        db = Database(spark, f"file://{tmp_path}/{name}", *([rules] if rules else []))
        initialise(db, rows, CONFIGS)
        found[name] = {r.id: (r.t, r.a) for r in db.read("relations").select("id", geo("type", "geometry").alias("t"), geo("area", "geometry").alias("a")).collect()}
    assert found["own"][7] == ("ST_Polygon", 1) and found["own"][8] == (None, None)
    assert found["plain"][7][0].endswith("LineString") and found["plain"][8] == ("ST_Polygon", 1) and found["plain"][1] == found["own"][1]


def test_outages_are_not_empty_servers(monkeypatch):
    import urllib.error

    from osmlake.sources.replication import HttpServer

    def answer(code):
        def get(self, path):
            raise urllib.error.HTTPError(path, code, "", {}, None)

        return get

    monkeypatch.setattr(HttpServer, "_get", answer(404))
    assert HttpServer("http://x").state(5) is None
    monkeypatch.setattr(HttpServer, "_get", answer(503))
    with pytest.raises(urllib.error.HTTPError):
        HttpServer("http://x").state()
