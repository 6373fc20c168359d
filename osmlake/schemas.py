"""Table layouts, as DDL."""

_COMMON = "id bigint, version bigint, timestamp timestamp, changeset bigint, uid bigint, user string, tags map<string,string>"
_DERIVED = "latest_ts timestamp, additional_changesets array<bigint>, geometry binary"
MEMBERS = "array<struct<type:string,ref:bigint,role:string>>"
BBOX = "struct<xmin:float,xmax:float,ymin:float,ymax:float>"

NODES = f"{_COMMON}, lat double, lon double, {_DERIVED}"
WAYS = f"{_COMMON}, refs array<bigint>, {_DERIVED}, bbox {BBOX}"
RELATIONS = f"{_COMMON}, members {MEMBERS}, {_DERIVED}, bbox {BBOX}"

NODE_TO_WAYS = "node_id bigint, way_id bigint"
WAY_TO_RELATIONS = "way_id bigint, relation_id bigint"
NODE_TO_RELATIONS = "node_id bigint, relation_id bigint"
RELATION_TO_RELATIONS = "child_relation_id bigint, parent_relation_id bigint"

#: One row for each element of a change file.
CHANGES = (
    "id bigint, type string, op string, version bigint, timestamp string, uid bigint, user string, changeset bigint, "
    f"tags map<string,string>, lat double, lon double, refs array<bigint>, members {MEMBERS}, latest_ts string"
)

ARCHIVE = (
    "sequence bigint, osc_file string, applied_at timestamp, id bigint, type string, op string, version bigint, timestamp timestamp, changeset bigint, "
    f"additional_changesets array<bigint>, uid bigint, user string, tags map<string,string>, lat double, lon double, refs array<bigint>, members {MEMBERS}"
)

KINDS = ("node", "way", "relation")
TYPED = {"node": NODES, "way": WAYS, "relation": RELATIONS}
EDGES = {
    "node_to_ways": NODE_TO_WAYS,
    "way_to_relations": WAY_TO_RELATIONS,
    "node_to_relations": NODE_TO_RELATIONS,
    "relation_to_relations": RELATION_TO_RELATIONS,
}
