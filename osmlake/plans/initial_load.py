"""Building a database from typed extracts, stage by stage; a stage whose table has rows is skipped on resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from osmlake import schemas
from osmlake.config import TableConfig
from osmlake.functions.geometry import register
from osmlake.operators.finalize import chosen, shaped
from osmlake.operators.nodes import build_node_geometry, no_changesets
from osmlake.operators.relations import Rules, build_relation_geometry, merge_relation_geometry
from osmlake.operators.ways import build_way_lines, flatten_refs, promote_areas
from osmlake.plans.database import ARCHIVE, TYPED, Database


def read_extract(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three parts of an extract in ``type=node``, ``type=way`` and ``type=relation`` folders.

    A null changeset becomes 0; ``additional_changesets`` starts empty.
    """
    out = {}
    for kind in schemas.KINDS:
        df = spark.read.parquet(f"{path}/type={kind}")
        out[kind] = df.withColumn("changeset", F.coalesce("changeset", F.lit(0))).withColumn("additional_changesets", no_changesets())
    out["way"] = flatten_refs(out["way"]) if "nds" in out["way"].columns else out["way"]
    return out


def scoped(df: DataFrame, relations: DataFrame, kind: str) -> DataFrame:
    """The rows that relations refer to; the references aren't broadcast, as their number is underestimated."""
    refs = relations.select(F.explode("members").alias("m")).where(F.col("m.type") == kind).select(F.col("m.ref").alias("id")).distinct()
    return df.join(refs.hint("merge"), "id", "left_semi")


def build_relations(relations: DataFrame, ways: DataFrame, nodes: DataFrame, children: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """Final rows of relations from members with ``geom``."""
    return shaped(chosen_relations(relations, ways, nodes, children, rules), "relation")


def chosen_relations(relations: DataFrame, ways: DataFrame, nodes: DataFrame, children: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """The same before their geometry is cleaned."""
    ways, nodes = scoped(ways, relations, "way"), scoped(nodes, relations, "node")
    shapes = build_relation_geometry(relations, ways, nodes, children, rules.require_closed, rules.polygon_parents_only)
    return chosen(merge_relation_geometry(relations, shapes, ways, nodes, rules.member_timestamps), "relation")


def initialise(db: Database, extract: dict[str, DataFrame], configs: dict[str, TableConfig] | None = None, resume: bool = False, sequence: int | None = None) -> None:
    """All tables from an extract (dict of node, way, relation).

    Each table is written and read back before the next stage uses it.
    ``sequence``: stamped on the typed tables in the commit of their rows.
    """
    register(db.spark)
    configs = configs or {}
    config = lambda k: configs.get(k)
    stamp = {} if sequence is None else {"last_applied_sequence": sequence}

    def due(table: str, create) -> bool:
        if resume and db.store.exists(table):
            return not db.has_rows(table)
        create()
        return True

    def load(kind: str, rows: DataFrame) -> None:
        db.store.append(TYPED[kind], rows, lambda dealt: shaped(dealt, kind), **stamp)

    if due(TYPED["node"], lambda: db.create_typed("node", config("node"))):
        load("node", chosen(build_node_geometry(extract["node"]), "node"))
    if due(TYPED["way"], lambda: db.create_typed("way", config("way"))):
        lines = build_way_lines(extract["way"], db.read("nodes"))
        load("way", chosen(promote_areas(lines), "way"))
    if due(TYPED["relation"], lambda: db.create_typed("relation", config("relation"))):
        load("relation", chosen_relations(extract["relation"], db.with_geom("way"), db.with_geom("node"), rules=db.rules))
    for name in schemas.EDGES:
        if due(name, lambda n=name: db.create_edges(config("edges"), (n,))):
            db.populate(name)
    if not (resume and db.store.exists(ARCHIVE)):
        db.create_archive(config("archive"))
