"""A database: the eight tables in a store, with their state stamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from osmlake import schemas
from osmlake.config import TableConfig
from osmlake.operators import edges
from osmlake.operators.relations import Rules
from osmlake.sources.store import SnapshotStore

APPLIED, ARCHIVED, CURRENT, AT = "last_applied_sequence", "last_archived_sequence", "current_osc_file", "applied_sequences"
TYPED = {"node": "nodes", "way": "ways", "relation": "relations"}
ARCHIVE = "osc_archive"
#: All tables of a database.
TABLES = (*TYPED.values(), *schemas.EDGES, ARCHIVE)


def qualified(*parents: str) -> dict[str, str]:
    """Every table with its full name below a catalog and schema, or a schema alone."""
    return {t: ".".join((*parents, t)) for t in TABLES}


class Database:
    """Typed tables, edge tables and the change archive below one root; ``rules``: how its relations are built."""

    def __init__(self, spark: SparkSession, root: str, rules: Rules = Rules()):
        self.spark, self.store, self.rules = spark, SnapshotStore(spark, root), rules

    def create_typed(self, kind: str, config: TableConfig | None = None) -> None:
        self.store.create(TYPED[kind], schemas.TYPED[kind], config)

    def create_edges(self, config: TableConfig | None = None, names: tuple[str, ...] = tuple(schemas.EDGES)) -> None:
        """Edge tables, laid out by child, as they are looked up; a refresh replaces edges by parent."""
        for name in names:
            child, parent = (c.split()[0] for c in schemas.EDGES[name].split(", "))
            self.store.create(name, schemas.EDGES[name], config, key=child, guard=parent)

    def create_archive(self, config: TableConfig | None = None) -> None:
        self.store.create(ARCHIVE, schemas.ARCHIVE, config, key=None, partition="sequence")

    def read(self, table: str) -> DataFrame:
        return self.store.read(table)

    def lookup(self, table: str, ids: DataFrame) -> DataFrame:
        """The rows of some ids (edge tables: children), from the files that can hold them."""
        return self.store.lookup(table, ids)

    def with_geom(self, kind: str, ids: DataFrame | None = None) -> DataFrame:
        """A typed table (or its rows of some ids) with its geometry as ``geom``, as the operators take it."""
        rows = self.read(TYPED[kind]) if ids is None else self.lookup(TYPED[kind], ids)
        return rows.withColumn("geom", F.col("geometry"))

    def populate(self, name: str) -> None:
        """An edge table anew from its parents."""
        derive, _, kind = edges.DERIVED[name]
        self.store.overwrite(name, derive(self.read(TYPED[kind])))

    def counts(self) -> dict[str, int]:
        return {kind: self.read(t).count() for kind, t in TYPED.items()}

    def max_timestamp(self) -> datetime | None:
        per = [self.read(t).agg(F.max("timestamp").alias("t")) for t in TYPED.values()]
        return per[0].unionAll(per[1]).unionAll(per[2]).agg(F.max("t")).first()[0]

    def stamp(self, table: str, name: str = APPLIED) -> int | None:
        value = self.store.properties(table).get(name)
        return None if value is None else int(value)

    def min_applied(self) -> int | None:
        """The least stamp of the typed tables; None if one has none."""
        stamps = [self.stamp(t) for t in TYPED.values()]
        return None if None in stamps else min(stamps)

    def maintain(self, keep: int = 1) -> None:
        """Compact every table, then forget all but the newest ``keep`` snapshots and remove what they alone had."""
        for table in TABLES:
            if self.store.exists(table):
                self.store.compact(table)
                self.store.expire(table, keep)

    def has_rows(self, table: str) -> bool:
        return not self.read(table).isEmpty()
