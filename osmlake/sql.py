"""For SQL users: the geometry functions and temporary views of a database's tables."""

from __future__ import annotations

from osmlake.functions.geometry import register
from osmlake.plans.database import TABLES, TYPED, Database


def register_views(db: Database, prefix: str = "", version: dict[str, int] | None = None) -> list[str]:
    """Views of all tables that exist, named ``{prefix}{table}``; typed ones have their geometry as ``geom`` too.

    ``version``: table -> snapshot to show instead of the newest.
    """
    register(db.spark)
    names = []
    for table in TABLES:
        if not db.store.exists(table):
            continue
        df = db.store.read(table, (version or {}).get(table))
        if table in TYPED.values():
            df = df.withColumn("geom", df["geometry"])
        df.createOrReplaceTempView(f"{prefix}{table}")
        names.append(f"{prefix}{table}")
    return names
