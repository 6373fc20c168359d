"""Version-guarded merge of upserts and deletes into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(target: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The table after one merge.

    Deletes win over upserts of the same id and drop the row.  An upsert
    replaces a row whose version isn't above its own and is inserted where
    there is none, provided it has a version.  A row whose version is null
    stays.
    """
    gone = deletes.select("id").distinct()
    source = upserts.join(gone, "id", "left_anti").where("version is not null")
    new = source.select(F.col("id"), F.struct(*target.columns).alias("s"))
    old = target.join(gone, "id", "left_anti").select(F.col("id"), F.struct(*target.columns).alias("t"))
    wins = F.col("s").isNotNull() & (F.col("t").isNull() | F.coalesce(F.col("s.version") >= F.col("t.version"), F.lit(False)))
    row = F.when(wins, F.col("s")).otherwise(F.col("t"))
    return old.join(new, "id", "full_outer").select(row.alias("r")).select("r.*")
