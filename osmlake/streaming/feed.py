"""The change feed as a stream: one file in each micro-batch, applied in order of sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from osmlake.operators.changes import dedup
from osmlake.plans.apply import apply_change_file
from osmlake.plans.database import Database
from osmlake.sources.changes import sequence_of

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def start(db: Database, folder: str, checkpoint: str, allow_gaps: bool = False) -> StreamingQuery:
    """Apply the files that arrive in ``folder``; stops when all that are there are applied.

    The stream only names files (their content column is never read); each is
    parsed by its own job.  Files of a batch are applied in order of sequence.
    The stamps of the tables, not the batch ids, make a replayed batch harmless.
    """

    def apply(batch: DataFrame, _: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]
        for path in sorted(paths, key=lambda p: (sequence_of(p) is None, sequence_of(p) or 0, p)):
            apply_change_file(db, path, allow_gaps)

    files = db.spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", "*.osc*").load(folder)
    return files.select("path").writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_merges(store, table: str, changes: DataFrame, to_rows, checkpoint: str) -> StreamingQuery:
    """Merge a stream of change records into a table: each micro-batch is deduplicated and merged in one commit.

    ``to_rows``: latest records -> (upserts in the table's columns, deletes).
    A replayed batch changes nothing, as versions don't rise.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows, gone = to_rows(dedup(batch))
        store.merge(table, rows, gone, last_batch=batch_id)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
