"""Structured Streaming into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.storage.index import Index


def commit_batch(index: Index, batch: DataFrame, batch_id: int, deleted: str | None = None) -> bool:
    """One micro-batch as one commit; a batch that was committed before is passed over.

    The batch number is part of the manifest, so a restart between the commit and the stream's
    own checkpoint adds nothing twice.  ``deleted`` names a boolean column of rows that delete
    their id.  Of several rows of one id in a batch the last by ``seq`` (if there is such a
    column) or an arbitrary one is taken.  An empty batch commits nothing.
    """
    if batch_id <= index.manifest.source_batch:
        return False
    last = F.max_by(F.struct(*batch.columns), "seq") if "seq" in batch.columns else F.any_value(F.struct(*batch.columns))
    one = batch.where("id is not null and id <> ''").groupBy("id").agg(last.alias("r")).select("r.*")
    if deleted:
        gone = F.coalesce(F.col(deleted), F.lit(False))
        index.delete(one.where(gone).select("id"))
        one = one.where(~gone).drop(deleted)
    one = one.persist()
    try:
        if one.isEmpty() and not index.pending["deletes"]:
            return False
        if not one.isEmpty():
            index.add(one)
        index.commit(source_batch=batch_id)
    except Exception:
        index.abort()
        raise
    finally:
        one.unpersist()
    return True


def stream_into(index: Index, stream: DataFrame, checkpoint: str, deleted: str | None = None, **trigger) -> StreamingQuery:
    """Starts the stream; ``trigger`` goes to ``DataStreamWriter.trigger`` (default: what is there, then stop)."""
    writer = stream.writeStream.foreachBatch(lambda b, i: commit_batch(index, b, i, deleted)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
